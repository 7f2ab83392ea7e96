"""Operator 7: chat formatting of raw transcripts.

A transcript is lines of text with or without speaker markers. A hidden Markov model has a state for each role and for
each half of a role's turn (its first line, a later line); it emits a line's marker and features (a question, its length,
an opening word that asks, lists and code, blankness). Its chances are counted over transcripts whose roles are known, all
of them, on top of one line's worth of a prior. Viterbi's path gives each line a role and tells where turns begin; turns
are then rendered canonically.

The path is found online: back-pointers are followed every CHECK lines, and what all surviving paths agree on is final
and leaves memory. So a transcript of any number of lines is read in bounded memory, with the result of Viterbi over all
of it.

Cases: a row without a transcript id is a transcript by itself; null and empty texts are blank lines, which belong to the
turn around them and are dropped at its ends; a transcript of blank lines only has no turn; rows that repeat a place
follow each other in the order of their texts; known turns with a null role or id aren't learned from, and none at all
leave the prior; an empty table gives no turn; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import partitions

ROLES = ("system", "user", "assistant")
#: Words that stand for the roles in markers.
NAMES = {
    "system": ("system", "instructions", "context", "note"),
    "user": ("user", "human", "customer", "student", "me", "q", "question", "instruction", "prompt"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "a", "answer", "response", "support"),
}
_BY_NAME = {name: role for role, names in NAMES.items() for name in names}
_MARKER = re.compile(r"^\s*(?:<\|\s*(?P<tag>\w+)\s*\|>|#{1,4}\s*(?P<head>\w+)\s*:?|\[(?P<bracket>\w+)\]\s*:?|\*\*(?P<bold>\w+)\s*:?\s*\*\*\s*:?|(?P<plain>\w+)\s*(?:\([^)\n]{0,24}\))?\s*[:>])[ \t]*", re.IGNORECASE)
_ASKS = re.compile(r"^\W*(?:what|why|how|who|when|where|which|can|could|would|please|is|are|do|does|should|tell|give|write|explain|help)\b", re.IGNORECASE)
_LISTS = re.compile(r"^\s*(?:[-*•]|\d+[.)]|```|\|)\s")
CHECK = 512
#: States: a role's first line, then a role's later line.
STATES = [(role, first) for first in (True, False) for role in ROLES]


#: Fixed values of the prior: how a line of each kind of state is marked and looks, before anything is counted.
_FOLLOW = {"system": (0.02, 0.9, 0.08), "user": (0.02, 0.03, 0.95), "assistant": (0.02, 0.95, 0.03)}


def features(line: str) -> tuple[str | None, bool, bool, bool, int, str]:
    """(role that a marker names, asks, ends as a question, list or code, length's class, the line without its marker)."""
    m = _MARKER.match(line)
    role = _BY_NAME.get(next(x for x in m.groups() if x).lower()) if m else None
    rest = line[m.end() :] if role else line
    n = len(rest)
    return role, bool(_ASKS.match(rest)), rest.rstrip().endswith("?"), bool(_LISTS.match(rest)), 0 if n < 80 else 1 if n < 240 else 2, rest


def symbols(line: str) -> tuple[tuple[int, int, int, int, int, int], str]:
    """(number of each feature's value, the line without its marker). Features are in the order of SIZES."""
    role, asks, question, lists, size, rest = features(line)
    return (0 if role is None else 1 + ROLES.index(role), int(asks), int(question), int(lists), size, int(not rest.strip())), rest


#: Values that each feature has: marker, asks, question, list or code, length, blank.
SIZES = (4, 2, 2, 2, 3, 2)
KINDS = ("start", "move", *(f"feature{i}" for i in range(len(SIZES))))


def prior() -> dict[str, np.ndarray]:
    """Chances before anything is counted: by kind, a row a state (start: one row), each of sum 1."""
    start = np.array([[0.25, 0.6, 0.15, 1e-6, 1e-6, 1e-6]])
    move = np.full((6, 6), 1e-6)
    tables = [np.zeros((6, n)) for n in SIZES]
    for i, (role, first) in enumerate(STATES):
        stay = 0.6 if role == "assistant" else 0.5
        for j, other in enumerate(ROLES):
            move[i, j] = (1 - stay) * _FOLLOW[role][j]
            if other == role:
                move[i, 3 + j] = stay
        own = 1 + ROLES.index(role)
        mark = [0.12 if first else 0.995] + [0.01 if first else 0.0005] * 3
        mark[own] = 0.86 if first else 0.0005
        user = role == "user"
        for t, row in zip(tables, (mark, (0.8, 0.2) if user else (0.95, 0.05), (0.75, 0.25) if user else (0.96, 0.04), (0.97, 0.03) if user else (0.88, 0.12), (0.45, 0.4, 0.15) if user else (0.3, 0.35, 0.35), (0.95, 0.05)), strict=True):
            t[i] = row
    out = {"start": start, "move": move} | {f"feature{i}": t for i, t in enumerate(tables)}
    return {k: t / t.sum(1, keepdims=True) for k, t in out.items()}


class Model:
    """Log chances of the first state, of moves between states, and of lines in each state. counts: (kind, row, column, lines)."""

    def __init__(self, counts: Iterable[tuple[str, int, int, int]] = ()) -> None:
        tables = prior()
        for kind, i, j, n in counts:
            tables[kind][i, j] += n
        logs = {k: np.log(t / t.sum(1, keepdims=True)) for k, t in tables.items()}
        self.start, self.moves = logs["start"][0], logs["move"]
        self.tables = [logs[f"feature{i}"] for i in range(len(SIZES))]
        self.memory: dict[tuple, np.ndarray] = {}

    def emission(self, found: tuple[int, ...]) -> np.ndarray:
        if found not in self.memory:
            self.memory[found] = sum(t[:, x] for t, x in zip(self.tables, found, strict=True))
        return self.memory[found]


def learn(known: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", role: str = "role") -> Model:
    """The model of transcripts whose rows are turns with their roles. Counted in partial sums; the driver gets the few sums."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], int] = {}

        def add(kind: str, i: int, j: int) -> None:
            sums[kind, i, j] = sums.get((kind, i, j), 0) + 1

        for batch in batches:
            for who, said, before, before_long in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = ROLES.index(who)
                last = None if before not in ROLES else ROLES.index(before) + 3 * before_long
                for n, line in enumerate((said or "").split("\n")):
                    state = now + 3 * (n > 0)
                    if n == 0 and last is None:
                        add("start", 0, state)
                    else:
                        add("move", last if n == 0 else now + 3 * (n > 1), state)
                    for f, x in enumerate(symbols(line)[0]):
                        add(f"feature{f}", state, x)
        if sums:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            columns = zip(*((*k, n) for k, n in sums.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "i", "j", "n"])

    rows = known.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"), F.col(role).alias("r")).where(F.col("k").isNotNull() & F.col("r").isin(*ROLES))
    by = Window.partitionBy("k").orderBy("o", "t")
    long = F.contains(F.coalesce("t", F.lit("")), F.lit("\n")).cast("int")
    rows = rows.select("r", "t", F.lag("r").over(by).alias("before"), F.coalesce(F.lag(long).over(by), F.lit(0)).alias("long"))
    found = rows.mapInArrow(count, "kind string, i int, j int, n bigint").groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))
    return Model(tuple(r) for r in found.collect())


def viterbi(model: Model, rows: np.ndarray) -> list[int]:
    """The likeliest states of all lines at once; rows: log emissions."""
    if not len(rows):
        return []
    score, back = model.start + rows[0], []
    for e in rows[1:]:
        step = score[:, None] + model.moves
        back.append(step.argmax(0))
        score = step.max(0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Reader:
    """Online Viterbi over one transcript: give() takes lines and returns (state, line) of those whose state is final."""

    def __init__(self, model: Model, check: int = CHECK) -> None:
        self.model, self.check, self.score = model, check, None
        self.back: list[np.ndarray] = []
        self.lines: list[str] = []

    def give(self, line: str) -> list[tuple[int, str]]:
        found, said = symbols(line)
        e = self.model.emission(found)
        if self.score is None:
            self.score = self.model.start + e
        else:
            step = self.score[:, None] + self.model.moves
            self.back.append(step.argmax(0))
            self.score = step.max(0) + e
            self.score -= self.score.max()
        self.lines.append(said)
        return self._agreed() if len(self.lines) % self.check == 0 else []

    def _agreed(self) -> list[tuple[int, str]]:
        """What the paths of all states share, from the first line on."""
        ends = np.arange(6)
        for t in range(len(self.back) - 1, -1, -1):
            ends = self.back[t][ends]
            if (ends == ends[0]).all():
                path = [int(ends[0])]
                for b in reversed(self.back[:t]):
                    path.append(int(b[path[-1]]))
                out = list(zip(path[::-1], self.lines[: t + 1], strict=True))
                # the next line's state depends on the line before it only through its score, which is kept
                self.back, self.lines = self.back[t + 1 :], self.lines[t + 1 :]
                return out
        return []

    def end(self) -> list[tuple[int, str]]:
        if self.score is None or not self.lines:
            return []
        path = [int(self.score.argmax())]
        for b in reversed(self.back):
            path.append(int(b[path[-1]]))
        return list(zip(path[::-1], self.lines, strict=True))


def rendered(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


class Turns:
    """Gathers lines with states into turns."""

    def __init__(self) -> None:
        self.role: str | None = None
        self.lines: list[str] = []

    def add(self, state: int, line: str) -> list[tuple[str, str]]:
        role, first = STATES[state]
        out = self.end() if first or role != self.role else []
        self.role = role
        self.lines.append(line)
        return out

    def end(self) -> list[tuple[str, str]]:
        text = "\n".join(self.lines).strip("\n").rstrip()
        out = [(self.role, text)] if self.role and text.strip() else []
        self.lines = []
        return out


def chat_format(transcripts: DataFrame, known: DataFrame | None = None, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """A row per recovered turn: conv_id, turn (from 0), role, text, rendered. transcripts: rows of lines in their order;
    known: transcripts to learn from, whose rows are turns with their `role`."""
    model = learn(known, key, order, text) if known is not None else Model()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, turns, n = object(), Reader(model), Turns(), 0
        out: list[tuple] = []

        def tell(found: list[tuple[str, str]]) -> None:
            nonlocal n
            for role, words in found:
                out.append((now, n, role, words, rendered(role, words)))
                n += 1

        def close() -> None:
            for state, line in reader.end():
                tell(turns.add(state, line))
            tell(turns.end())

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "turn", "role", "text", "rendered"])

        began = False
        for batch in batches:
            for k, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not began or k is None or k != now:
                    if began:
                        close()
                    began, now, reader, turns, n = True, k, Reader(model), Turns(), 0
                for line in (chunk or "").split("\n"):
                    for state, said in reader.give(line):
                        tell(turns.add(state, said))
                if len(out) >= 4096:
                    yield batch_of()
                    out = []
        if began:
            close()
        if out:
            yield batch_of()

    rows = transcripts.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.col(order).alias("o"))
    # rows without an id are transcripts of their own, wherever they are
    alone = F.when(F.col("k").isNull(), F.xxhash64("o", "t"))
    rows = rows.repartition(partitions(transcripts.sparkSession), F.col("k"), alone).sortWithinPartitions("k", "o", "t").select("k", "t")
    return rows.mapInArrow(read, "conv_id bigint, turn bigint, role string, text string, rendered string")


def raw_transcripts(conversations: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Conversations as raw transcripts would have them: markers in a style of each one's own, every eighth marker lost."""
    styles = [
        {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
        {"system": "System> ", "user": "Human> ", "assistant": "AI> "},
        {"system": "### System:\n", "user": "### Instruction:\n", "assistant": "### Response:\n"},
        {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
        {"system": "**Context:** ", "user": "**Q:** ", "assistant": "**A:** "},
        {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    ]
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles)))
    marker = F.lit("")
    for i, names in enumerate(styles):
        for role, mark in names.items():
            marker = F.when((style == i) & (F.col("role") == role), F.lit(mark)).otherwise(marker)
    lost = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0) & (F.col("turn") > 0)
    return conversations.select("conv_id", "turn", F.concat(F.when(lost, F.lit("")).otherwise(marker), F.coalesce("text", F.lit(""))).alias("text"), *(also or ()))
