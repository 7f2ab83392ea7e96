"""Operator 11: licence scans by a generalised suffix automaton over the words of licence templates.

The templates' words make one automaton, whose suffix links are folded into two dense tables (state by word: the next
state, and the length at most that is kept on the way there). A text's words stream through it: each step looks the word up
and so knows the longest run of words, ending there, that stands in any template. Words of no template end every match, so
only runs of template words are stepped through, all runs of a block at once; a run is cut into segments that warm up over
as many words as the longest template has, so their statistics are exact. Base phrases are templates, too: one ends where
the match is at least as long and the state, or a state that its links lead to, holds it. Matches that can't grow any
further and are MIN_MATCH words long are chained in text and template order; a chain that covers COVERED of a template is a
span of it, and of spans that share words the best covered stands.

score: the largest share of a phrase or template that is covered in one chain; a base phrase that stands is covered whole.
Cases: null and empty texts have no words, labels '' and score 0; rows stay as they come, repeated ones, too; ids of any
type pass; an empty table gives none; other columns are not read; texts are read in pieces of PIECE bytes with the words and
matches that the next one needs, whatever their length; of chains that are covered alike the first stands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from threadloom.llm.common import LOWERED_WORD, small_batches, text_blocks, words
from threadloom.llm.license_texts import PHRASES, TEMPLATES

#: Words that a match needs to be chained, words between two matches of a chain at most, and the share of a template that makes a span.
MIN_MATCH, MAX_GAP, COVERED = 6, 40, 0.6
#: Bytes of a long text, and words of a run, that are worked on at once.
PIECE, SEGMENT = 1 << 20, 1 << 10
FAR = np.iinfo(np.int32).max

SPAN = StructType([StructField("label", StringType()), StructField("first_word", LongType()), StructField("last_word", LongType()), StructField("covered", DoubleType())])


class Automaton:
    """The generalised suffix automaton of some sequences of small numbers, one after the other."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the strings that p leads to by word, apart from the longer ones of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, number: int, sequence: Iterable[int]) -> None:
        last = 0
        for at, word in enumerate(sequence):
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p != -1 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p != -1:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            self.ends[last].append((number, at))

    def find(self, sequence: Iterable[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


@dataclass(frozen=True)
class Scanner:
    """The folded automaton: what a worker needs for any text."""

    hashes: np.ndarray  # of the templates' words, sorted; a word's number is its place here
    goto: np.ndarray
    keep: np.ndarray
    need: np.ndarray  # state by phrase: the match's length from which the phrase ends here
    ends: list[np.ndarray]  # by state: (template, place of the last word) where its strings end
    phrase_labels: list[str]
    phrase_sizes: np.ndarray
    labels: list[str]
    sizes: list[int]

    def steps(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, length) of the longest match that ends at each word; ids: -1 where no template has the word; cut: a text begins here."""
        state, length = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
        known = ids >= 0
        begins = np.flatnonzero(known & (cut | ~np.concatenate([[False], known[:-1]])))
        stops = np.flatnonzero(known & np.concatenate([cut[1:] | ~known[1:], [True]])[: len(ids)]) + 1
        least = min([*self.phrase_sizes.tolist(), MIN_MATCH])
        wide = stops - begins >= least
        begins, stops = begins[wide], stops[wide]
        if not len(begins):
            return state, length
        warm = max([*self.sizes, *self.phrase_sizes.tolist()])
        count = -(-(stops - begins) // SEGMENT)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(begins, count) + nth * SEGMENT
        last = np.minimum(first + SEGMENT, np.repeat(stops, count))
        start = np.maximum(first - warm, np.repeat(begins, count))
        order = np.argsort(start - last, kind="stable")
        first, last, start = first[order], last[order], start[order]
        longest = last - start
        s, n = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        for j in range(int(longest[0])):
            m = int(np.searchsorted(-longest, -j))  # segments that are longer than j
            at = start[:m] + j
            word = ids[at]
            n[:m] = np.minimum(n[:m], self.keep[s[:m], word]) + 1
            s[:m] = self.goto[s[:m], word]
            own = at >= first[:m]
            state[at[own]], length[at[own]] = s[:m][own], n[:m][own]
        return state, length

    def chains(self, at: np.ndarray, state: np.ndarray, length: np.ndarray) -> tuple[float, list[tuple[str, int, int, float]]]:
        """The best covered share, and the spans, of one text's longest matches, given in its order."""
        open_: dict[int, list[list]] = {}
        done: list[tuple[float, int, int, int]] = []

        def close(t: int, chain: list) -> None:
            if not chain[4]:
                done.append((chain[2] / self.sizes[t], t, chain[3], chain[0]))

        for e, s, n in zip(at.tolist(), state.tolist(), length.tolist(), strict=True):
            for t, j in self.ends[s].tolist():
                still = open_.setdefault(t, [])
                gone = [c for c in still if c[0] < e - n - MAX_GAP]
                if gone:
                    for c in gone:
                        close(t, c)
                    still[:] = [c for c in still if c[0] >= e - n - MAX_GAP]
                best, by = [e, j, n, e - n + 1, False], None
                for c in still:
                    gain = min(n, e - c[0], j - c[1])
                    if gain > 0 and j - n - c[1] <= MAX_GAP and c[2] + gain > best[2]:
                        best, by = [e, j, c[2] + gain, c[3], False], c
                if by is not None:
                    by[4] = True
                still.append(best)
        for t, still in open_.items():
            for c in still:
                close(t, c)
        spans: list[tuple[str, int, int, float]] = []
        for share, t, a, b in sorted(done, key=lambda c: (-c[0], c[2], c[1])):
            if share >= COVERED and all(2 * (min(b, z) - max(a, y) + 1) <= min(b - a, z - y) + 1 for _, y, z, _ in spans):
                spans.append((self.labels[t], a, b, share))
        return max((c[0] for c in done), default=0.0), sorted(spans, key=lambda x: (x[1], x[2], x[0]))


def word_list(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _, _ = words(data, np.array([0, len(data)]))
    low = LOWERED_WORD[data].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _hashes(vocabulary: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(vocabulary), np.uint8)
    return words(data, np.array([0, len(data)]))[3]


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    """The automaton of (label, text) templates and (phrase, label) phrases, made once in each worker."""
    texts, spoken = [word_list(t) for _, t in templates], [word_list(p) for p, _ in phrases]
    vocabulary = sorted({w for t in [*texts, *spoken] for w in t})
    hashes = _hashes(vocabulary)
    order = np.argsort(hashes)
    number = {vocabulary[i]: k for k, i in enumerate(order.tolist())}
    automaton = Automaton()
    for k, t in enumerate([*texts, *spoken]):
        automaton.add(k if k < len(texts) else -1, [number[w] for w in t])
    n = len(automaton.link)
    goto, keep = np.zeros((n, len(vocabulary)), np.int32), np.full((n, len(vocabulary)), -1, np.int32)
    need = np.full((n, len(spoken)), FAR, np.int32)
    for p, t in enumerate(spoken):
        need[automaton.find([number[w] for w in t]), p] = len(t)
    ends: list[list[tuple[int, int]]] = [[x for x in e if x[0] >= 0] for e in automaton.ends]
    by_length = sorted(range(1, n), key=automaton.length.__getitem__)
    for s in by_length:
        need[s] = np.minimum(need[s], need[automaton.link[s]])
    for s in reversed(by_length):
        if automaton.link[s]:
            ends[automaton.link[s]] += ends[s]
    for s in [0, *by_length]:
        up = automaton.link[s]
        if up >= 0:
            goto[s], keep[s] = goto[up], np.minimum(keep[up], automaton.length[up])
        for word, q in automaton.next[s].items():
            goto[s, word], keep[s, word] = q, FAR - 1
    held = [np.array(sorted(set(e)), np.int64).reshape(-1, 2) for e in ends]
    return Scanner(hashes[order], goto, keep, need, held, [x for _, x in phrases], np.array([len(t) for t in spoken], np.int64), [x for x, _ in templates], [len(t) for t in texts])


@dataclass
class _Text:
    """What is known of one text so far."""

    words: int = 0
    base: int = 0
    first: int | None = None
    last: int | None = None
    phrases: frozenset = frozenset()
    matches: tuple = ()


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block's bytes and offsets, cut between words if it is one long text."""
    if len(data) <= 2 * PIECE or len(offsets) > 2:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and LOWERED_WORD[data[end]]:
            inside = LOWERED_WORD[data[end : end + PIECE]] != 0
            end += int(inside.argmin()) if not inside.all() else len(inside)
        yield data[at:end], np.array([0, end - at])
        at = end


def _block(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> list[_Text]:
    texts = [_Text() for _ in range(len(offsets) - 1)]
    warm = max([*scan.sizes, *scan.phrase_sizes.tolist()])
    tail = np.zeros(0, np.int64)  # the words before this piece, as many as a match can have
    for piece, bounds in _pieces(data, offsets):
        _, _, text, found = words(piece, bounds)
        place = np.minimum(np.searchsorted(scan.hashes, found), len(scan.hashes) - 1)
        ids = np.concatenate([tail, np.where(scan.hashes[place] == found, place, -1)])
        cut = np.zeros(len(ids), bool)
        cut[len(tail) :][np.flatnonzero(np.diff(text, prepend=-1 if not len(tail) else 0))] = True
        state, length = (x[len(tail) :] for x in scan.steps(ids, cut))
        count = np.bincount(text, minlength=len(texts))
        before = np.cumsum(count) - count
        here = np.arange(len(text)) - before[text] + np.array([t.words for t in texts], np.int64)[text]
        hit, phrase = np.nonzero((length[:, None] >= scan.need[state]) & (length[:, None] > 0))
        starts = here[hit] - scan.phrase_sizes[phrase] + 1
        for t in np.unique(text[hit]).tolist():
            mine = text[hit] == t
            x, a = texts[t], starts[mine]
            x.base += len(a)
            x.first, x.last = min([int(a.min()), *([] if x.first is None else [x.first])]), max([int(a.max()), *([] if x.last is None else [x.last])])
            x.phrases |= {scan.phrase_labels[p] for p in np.unique(phrase[mine]).tolist()}
        long = np.flatnonzero(length >= MIN_MATCH)
        for t in np.unique(text[long]).tolist():
            mine = long[text[long] == t]
            x = texts[t]
            new = (here[mine], state[mine], length[mine])
            merged = tuple(np.concatenate([x.matches[k], new[k]]) if x.matches else new[k] for k in range(3))
            begin = merged[0] - merged[2]
            x.matches = tuple(m[np.append(begin[1:] != begin[:-1], True)] for m in merged)  # the last of those that begin alike is the longest
        for x, n in zip(texts, count.tolist(), strict=True):
            x.words += n
        tail = ids[-warm:] if len(offsets) == 2 else tail
    return texts


def scan(batches: Iterable[pa.RecordBatch], templates: tuple, phrases: tuple) -> Iterator[pa.RecordBatch]:
    machine = scanner(templates, phrases)
    for rows, data, offsets in text_blocks(batches):
        out = []
        for x in _block(machine, data, offsets):
            share, spans = machine.chains(*x.matches) if x.matches else (0.0, [])
            labels = sorted({*x.phrases, *(s[0] for s in spans)})
            out.append((x.words, x.base, x.first, x.last, ",".join(sorted(x.phrases)), ",".join(labels), 1.0 if x.phrases else share, [dict(zip(SPAN.names, s, strict=True)) for s in spans]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])))
        names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], list(names))


def license_scan(docs: DataFrame, templates: Mapping[str, Iterable[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first_word, last_word, covered).

    templates: texts by label; phrases: label by phrase, of a word at least.
    """
    known = tuple((label, t) for label, texts in templates.items() for t in texts)
    spoken = tuple(phrases.items())
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(n, LongType()) for n in ("n_words", "n_base", "first_word", "last_word")), *(StructField(n, StringType()) for n in ("base_labels", "labels")), StructField("score", DoubleType()), StructField("spans", ArrayType(SPAN))])
    rows = small_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(lambda batches: scan(batches, known, spoken), schema)
