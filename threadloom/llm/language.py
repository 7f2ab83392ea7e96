"""Operator 6: language identification by a byte convolutional network.

Bytes are embedded; filters of several widths run over windows of WINDOW bytes; each filter's maximum over a window, after
a rectifier, feeds a softmax over the languages. The network is trained in numpy on a bounded sample: about `max_texts`
labelled texts of each language, chosen by a hash, and `windows_each` windows of each, evenly over the text. Every language
that a row outside the held-out fold names is learned, however many there are.
A text is cut into windows from end to end; the mean of its windows' log-probabilities, weighted by their bytes, decides.

Cases: null texts and texts without a letter are `und` with score 0; so is every text if nothing is labelled; null
languages and null ids of labelled rows are not learned from; repeated documents get equal rows; an empty table gives
none; other columns are not read. Long texts are worked on window by window.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fold, small_batches, text_blocks

#: Bytes that a window needs to be learned from, where its text has others; all windows are classified.
LEAST = 32
WINDOW = 128
#: Bounds of the sample: labelled texts of each language, and windows of each text.
MAX_TEXTS, WINDOWS_EACH = 1000, 3
EMBEDDING = 8
#: Filters by width in bytes.
FILTERS = {2: 8, 3: 12, 4: 12, 5: 16}
WIDEST = max(FILTERS)
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows that are worked on at once.
AT_ONCE = 512
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with 0 at their ends, their text numbers, their bytes); an empty text has no window."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), n)
    step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][text] + step * WINDOW
    length = np.minimum(WINDOW, offsets[1:][text] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(start) else np.zeros((0, WINDOW), np.uint8)
    short = np.flatnonzero(length < WINDOW)
    windows[short] *= np.arange(WINDOW) < length[short, None]
    return windows, text, length


class Network:
    def __init__(self, languages: list[str], seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        n = sum(FILTERS.values())
        self.embed = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = rng.normal(0, 0.25, (WIDEST * EMBEDDING, n)).astype(np.float32)
        self.used = np.concatenate([np.repeat(np.arange(WIDEST)[:, None] < w, count, 1) for w, count in FILTERS.items()], 1).repeat(EMBEDDING, 0)
        self.filters *= self.used
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.2, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def spread(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes below a filter of the widest kind, at each place of each window."""
        e = self.embed[windows]
        places = WINDOW - WIDEST + 1
        out = np.empty((len(windows), places, WIDEST * EMBEDDING), np.float32)
        for j in range(WIDEST):
            out[:, :, j * EMBEDDING : (j + 1) * EMBEDDING] = e[:, j : j + places]
        return out.reshape(len(windows) * places, -1)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = self.spread(windows)
        y = (x @ self.filters).reshape(len(windows), -1, len(self.bias))
        pooled = y.max(1) + self.bias
        np.maximum(pooled, 0, out=pooled)
        z = pooled @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return x, y, pooled, z - np.log(np.exp(z).sum(1, keepdims=True))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.forward(windows[i : i + AT_ONCE])[3] for i in range(0, len(windows), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def train(self, windows: np.ndarray, target: np.ndarray, seed: int = 0) -> None:
        """Adam on the cross-entropy; each language weighs the same."""
        rng = np.random.default_rng(seed)
        weight = 1 / np.maximum(1, np.bincount(target, minlength=len(self.languages)))
        weight = (weight / weight[target].mean()).astype(np.float32)
        names = ["embed", "filters", "bias", "out", "out_bias"]
        m, v, t = ({k: np.zeros_like(getattr(self, k)) for k in names}, {k: np.zeros_like(getattr(self, k)) for k in names}, 0)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                for k, g in self._gradients(windows[pick], target[pick], weight).items():
                    if k == names[0]:
                        t += 1
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    step = RATE / (1 + epoch) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    getattr(self, k)[...] -= step.astype(np.float32)

    def _gradients(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = len(windows), np.arange(len(windows))
        x, y, pooled, log_p = self.forward(windows)
        d = np.exp(log_p)
        d[rows, target] -= 1
        d *= (weight[target] / n)[:, None]
        down = (d @ self.out.T) * (pooled > 0)
        top = y.argmax(1)  # window, filter -> place
        patch = x.reshape(n, -1, x.shape[1])[rows[:, None], top]  # window, filter, input
        filters = np.einsum("nf,nfi->if", down, patch) * self.used
        back = down[:, :, None] * self.filters.T  # window, filter, input
        embed = np.zeros_like(self.embed)
        for j in range(WIDEST):
            np.add.at(embed, windows[rows[:, None], top + j], back[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
        return {"embed": embed, "filters": filters, "bias": down.sum(0), "out": pooled.T @ d, "out_bias": d.sum(0)}


def sample(docs: DataFrame, max_texts: int = MAX_TEXTS, windows_each: int = WINDOWS_EACH) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, the windows' languages) of about max_texts labelled texts of each language outside the held-out fold."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    labelled = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r[0] for r in counts.select("lang").collect())
    if not languages:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    # rows that repeat an id and a text are drawn together, and counted once
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    chosen = labelled.join(F.broadcast(counts), "lang").where(draw < F.lit(float(max_texts)) / F.col("n")).select("doc_id", "lang", "text")

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            windows, text, length = cut(data, offsets)
            n = np.bincount(text, minlength=rows.num_rows)
            first = np.cumsum(n) - n
            # evenly over the text, the rest of a division by id among those that fill a window
            pick = np.unique(np.concatenate([first[t] + (np.arange(min(windows_each, n[t])) * n[t]) // windows_each for t in range(len(n)) if n[t]] or [np.zeros(0, np.int64)]))
            pick = pick[pick < len(windows)]
            pick = pick[(length[pick] >= LEAST) | (n[text[pick]] == 1)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text[pick])), rows.column(1).take(pa.array(text[pick])), pa.array([windows[i].tobytes() for i in pick], pa.binary())], ["doc_id", "lang", "window"])

    taken = chosen.mapInArrow(some, "doc_id bigint, lang string, window binary").distinct().collect()
    taken.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["window"])))
    windows = np.frombuffer(b"".join(r["window"] for r in taken), np.uint8).reshape(-1, WINDOW)
    number = {k: i for i, k in enumerate(languages)}
    return languages, windows, np.array([number[r["lang"]] for r in taken], np.int64)


def learn(docs: DataFrame, max_texts: int = MAX_TEXTS) -> Network | None:
    languages, windows, target = sample(docs, max_texts)
    if not len(windows):
        return None
    network = Network(languages)
    network.train(windows, target)
    return network


def language(docs: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score (the language's share of the text's probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(small_batches(docs), max_texts))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for rows, data, offsets in text_blocks(batches):
            n = rows.num_rows
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if network is not None:
                windows, text, length = cut(data, offsets)
                log_p = network.log_probabilities(windows).astype(np.float64) * (length / WINDOW)[:, None]
                total = np.stack([np.bincount(text, log_p[:, k], n) for k in range(log_p.shape[1])], 1)
                share = np.bincount(text, length / WINDOW, n)
                mean = np.exp(total / np.maximum(share, 1e-9)[:, None])
                mean /= mean.sum(1, keepdims=True)
                best = total.argmax(1)
                for i, x in enumerate(rows.column(2).to_pylist()):
                    if x is not None and LETTER.search(x):
                        names[i], scores[i] = network.languages[best[i]], mean[i, best[i]]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text"))
    return rows.mapInArrow(predict, SCHEMA)
