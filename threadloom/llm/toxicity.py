"""Operator 2: toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled documents. A text's terms are the runs of four and of six bytes inside its
lower-cased words, an edge of a word counting as a byte, so that unseen forms of a word share terms with seen ones; a term
that a text repeats makes further terms, as a vector's length would hide how often it occurs. All terms that tell the
labels apart with significance (chi-squared over the sample) make the vocabulary, as many as they are; their document frequencies come from all documents. Examples are TF-IDF vectors in a block-max inverted
index: postings by word, in blocks of examples, with each block's largest weight. A text's K nearest examples
by exact cosine are found by reading blocks from the highest upper bound down, until no block left can hold a nearer one.
Votes weighted by distance, drawn to the labels' prior, give the score; a monotone map fitted on the examples, each
scored without itself, calibrates it. The voting examples are the evidence.

Cases: null and empty texts, and texts without any word of the vocabulary, get the calibrated prior of such examples;
without labelled examples every score is 0; null labels and null ids are no examples; an id labelled twice counts as
toxic if any label says so; repeated documents get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import LOWERED_WORD, collected, fold, small_batches, text_blocks

#: The bound of what the classifier learns from: labelled documents.
MAX_EXAMPLES = 4096
#: A term's chi-squared must reach this: one chance in ten thousand that it does by luck.
LEAST_CHI2 = 15.0
K = 8
BLOCK = 64
#: A vote's weight is 1 / (distance + SOFT) ** 2; the prior has PRIOR votes at distance 1.
SOFT, PRIOR = 0.05, 1.0
EVIDENCE = 3
#: Counts from which a term's repetition is a term of its own.
REPEATS = (2, 3, 5)
LONG = np.uint64(1 << 60)
#: Term vectors whose scores a task remembers.
REMEMBERED = 5_000
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of each run of four and of six bytes in each text."""
    n = len(offsets) - 1
    # a byte 0 stands for each byte outside words, and six of them part the texts
    spaced = np.zeros(len(data) + 6 * n + 6, np.uint8)
    own = np.repeat(6 * np.arange(n) + 1, np.diff(offsets))
    spaced[np.arange(len(data)) + own] = LOWERED_WORD[data]
    inside = spaced != 0
    inside = inside[:-1] & inside[1:]
    two = spaced.astype(np.uint64)
    two = (two[:-1] << np.uint64(8)) | two[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    bounds = offsets + 6 * np.arange(n + 1)
    short = np.flatnonzero(inside[1:-1])
    long = short[: np.searchsorted(short, len(spaced) - 6, "right")]
    long = long[inside[long + 3]]
    term = np.concatenate([four[short], LONG | (four[long] << np.uint64(16)) | two[long + 4]])
    return np.searchsorted(bounds, np.concatenate([short, long]), "right") - 1, term


def counted(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, how often) sorted by text and term."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(first)
    return text[at], term[at], np.diff(np.append(at, len(text)))


def with_repeats(text: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counted terms, and for each level of REPEATS that a count reaches a term of its own, once; sorted by text and term."""
    parts = [(text, term, times)]
    for level, least in enumerate(REPEATS, 1):
        often = times >= least
        parts.append((text[often], term[often] | np.uint64(level << 56), np.ones(np.count_nonzero(often), np.int64)))
    text, term, times = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((term, text))
    return text[order], term[order], times[order]


def example_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches):
        text, hashes = terms(data, offsets)
        of, word, times = with_repeats(*counted(text, hashes))
        # a row for a text without words, too
        none = np.setdiff1d(np.arange(rows.num_rows), of)
        of, word, times = np.concatenate([of, none]), np.concatenate([word.view(np.int64), np.zeros(len(none), np.int64)]), np.concatenate([times, np.zeros(len(none), np.int64)])
        take = pa.array(of)
        yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(word), pa.array(times, pa.int32())], ["doc_id", "toxic", "word", "times"])


def examples(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """At most `limit` labelled documents outside the held-out fold, chosen by a hash of their ids: doc_id, toxic, word, times."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = chosen.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # some more ids than the bound, as some may have no document
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(limit + limit // 4)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return texts.select("doc_id", "toxic", "text").mapInArrow(example_terms, "doc_id bigint, toxic int, word bigint, times int")


class Index:
    """A block-max inverted index of unit vectors; rows: (word's number, weight) by example, as CSR."""

    def __init__(self, starts: np.ndarray, word: np.ndarray, weight: np.ndarray, n_words: int) -> None:
        n = len(starts) - 1
        self.n, self.n_blocks = n, -(-n // BLOCK)
        example = np.repeat(np.arange(n), np.diff(starts))
        block = example // BLOCK
        order = np.lexsort((example, word))
        self.example, self.weight = example[order], weight[order]
        self.largest = np.zeros((n_words, self.n_blocks))
        np.maximum.at(self.largest, (word, block), weight)
        # postings of word w in block b: [at[w, b], at[w, b + 1])
        count = np.zeros((n_words, self.n_blocks), np.int64)
        np.add.at(count, (word, block), 1)
        total = np.concatenate([[0], np.cumsum(count.ravel())])
        self.at = total[:-1].reshape(n_words, self.n_blocks)
        self.end = total[1:].reshape(n_words, self.n_blocks)

    def nearest(self, word: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosines over 0, of equal ones the first: (example, cosine)."""
        bound = weight @ self.largest[word]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        best_i, best_s, worst, at_once = np.zeros(0, np.int64), np.zeros(0), 0.0, 2
        while len(order):
            # some of the blocks of the highest bounds together, then twice as many
            blocks, order, at_once = order[:at_once], order[at_once:], 2 * at_once
            if len(best_i) == k:
                blocks = blocks[bound[blocks] >= worst - 1e-12]
                if not len(blocks):
                    break
            start, end = self.at[word[:, None], blocks], self.end[word[:, None], blocks]
            count = (end - start).ravel()
            base = np.cumsum(count) - count
            posting = np.repeat(start.ravel() - base, count) + np.arange(base[-1] + count[-1])
            score = np.bincount(self.example[posting], np.repeat(weight, (end - start).sum(1)) * self.weight[posting], self.n)
            score = np.round(score, 12)
            if without >= 0:
                score[without] = 0.0
            hit = np.flatnonzero(score > max(0.0, worst - 1e-12 if len(best_i) == k else 0.0))
            if not len(hit):
                continue
            best_i, best_s = np.concatenate([best_i, hit]), np.concatenate([best_s, score[hit]])
            if len(best_i) > k:
                top = np.lexsort((best_i, -best_s))[:k]
                best_i, best_s = best_i[top], best_s[top]
            if len(best_i) == k:
                worst = best_s.min()
        top = np.lexsort((best_i, -best_s))
        return best_i[top], best_s[top]


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to y (pool adjacent violators), joined by lines."""
    at, inverse = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []
    for i, (s, n) in enumerate(zip(np.bincount(inverse, y), np.bincount(inverse), strict=True)):
        blocks.append([s, n, i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2], last]
    xs = [at[int(i)] for b in blocks for i in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(xs), np.array(ys)


class Model:
    """The examples' index with all that scoring needs; built on the driver from the bounded sample."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, idf: np.ndarray) -> None:
        self.vocabulary, self.idf = vocabulary, idf
        # alike examples into one block: by their words, then by label
        order = sorted(range(len(ids)), key=lambda i: (rows[i][0].tolist(), int(toxic[i]), int(ids[i])))
        self.ids, self.toxic = ids[order], toxic[order]
        vectors = [self.vector(*rows[i]) for i in order]
        starts = np.cumsum([0, *(len(w) for w, _ in vectors)])
        self.index = Index(starts, np.concatenate([np.zeros(0, np.int64), *(w for w, _ in vectors)]), np.concatenate([np.zeros(0), *(v for _, v in vectors)]), len(vocabulary))
        self.prior = (toxic.sum() + 0.5) / (len(toxic) + 1)
        empty = np.diff(starts) == 0
        self.bare = (self.toxic[empty].sum() + self.prior) / (empty.sum() + 1)
        raw = np.array([self.vote(*vectors[i], without=i)[0] for i in range(len(vectors))])
        self.xs, self.ys = monotone(raw[~empty], self.toxic[~empty]) if (~empty).any() else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.ys = np.clip(self.ys, 0.5 / (len(ids) + 1), 1 - 0.5 / (len(ids) + 1))

    def vector(self, word: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(times)) * self.idf[word]
        size = np.sqrt(weight @ weight)
        return (word, weight / size) if size > 0 else (word[:0], weight[:0])

    def vote(self, word: np.ndarray, weight: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(word):
            return self.bare, word, weight
        who, cosine = self.index.nearest(word, weight, K, without)
        vote = 1 / (1 - cosine + SOFT) ** 2
        prior = PRIOR / (1 + SOFT) ** 2
        return float((vote @ self.toxic[who] + prior * self.prior) / (vote.sum() + prior)), who, cosine

    def score(self, word: np.ndarray, times: np.ndarray) -> tuple[float, list[dict]]:
        word, weight = self.vector(word, times)
        raw, who, cosine = self.vote(word, weight)
        score = float(np.interp(raw, self.xs, self.ys)) if len(word) else float(raw)
        return score, [{"doc_id": int(self.ids[i]), "toxic": int(self.toxic[i]), "cosine": float(c)} for i, c in zip(who[:EVIDENCE], cosine[:EVIDENCE], strict=True)]


def bucket(term: np.ndarray) -> np.ndarray:
    return ((term * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def known_terms(vocabulary: np.ndarray, text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term's number in the sorted vocabulary, how often)."""
    plain = np.unique(vocabulary & ~np.uint64(0xF << 56))
    few = np.zeros(1 << 16, bool)
    few[bucket(plain)] = True
    maybe = np.flatnonzero(few[bucket(term)])
    text, term, times = with_repeats(*counted(text[maybe], term[maybe]))
    at = np.minimum(np.searchsorted(vocabulary, term), max(0, len(vocabulary) - 1))
    same = vocabulary[at] == term if len(vocabulary) else np.zeros(0, bool)
    return text[same], at[same], times[same]


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all documents hold each word, and how many documents there are."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for rows, data, offsets in text_blocks(batches):
            text, hashes = terms(data, offsets)
            total += np.bincount(known_terms(vocabulary, text, hashes)[1], minlength=len(vocabulary))
            n += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary)), pa.int64()), pa.array(np.concatenate([[n], total]), pa.int64())], ["word", "n"])

    sums = {r[0]: r[1] for r in docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(len(vocabulary))], np.int64), sums.get(-1, 0)


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> Model | None:
    """The model; None without an example. The driver holds the bounded sample's significant terms only."""
    sample = examples(small_batches(docs), labels, limit).persist()
    rows = sample.where("times = 0").select("doc_id", "toxic").union(sample.where("times > 0").select("doc_id", "toxic")).distinct()
    ids = {r[0]: r[1] for r in rows.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(limit).collect()}
    if not ids:
        sample.unpersist()
        return None
    n, positive = len(ids), sum(ids.values())
    per_word = sample.where("times > 0").groupBy("word").agg(F.count_distinct("doc_id").alias("n"), F.count_distinct(F.when(F.col("toxic") > 0, F.col("doc_id"))).alias("p"))
    a, b = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    chi2 = F.lit(float(n)) * F.pow(a * (n - positive - b) - b * (positive - a), 2) / (F.col("n") * (F.lit(float(n)) - F.col("n")) * (positive * (n - positive)))
    best = per_word.where((F.col("n") >= 3) & (F.col("n") < n)).withColumn("chi2", chi2) if 0 < positive < n else per_word.where("false").withColumn("chi2", F.lit(0.0))
    # as Arrow tables: rows as Python objects take many times their size
    chosen = best.where(F.col("chi2") >= LEAST_CHI2).select("word").toArrow()
    vocabulary = np.sort(chosen["word"].to_numpy().view(np.uint64))
    chosen = sample.sparkSession.createDataFrame(chosen)
    spread = sample.where("times > 0").join(F.broadcast(chosen), "word").select("doc_id", "word", "times").distinct().toArrow()
    sample.unpersist()
    numbers = np.array(sorted(ids), np.int64)
    doc, word, times = spread["doc_id"].to_numpy(), spread["word"].to_numpy().view(np.uint64), spread["times"].to_numpy()
    at = np.minimum(np.searchsorted(numbers, doc), len(numbers) - 1)
    known = numbers[at] == doc
    at, word, times = at[known], np.searchsorted(vocabulary, word[known]), times[known]
    # of a repeated id's texts the one that repeats a term most
    by = np.lexsort((word, at))
    at, word, times = at[by], word[by], times[by]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (word[1:] != word[:-1])])[: len(at)])
    times = np.maximum.reduceat(times, first).astype(np.float64) if len(first) else np.zeros(0)
    at, word = at[first], word[first]
    cuts = np.searchsorted(at, np.arange(len(numbers) + 1))
    df, total = document_frequencies(docs, vocabulary)
    collected(sample.sparkSession)
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    vectors = [(word[a:b].astype(np.int64), times[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return Model(numbers, np.array([ids[i] for i in numbers.tolist()], np.int64), vectors, vocabulary, idf)


class Scorer:
    """Scores blocks of texts; equal terms are scored once."""

    def __init__(self, model: Model | None) -> None:
        self.model, self.memory = model, {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[float, list[dict]]]:
        n = len(offsets) - 1
        if self.model is None:
            return [(0.0, [])] * n
        of, word, times = known_terms(self.model.vocabulary, *terms(data, offsets))
        first = np.searchsorted(of, np.arange(n + 1))
        out = []
        for i in range(n):
            span = slice(first[i], first[i + 1])
            key = word[span].tobytes() + times[span].tobytes()
            if key not in self.memory:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[key] = self.model.score(word[span], times[span])
            out.append(self.memory[key])
        return out


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, limit))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for rows, data, offsets in text_blocks(batches):
            found = scorer(data, offsets)
            scores = np.array([s for s, _ in found])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([e for _, e in found], kind)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text"))
    return rows.mapInArrow(score, SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """The documents, all their columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, limit))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for rows, data, offsets in text_blocks(batches):
            yield rows.filter(pa.array([s < 0.5 for s, _ in scorer(data, offsets)]))

    return docs.mapInArrow(keep, docs.schema)
