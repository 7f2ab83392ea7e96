"""Operator 1: removal of passages of LENGTH bytes that start more than once, by distributed prefix doubling.

Rank equality of suffixes is all that removal needs, so ranks are fingerprints of what the suffixes begin with, and
only positions that can still be repeated stay in play:

1. Of the first START bytes of suffixes, ranks are taken at sampled positions: a string of LENGTH bytes owns the position
   with the least rank inside it. Equal strings own equal positions, so positions whose rank is unique in the corpus
   speak for strings that are unique, and are dropped. About one position in 76 is sampled.
2. A sampled position speaks for a run of string starts. If all the bytes that these strings span stand elsewhere around
   the same rank, every one of them is repeated; nothing finer is sorted. So copies are never expanded.
3. What is left, runs of which some strings may be repeated, are brought together by rank. Their suffixes are ranked at
   2 * START by pairs of ranks START apart, unique ones are dropped, and so on, doubling, until LENGTH is reached.

A rank that a large part of the documents share is split: its runs are dealt over several tasks by a salt, each task
passes on one row for each distinct string it saw, and these are counted in a last aggregation.

Cases: null is the empty text; texts shorter than LENGTH keep all their bytes; rows that repeat a document are copies of
each other; strings are judged on the input, within and across documents; an empty table gives none; null ids stay null;
other columns are not read. A text of any length is ranked in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import U64, mix, partitions, prefix_sums, small_batches, span_hash, spread_join, stored, text_blocks

LENGTH, START = 200, 50
#: Bytes of a text that are ranked at once.
PIECE = 4 << 20
PLACE = U64((1 << 24) - 1)
#: Runs of one rank that a task takes; a rank with more is dealt over several.
RUNS = 20_000
NO_ID = -(1 << 63)
ANCHOR_SCHEMA = "k bigint, th bigint, rank bigint, around bigint, lo bigint, hi bigint"
RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, start: int) -> tuple[np.ndarray, ...]:
    """Of each position that strings of `length` own: (text number, first and last string start, rank, fingerprint of all that they span)."""
    wide, n = length - start + 1, len(data) - start + 1
    sizes = np.diff(offsets)
    if n < wide:
        return (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2)
    sums = prefix_sums(data)
    rank = span_hash(sums, np.arange(n), np.arange(n) + start)
    key = (rank & ~PLACE) | np.arange(n, dtype=np.uint64)  # of equal ranks the first
    grid = np.full(-(-n // wide) * wide, ~U64(0), np.uint64)
    grid[:n] = key
    grid = grid.reshape(-1, wide)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    p = offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.minimum(right[p], left[p + wide - 1]) & PLACE).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p))[: len(first)] - 1
    at, lo, hi = at[first], p[first], p[last]
    around = mix(span_hash(sums, lo, hi + length) ^ ((at - lo) * 4096 + (hi - at + length)).astype(np.uint64))
    return text[first], lo, hi, rank[at], around


def pieces(blocks: Iterable[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Blocks, a long text in pieces that overlap by length - 1 bytes: (rows, bytes before the piece, bytes, offsets)."""
    for rows, data, offsets in blocks:
        if len(data) <= PIECE:
            yield rows, 0, data, offsets
            continue
        for begin in range(0, max(1, len(data) - length + 1), PIECE):
            piece = data[begin : begin + PIECE + length - 1]
            yield rows, begin, piece, np.array([0, len(piece)])


def anchors(docs: DataFrame, length: int, start: int) -> DataFrame:
    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, before, data, offsets in pieces(text_blocks(batches), length):
            text, lo, hi, ranks, around = sampled(data, offsets, length, start)
            base = offsets[text] - before
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(ranks.view(np.int64)), pa.array(around.view(np.int64)), pa.array(lo - base), pa.array(hi - base)], ["k", "th", "rank", "around", "lo", "hi"])

    return docs.where(F.octet_length("text") >= length).select("k", "th", "text").mapInArrow(ranked, ANCHOR_SCHEMA)


def doubled(data: np.ndarray, p: np.ndarray, length: int, start: int) -> np.ndarray:
    """Which of the positions begin a string of `length` bytes that begins at another of them, too."""
    sums = prefix_sums(data)
    size, alive = start, np.arange(len(p))

    def rank_of(q: np.ndarray, size: int) -> np.ndarray:
        return span_hash(sums, q, q + size)

    while len(alive):
        size = min(2 * size, length)  # the last pair overlaps if length is no power of two times start
        half = size - size // 2
        pair = mix(rank_of(p[alive], half) * U64(0x9E3779B97F4A7C15) ^ rank_of(p[alive] + size - half, half))
        _, where, count = np.unique(pair, return_inverse=True, return_counts=True)
        alive = alive[count[where] > 1]
        if size == length:
            break
    out = np.zeros(len(p), bool)
    out[alive] = True
    return out


def runs_of(mask: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (last place included) of stretches of mask within runs."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]]))
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


def refined(runs: DataFrame, length: int, start: int) -> DataFrame:
    """Sorted runs (rank, salt, k, th, lo, hi, known, split, bytes) -> spans (k, th, lo, hi), and strings (s, t) of split ranks that are yet to be counted."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {c: table[c].to_numpy() for c in ("k", "th", "lo", "hi", "known", "split")}
        whole = table["bytes"].combine_chunks()
        whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
        raw = whole.cast(pa.large_binary()).buffers()
        data_at = np.frombuffer(raw[1], np.int64)[: len(whole) + 1]
        data = np.frombuffer(raw[2], np.uint8)
        count = column["hi"] - column["lo"] + 1
        run = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        p = data_at[run] + step
        repeated = doubled(data, p, length, start)
        a, b = runs_of(repeated & ~column["known"][run], run)
        r = run[a]
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(column["k"][r]), pa.array(column["th"][r]), pa.array(column["lo"][r] + step[a]), pa.array(column["lo"][r] + step[b]), none, none, pa.array(np.zeros(len(a), bool))], ["k", "th", "lo", "hi", "s", "t", "seen"])
        if column["split"].any():
            at = np.flatnonzero(column["split"][run])
            sums = prefix_sums(data)
            s, t = span_hash(sums, p[at], p[at] + length), mix(span_hash(sums, p[at] + 1, p[at] + length) ^ U64(length))
            # a repeated or known string is told once; an open one is its task's only
            settled = repeated[at] | column["known"][run[at]]
            _, first = np.unique(s, return_index=True)
            keep = np.zeros(len(at), bool)
            keep[first] = True
            at, s, t, settled = at[keep], s[keep], t[keep], settled[keep]
            r = run[at]
            yield pa.RecordBatch.from_arrays([pa.array(column["k"][r]), pa.array(column["th"][r]), pa.array(column["lo"][r] + step[at]), pa.array(column["lo"][r] + step[at]), pa.array(s.view(np.int64)), pa.array(t.view(np.int64)), pa.array(settled)], ["k", "th", "lo", "hi", "s", "t", "seen"])

    def refine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            ranks = batch.column(0).to_numpy()
            salts = batch.column(1).to_numpy()
            ends = np.flatnonzero((ranks[1:] != ranks[:-1]) | (salts[1:] != salts[:-1])) + 1
            begin = 0
            if held and size >= RUNS:
                last = held[-1]
                if batch.num_rows and (last.column(0)[-1].as_py(), last.column(1)[-1].as_py()) != (int(ranks[0]), int(salts[0])):
                    yield from work(pa.Table.from_batches(held))
                    held, size = [], 0
            while size + batch.num_rows - begin >= RUNS:
                # at the first end of a rank after enough runs
                i = np.searchsorted(ends, begin + max(1, RUNS - size))
                if i == len(ends):
                    break
                held.append(batch.slice(begin, int(ends[i]) - begin))
                yield from work(pa.Table.from_batches(held))
                held, size, begin = [], 0, int(ends[i])
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                size += batch.num_rows - begin
        if held:
            yield from work(pa.Table.from_batches(held))

    return runs.mapInArrow(refine, "k bigint, th bigint, lo bigint, hi bigint, s bigint, t bigint, seen boolean")


def context(docs: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """The runs with the bytes that their strings span, brought together by rank."""
    schema = "rank bigint, salt bigint, k bigint, th bigint, lo bigint, hi bigint, known boolean, split boolean, bytes binary"

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            runs = rows.column(3)
            size = pa.compute.list_value_length(runs).to_numpy()
            flat = runs.flatten()
            get = {c: flat.field(c) for c in ("rank", "salt", "lo", "hi", "known", "split")}
            text = np.repeat(np.arange(len(size)), size)
            lo, hi = get["lo"].to_numpy() + offsets[text], get["hi"].to_numpy() + offsets[text] + length
            take = pa.array(text)
            view = memoryview(np.ascontiguousarray(data))
            yield pa.RecordBatch.from_arrays([get["rank"], get["salt"], rows.column(0).take(take), rows.column(1).take(take), get["lo"], get["hi"], get["known"], get["split"], pa.array([view[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], ["rank", "salt", "k", "th", "lo", "hi", "known", "split", "bytes"])

    lists = open_runs.groupBy("k", "th").agg(F.collect_set(F.struct("rank", "salt", "lo", "hi", "known", "split")).alias("runs"))
    # doc_id comes along only so that this join and the last one read one and the same shuffle of the texts
    out = docs.join(lists, ["k", "th"]).select("k", "th", "text", "runs", "doc_id").mapInArrow(slices, schema)
    return out.repartition(partitions(docs.sparkSession), "rank", "salt").sortWithinPartitions("rank", "salt")


def spans(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """Spans of string starts (k, th, lo, hi) of all repeated strings."""
    # written once, as ranking takes the most time of all
    found = stored(anchors(docs, length, start), "anchors")
    row: Column = F.xxhash64("k", "th", "lo")
    # ranks that occur once are dropped here, before anything else moves
    ranks = found.groupBy("rank").agg(F.count("*").alias("n"), (F.min("around") != F.max("around")).alias("differ")).where("n > 1")
    ranks = stored(ranks.withColumn("n_rank", F.col("n")), "repeated")
    total = ranks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = stored(spread_join(found, ranks, ["rank"], total), "ranks")
    # where the same surroundings stand around each of a rank's places, all its strings are repeated
    alike = placed.where("not differ").select("k", "th", "lo", "hi")
    mixed = placed.where("differ").select("k", "th", "rank", "around", "lo", "hi", "n_rank")
    kinds = mixed.groupBy("rank", "around").agg(F.count("*").alias("n"), F.max(row).alias("chosen"))
    mixed = stored(spread_join(mixed, kinds.withColumn("n_kind", F.col("n")), ["rank", "around"], total).withColumnRenamed("n_kind", "n").drop("around"), "runs")
    copies = alike.union(mixed.where("n > 1").select("k", "th", "lo", "hi"))
    # of surroundings that occur more than once, one run stands for all
    salt = F.pmod(F.xxhash64(F.lit("salt"), "k", "th", "lo"), F.ceil(F.col("n_rank") / RUNS))
    open_runs = mixed.where((F.col("n") == 1) | (row == F.col("chosen")))
    open_runs = open_runs.select("k", "th", "rank", salt.alias("salt"), "lo", "hi", (F.col("n") > 1).alias("known"), (F.col("n_rank") > RUNS).alias("split"))
    told = refined(context(docs, open_runs, length), length, start)
    settled = told.where("s is null").select("k", "th", "lo", "hi")
    rest = told.where("s is not null")
    counted = rest.groupBy("s", "t").agg(F.count("*").alias("tasks")).where("tasks > 1")
    late = rest.where("not seen").join(counted, ["s", "t"]).select("k", "th", "lo", "hi")
    return copies.unionByName(settled).unionByName(late)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with keys that are never null and tell different texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("th"))


def kept_bytes(batches: Iterable[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches):
        lists = rows.column(2).to_pylist()
        view = memoryview(np.ascontiguousarray(data))
        out: list[tuple] = []
        for i, runs in enumerate(lists):
            text = view[offsets[i] : offsets[i + 1]]
            removed, n_spans, kept, end = 0, 0, [], 0
            for lo, hi in sorted((r["lo"], r["hi"] + length) for r in runs or ()):
                if lo > end or not n_spans:
                    kept.append(text[end:lo])
                    n_spans += 1
                    removed += hi - lo
                    end = hi
                elif hi > end:
                    removed += hi - end
                    end = hi
            kept.append(text[end:])
            rest = b"".join(kept)
            out.append((len(text), removed, n_spans, rest if texts else hashlib.sha256(rest).hexdigest()))
        columns = list(zip(*out, strict=True))
        last = pa.array([x.decode("utf-8", "replace") for x in columns[3]] if texts else columns[3], pa.string())
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), last], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text" if texts else "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, start: int = START, texts: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, and kept_sha256, or kept_text if `texts`.

    In kept_text what a removal left of a split character is replaced; kept_sha256 is of the very bytes.
    """
    docs = keyed(small_batches(docs))
    lists = spans(docs, length, start).groupBy("k", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    rows = docs.join(lists, ["k", "th"], "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(lambda b: kept_bytes(b, length, texts), RESULT_SCHEMA if not texts else RESULT_SCHEMA.replace("kept_sha256", "kept_text"))
