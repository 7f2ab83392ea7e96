"""Operator 4: n-gram Jaccard self-join with Bayesian pruning of candidates.

1. Texts of one sequence of words are one class; classes, not copies, are compared. A class has HASHES MinHash values of
   its shingles (five words; fewer words are one shingle).
2. Classes that agree in all values of a band are candidates. In each bucket pairs are compared a few MinHash values at
   a time; a pair is dropped once the posterior probability that its similarity reaches the threshold, with a uniform
   prior and the matches seen so far, is below TOLERANCE. What outlives all values ties the bucket's classes together:
   a bucket passes on no pairs, but at most one tie for each of its classes.
3. Tied classes form families. Each family's shingles are brought together once; pairs are pruned in the same way and the
   rest are verified by their exact Jaccard similarity. Each class passes on its number of links, and ties of exact links,
   from which the groups come.

Buckets and families of more than SIDE classes are dealt out as pairs of blocks of at most SIDE classes, each pair of
blocks a task's work, so no task holds more than 2 * SIDE classes. No step caps partners or candidates.

Cases: null and empty texts, and texts without a word, link with nothing; repeated rows are copies; ids may be null;
empty tables give none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import U64, blobs, counts_by_text, mix, partitions, shingles, small_batches, sorted_groups, stored, text_blocks, words
from threadloom.llm.components import components, spanning

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
#: MinHash values that are compared at once, those that are compared in buckets, and the posterior below which a pair is dropped.
STEP, IN_BUCKETS, TOLERANCE = 32, 96, 1e-7
#: Classes on a side of a block of comparisons.
SIDE = 512
NO_ID = -(1 << 63)
_KEYS = np.random.default_rng(11).integers(1, 1 << 32, (2, HASHES), dtype=np.uint32) | np.uint32(1)
CLASS_SCHEMA = "k bigint, th bigint, doc_id bigint, c1 bigint, c2 bigint, n_words bigint, signature binary"


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches below which P(similarity >= threshold | matches) < tolerance), after each step.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def signatures(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """MinHash values of texts with shingles, of each its low 16 bits: equal values stay equal, so no match is lost."""
    out = np.full((n, HASHES), np.uint16(0xFFFF))
    if not len(hashes):
        return out
    h = (hashes >> U64(32)).astype(np.uint32)
    with_any, first = np.unique(text, return_index=True)
    for i in range(HASHES):
        out[with_any, i] = (np.minimum.reduceat((h ^ _KEYS[0, i]) * _KEYS[1, i], first) & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def survivors(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that the posterior doesn't drop; of a block with itself each pair once."""
    first = (a[:, None, :STEP] == b[None, :, :STEP]).sum(2, dtype=np.uint8) if len(a) * len(b) <= 4096 else np.concatenate([(a[i : i + 16, None, :STEP] == b[None, :, :STEP]).sum(2, dtype=np.uint8) for i in range(0, len(a), 16)])
    ok = first >= limits[0][1]
    if same:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    i, j = np.nonzero(ok)
    matches = first[i, j].astype(np.int64)
    for n, least in limits[1 : a.shape[1] // STEP]:
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 65536):
            x, y = i[s : s + 65536], j[s : s + 65536]
            matches[s : s + 65536] += (a[x, n - STEP : n] == b[y, n - STEP : n]).sum(1)
            keep[s : s + 65536] = matches[s : s + 65536] >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def keys_of_rows() -> tuple[Column, Column]:
    """What tells rows apart: the id, never null, and the text's hash."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per document: its class (128 bits of its words' sequence; 0 without words) and its signature."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            n = rows.num_rows
            _, _, text, hashes = words(data, offsets)
            count = counts_by_text(text, n)
            of, grams = shingles(text, hashes, n, width)
            sig = signatures(of, grams, n)
            step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            some = count > 0
            first = (np.cumsum(count) - count)[some]
            keys = np.zeros((2, n), np.uint64)
            for k, salt in enumerate((0x51, 0xA7)):
                if some.any():
                    keys[k, some] = mix(np.add.reduceat(mix(hashes ^ mix(step.astype(np.uint64) + U64(salt))), first))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], *(pa.array(x.view(np.int64)) for x in keys), pa.array(count, pa.int64()), blobs(list(sig))], ["k", "th", "doc_id", "c1", "c2", "n_words", "signature"])

    return docs.select(*keys_of_rows(), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sign, CLASS_SCHEMA)


def dealt(groups: DataFrame, key: list[str], size: str, columns: list[str]) -> DataFrame:
    """Rows of groups of known size, one for each pair of blocks (x, y) that needs them, sorted by group and pair."""
    blocks = F.ceil(F.col(size) / SIDE).cast("int")
    rows = groups.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*columns, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    return rows.repartition(partitions(groups.sparkSession), *key, "x", "y").sortWithinPartitions(*key, "x", "y", "c")


def matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def tied(buckets: DataFrame, threshold: float) -> DataFrame:
    """Ties (a, b) among the classes of each bucket that outlive the pruning, at most one for each class."""
    limits = least_matches(threshold, TOLERANCE)

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in sorted_groups(batches, ["bucket", "x", "y"]):
            if group.num_rows < 2:
                continue
            c, own = group["c"].to_numpy(), group["own"].to_numpy()
            sig = matrix(group["signature"], np.uint16, IN_BUCKETS)
            same = group["x"][0].as_py() == group["y"][0].as_py()
            a = np.arange(len(c)) if same else np.flatnonzero(own == group["x"][0].as_py())
            b = a if same else np.flatnonzero(own != group["x"][0].as_py())
            i, j = survivors(sig[a], sig[b], limits, same)
            out += [(int(c[p]), int(c[q])) for p, q in spanning(len(c), list(zip(a[i].tolist(), b[j].tolist(), strict=True)))]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return buckets.mapInArrow(prune, "a bigint, b bigint")


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets (i, j)."""
    if len(i) < 4:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # incidence matrices over the shingles of more than one set, a slice of shingles at a time
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(64, (1 << 21) // len(sets))
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s = slice(*np.searchsorted(column, [low, low + width]))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[s], column[s] - low] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def verified(families: DataFrame, threshold: float) -> DataFrame:
    """(c, links, tie): of each class, links to other classes with their copies, a part for each block; and exact ties."""
    limits = least_matches(threshold, TOLERANCE)

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["family", "x", "y"]):
            if group.num_rows < 2:
                continue
            c, own, copies = group["c"].to_numpy(), group["own"].to_numpy(), group["copies"].to_numpy()
            sig = matrix(group["signature"], np.uint16, HASHES)
            sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
            same = group["x"][0].as_py() == group["y"][0].as_py()
            a = np.arange(len(c)) if same else np.flatnonzero(own == group["x"][0].as_py())
            b = a if same else np.flatnonzero(own != group["x"][0].as_py())
            i, j = survivors(sig[a], sig[b], limits, same)
            i, j = a[i], b[j]
            sizes = np.array([len(s) for s in sets])
            inter = intersections(sets, i, j)
            ok = inter >= threshold * (sizes[i] + sizes[j] - inter) - 1e-9
            i, j = i[ok], j[ok]
            links = np.bincount(i, copies[j], len(c)) + np.bincount(j, copies[i], len(c))
            least = np.arange(len(c))
            for p, q in spanning(len(c), list(zip(i.tolist(), j.tolist(), strict=True))):
                least[q] = p
            hit = np.flatnonzero(links > 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(links[hit].astype(np.int64)), pa.array(c[least[hit]])], ["c", "links", "tie"])

    return families.mapInArrow(verify, "c bigint, links bigint, tie bigint")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """The sorted set of shingles of each of the texts (c, text)."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            n = rows.num_rows
            _, _, text, hashes = words(data, offsets)
            of, grams = shingles(text, hashes, n, width)
            cuts = np.searchsorted(of, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([rows.column(0), blobs([np.unique(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])], ["c", "shingles"])

    return texts.select("c", "text").mapInArrow(sets, "c bigint, shingles binary")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """A row per document: doc_id, class_id (smallest doc_id of equal words), n_copies, n_links (other documents of at
    least the similarity, copies included), component_id (smallest doc_id that links reach), kept (it is the smallest itself), text_hash (tells rows of one id apart)."""
    signed = stored(classes(small_batches(docs), width), "classes")
    kinds = signed.where("n_words > 0").groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("k", "th")).alias("row"), F.first("signature").alias("signature"))
    kinds = stored(kinds.select(F.xxhash64("c1", "c2").alias("c"), "c1", "c2", "copies", "row.k", "row.th", "signature"), "kinds")
    size = 2 * ROWS
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("signature", b * size + 1, size)) for b in range(BANDS)))
    buckets = kinds.select("c", F.explode(bands).alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    candidates = buckets.join(crowded, "bucket").join(kinds.select("c", F.substring("signature", 1, 2 * IN_BUCKETS).alias("signature")), "c")
    ties = tied(dealt(candidates, ["bucket"], "n", ["bucket", "c", "signature"]), threshold)
    family_of = stored(components(ties).select(F.col("node").alias("c"), F.col("component").alias("family")), "families")
    # each class in a family brings the text of one of its documents
    members = family_of.join(kinds, "c")
    # rows that repeat a document bring its text once
    texts = docs.select(*keys_of_rows(), "text").join(members.select("k", "th", "c"), ["k", "th"]).groupBy("c").agg(F.first("text").alias("text"))
    sizes = family_of.groupBy("family").agg(F.count("*").alias("n"))
    sets = shingle_sets(texts, width)
    rows = members.select("c", "family", "copies", "signature").join(sizes, "family").join(sets, "c")
    links = stored(verified(dealt(rows, ["family"], "n", ["family", "c", "copies", "signature", "shingles"]), threshold), "links")
    per_class = links.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("c").alias("a"), F.col("tie").alias("b")))
    joined = kinds.select("c1", "c2", "c", "copies", "k").join(per_class, "c", "left").join(groups.select(F.col("node").alias("c"), "component"), "c", "left")
    joined = joined.withColumn("component", F.coalesce("component", "c"))
    least = joined.groupBy("component").agg(F.min("k").alias("least"))
    joined = joined.join(least, "component").select("c1", "c2", F.col("k").alias("class_k"), "copies", "links", "least")
    out = signed.select("doc_id", "th", "c1", "c2", "n_words").join(joined, ["c1", "c2"], "left")
    alone = F.col("n_words") == 0
    visible = lambda x: F.when(x != NO_ID, x)
    component = F.when(alone, F.col("doc_id")).otherwise(visible(F.col("least")))
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(visible(F.col("class_k"))).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("th").alias("text_hash"),
    )


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The documents, all their columns, that are the smallest of their groups; of repeated rows one.

    Cases as above; texts without words stay; an empty table stays empty; columns may have any names.
    """
    kept = jaccard_join(docs, threshold, width).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.col("text_hash").alias("th")).distinct()
    rows = docs.select(F.struct("*").alias("row"), *keys_of_rows())
    return rows.join(kept, ["k", "th"], "left_semi").dropDuplicates(["k", "th"]).select("row.*")
