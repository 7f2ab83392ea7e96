"""Operator 9: embedding near-duplicates by Euclidean p-stable hashing.

1. Vectors are normalised; equal ones of one label are one class. Each of several tables hashes a class to the quantised
   values of random projections. Projections are as many as leave a bucket about COMPANY strangers, whatever the label's
   size; tables are as many as miss a pair at the threshold at most with probability MISS. No bound stands above either.
2. Through the shuffle goes, for each class and table, the bucket, the class and a sketch of 128 signs of projections.
   Classes of one bucket whose sketches differ in more signs than pairs at the threshold ever do (chance STRAY) are no
   candidates. A bucket passes on no pairs, only one tie for each class that outlives this, and ties make families.
3. A family's vectors are fetched once. All its pairs are checked by their exact cosines in double precision; each class
   passes on its number of links, and ties of exact links, from which the components come.

Buckets and families of more than SIDE classes are dealt out as pairs of blocks, so no task holds more than 2 * SIDE of
them and nothing is capped.

Cases: null or zero vectors, vectors with null or non-finite components, and rows with a null label link with nothing;
equal vectors link; vectors of different lengths never link; rows that repeat a vec_id are vectors of their own that share
it; ids are whole numbers, labels of any type; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from threadloom.llm.common import U64, Forest, blobs, chunks, group_numbers, mix, partitions, stored
from threadloom.llm.components import components

THRESHOLD, MISS, STRAY = 0.93, 0.02, 1e-6
#: Width of a quantised cell of a projection; unit vectors' projections have standard deviation 1.
WIDTH = 2.0
#: Strangers that a bucket may hold: their sketches are compared, their vectors stay where they are.
COMPANY = 64
SIGNS = 128
SIDE = 4096
#: Rows that a task compares at once; families up to SMALL pair by pair, larger ones by products of matrices.
AT_ONCE, SMALL, SLICE = 1 << 16, 48, 512
SEED = 20240907


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees (Datar et al. 2004)."""
    r = width / distance
    upper = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * upper - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections of a table, tables) for labels of at most n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n / COMPANY, 1)) / math.log(1 / far)))
    return k, max(1, math.ceil(math.log(MISS) / math.log(1 - near**k)))


def most_signs(threshold: float = THRESHOLD) -> int:
    """Signs in which a pair at the threshold differs at most, but for a chance of STRAY."""
    p, tail, m = math.acos(threshold) / math.pi, 1.0, -1
    while tail > STRAY:
        m += 1
        tail -= math.comb(SIGNS, m) * p**m * (1 - p) ** (SIGNS - m)
    return m


def usable(vector: Column) -> Column:
    v = F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists(v, lambda x: x != 0)


def label_number(vectors: DataFrame) -> Column:
    """A label as 64 bits: a whole number as it is, anything else by the hash of its text, which two labels share with a chance of 2**-64."""
    whole = isinstance(vectors.schema["label"].dataType, IntegralType)
    text = F.col("label").cast("string")
    return F.col("label").cast("bigint") if whole else F.when(text.isNotNull(), F.xxhash64(text))


def hashed(vectors: DataFrame, k: int, tables: int) -> DataFrame:
    """(r, h1, h2, s1, s2, keys, unit): what tells classes apart, the sketch, each table's bucket, the unit vector."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy()
            flat = batch.column(2).flatten().to_numpy()
            ends, labels = np.cumsum(sizes), batch.column(1).to_numpy()
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = flat[(ends[rows] - d)[:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                x += 0.0  # no negative zeros
                rng = np.random.default_rng([SEED, d])
                a, b, signs = rng.normal(size=(d, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.normal(size=(d, SIGNS))
                start = mix(labels[rows].astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + U64(d))
                bits, h = x.view(U64), np.stack([start, ~start])
                for j in range(d):
                    h = mix(h * U64(31) + bits[:, j])
                cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(rows), tables, k)
                key = start[:, None] + np.arange(tables, dtype=U64)
                for j in range(k):
                    key = mix(key * U64(31) + cells[:, :, j].view(U64) + U64(j + 1))
                sketch = np.packbits(x @ signs > 0, axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(key.view(np.int64).ravel()))
                numbers = (h[0].view(np.int64), h[1].view(np.int64), np.ascontiguousarray(sketch[:, 0]), np.ascontiguousarray(sketch[:, 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, numbers), lists, blobs(list(x))], ["r", "h1", "h2", "s1", "s2", "keys", "unit"])

    rows = vectors.select("r", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(work, "r bigint, h1 bigint, h2 bigint, s1 bigint, s2 bigint, keys array<bigint>, unit binary")


def dealt(rows: DataFrame, key: str, side: int) -> DataFrame:
    """Rows once for each pair of blocks (pair) of their key's group that needs them, sorted by key and pair. `other`: of a pair of two blocks the second.

    Only keys of more than `side` rows are told apart from the rest; their table is broadcast if Spark finds it small, and
    shuffled with skew handling if not.
    """
    large = stored(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > side), "large")
    rows = rows.join(large, key, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / side), F.lit(1)).cast("int")).drop("n")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("own", "with").cast("bigint"), F.greatest("own", "with").cast("bigint")
    rows = rows.withColumn("pair", x * (1 << 31) + y).withColumn("other", F.col("own") > F.col("with")).drop("blocks", "own", "with")
    return rows.repartition(partitions(rows.sparkSession), key, "pair").sortWithinPartitions(key, "pair")


def two_blocks(table: pa.Table, group: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(which rows are of groups within one block, (rows of the first block, rows of the second) of each other group)."""
    pair = table["pair"].to_numpy()
    across = (pair >> 31) != (pair & ((1 << 31) - 1))
    out = []
    for g in np.unique(group[across]).tolist():
        span = np.arange(*np.searchsorted(group, [g, g + 1]))
        second = table["other"].to_numpy(zero_copy_only=False)[span]
        out.append((span[~second], span[second]))
    return ~across, out


def tied(buckets: DataFrame, threshold: float) -> DataFrame:
    """Ties (a, b) among the classes of each bucket whose sketches are near, at most one for each class."""
    most = most_signs(threshold)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, ["bucket", "pair"], AT_ONCE):
            c, s1, s2 = (table[x].to_numpy() for x in ("c", "s1", "s2"))
            group = group_numbers(table, ["bucket", "pair"])
            forest = Forest(len(c))

            def compare(i: np.ndarray, j: np.ndarray, s1: np.ndarray = s1, s2: np.ndarray = s2, forest: Forest = forest) -> None:
                apart = forest.root[i] != forest.root[j]
                i, j = i[apart], j[apart]
                near = np.bitwise_count((s1[i] ^ s1[j]).view(U64)).astype(np.int16) + np.bitwise_count((s2[i] ^ s2[j]).view(U64)) <= most
                forest.tie(i[near], j[near])

            within, blocks = two_blocks(table, group)
            first, step = np.flatnonzero(within), 1
            while len(first := first[first + step < len(c)]) and len(first := first[group[first] == group[first + step]]):
                compare(first, first + step)
                step += 1
            for a, b in blocks:
                for x in a:
                    compare(np.full(len(b), x), b)
            hit = np.flatnonzero(forest.root != np.arange(len(c)))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(c[forest.root[hit]])], ["a", "b"])

    return buckets.mapInArrow(work, "a bigint, b bigint")


def verified(families: DataFrame, threshold: float) -> DataFrame:
    """(c, links, tie): of each class its links, in parts, to vectors of other classes, and an exact tie."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, ["family", "pair"], AT_ONCE // 8):
            c, copies = table["c"].to_numpy(), table["copies"].to_numpy()
            group = group_numbers(table, ["family", "pair"])
            # a family's vectors are of one length
            size = np.array([len(u) for u in table["unit"].to_pylist()]) // 8
            flat = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64)
            at = np.cumsum(size) - size
            forest, links = Forest(len(c)), np.zeros(len(c), np.int64)

            def rows_of(i: np.ndarray, flat: np.ndarray = flat, at: np.ndarray = at, size: np.ndarray = size) -> np.ndarray:
                return flat[at[i][:, None] + np.arange(size[i[0]])]

            def compare(i: np.ndarray, j: np.ndarray, copies: np.ndarray = copies, forest: Forest = forest, links: np.ndarray = links, size: np.ndarray = size, rows_of=rows_of) -> None:
                for d in np.unique(size[i]).tolist():
                    x, y = i[size[i] == d], j[size[i] == d]
                    ok = np.einsum("nd,nd->n", rows_of(x), rows_of(y)) >= threshold
                    x, y = x[ok], y[ok]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    forest.tie(x, y)

            def multiply(a: np.ndarray, b: np.ndarray, same: bool, rows_of=rows_of, compare=compare) -> None:
                y = rows_of(b)
                for s in range(0, len(a), SLICE):
                    # products in blocks may stray by a few units in the last place from a pair's own, which decides
                    p, q = np.nonzero(rows_of(a[s : s + SLICE]) @ y.T >= threshold - 1e-9)
                    p = p + s
                    if same:
                        p, q = p[p < q], q[p < q]
                    for t in range(0, len(p), AT_ONCE):
                        compare(a[p[t : t + AT_ONCE]], b[q[t : t + AT_ONCE]])

            within, blocks = two_blocks(table, group)
            n = np.bincount(group)
            first, step = np.flatnonzero(within & (n[group] <= SMALL)), 1
            while len(first := first[first + step < len(c)]) and len(first := first[group[first] == group[first + step]]):
                compare(first, first + step)
                step += 1
            for g in np.flatnonzero(n > SMALL).tolist():
                span = np.arange(*np.searchsorted(group, [g, g + 1]))
                if within[span[0]]:
                    multiply(span, span, True)
            for a, b in blocks:
                if len(a) and len(b):
                    multiply(a, b, False)
            hit = np.flatnonzero(links > 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(links[hit]), pa.array(c[forest.root[hit]])], ["c", "links", "tie"])

    return families.mapInArrow(work, "c bigint, links bigint, tie bigint")


def embed_dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label_number(vectors).alias("label"), "embedding")
    rows = rows.withColumn("ok", F.col("label").isNotNull() & usable(F.col("embedding")))
    # a number for each row, fixed by writing it: ids may repeat or be null
    rows = stored(rows.withColumn("r", F.monotonically_increasing_id()), "vectors")
    most = rows.where("ok").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    units = stored(hashed(rows.where("ok"), *plan(most, threshold)), "units")
    # equal vectors have equal keys, so it doesn't matter whose are kept
    kinds = units.groupBy("h1", "h2").agg(F.min("r").alias("c"), F.count("*").alias("copies"), *(F.first(x).alias(x) for x in ("s1", "s2", "keys")))
    kinds = stored(kinds, "kinds")
    buckets = dealt(kinds.select("c", "s1", "s2", F.explode("keys").alias("bucket")), "bucket", SIDE)
    families = components(tied(buckets, threshold).distinct()).select(F.col("node").alias("c"), F.col("component").alias("family"))
    families = stored(families.join(kinds.select("c", "copies"), "c"), "families")
    found = dealt(families.join(units.select(F.col("r").alias("c"), "unit"), "c"), "family", SIDE)
    found = stored(verified(found, threshold), "embedding_links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("c").alias("a"), F.col("tie").alias("b"))).select(F.col("node").alias("c"), "component")
    of_class = kinds.select("h1", "h2", "c", "copies").join(links, "c", "left").join(groups, "c", "left")
    of_class = of_class.select("h1", "h2", F.coalesce("component", "c").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    of_row = units.select("r", "h1", "h2").join(of_class, ["h1", "h2"]).select("r", "component", "links")
    out = rows.select("r", "vec_id").join(of_row, "r", "left").withColumn("component", F.coalesce("component", "r"))
    least = out.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return out.join(least, "component").select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))
