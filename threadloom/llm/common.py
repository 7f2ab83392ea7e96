"""What several of the operators share: where tables are cut, text blocks, word hashes, sorted groups."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one if all of Spark is on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_paths: dict[int, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: its lineage ends there, and lost executors cost nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop_path, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


def dropped(table: DataFrame) -> None:
    """Removes a stored table that nothing will read any more."""
    path = _paths.pop(id(table), None)
    if path:
        drop_path(table.sparkSession, path)


def collected(spark: SparkSession) -> None:
    """Collects the driver's garbage: only then does Spark drop the broadcasts and shuffles of steps that are done."""
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has gone already
        return


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it has more than one in MANY of all rows, so there are fewer than MANY hot keys; each is dealt over SALTS places.
MANY, SALTS = 512, 64


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with keys (a row a key, n: its rows) without n; total: the number of rows, or more.

    Hot keys' rows are dealt by a salt of their own values, and their few rows of keys repeated for each salt; so one key
    doesn't make one task. Hot keys alone are broadcast: they are fewer than MANY.
    """
    hot = F.broadcast(keys.where(F.col("n") * MANY > F.lit(total)).select(*on, F.lit(True).alias("_hot")))
    plain = [c for c, kind in rows.dtypes if kind in ("bigint", "int", "string", "binary", "boolean")]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("n") * MANY > F.lit(total), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    # a broadcast of the keys would be held by the driver, and build its table there
    right = keys.withColumn("_salt", F.explode(salts)).drop("n").hint("merge")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


#: What monotonically_increasing_id counts the rows of a partition with.
ROW_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `i`, the place in their group by `order` from 0, and `n`, the group's rows."""
    keys = [group, *order, "_tie"]
    # equal rows may be many: what they are dealt by is no part of the result
    dealt = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = stored(dealt.drop("_tie").withColumn("at", F.monotonically_increasing_id()), name).withColumn("block", F.shiftright("at", ROW_BITS))
    # a row for each partition and group; written, so that its size is known where it is joined
    blocks = stored(held.groupBy(group, "block").agg(F.min("at").alias("first"), F.count("*").alias("rows")), f"{name}-blocks")
    # a group has a row a partition here, so its window is small however many rows it has
    earlier = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    totals = blocks.groupBy(group).agg(F.sum("rows").alias("n"))
    places = stored(before.join(totals, group), f"{name}-places")
    return held.join(places, [group, "block"]).withColumn("i", F.col("before") + F.col("at") - F.col("first")).drop("at", "block", "first", "before")


#: Bytes and rows of texts that Spark hands to Python at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session set to hand texts to Python in small batches: whole texts may be long, and two copies of a batch are held."""
    conf = df.sparkSession.conf
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        try:
            now = int(re.sub(r"\D", "", conf.get(name)))
        except Exception:  # noqa: BLE001  this Spark has no such setting
            continue
        if not 0 < now <= most:
            conf.set(name, str(most))
    return df


# ---------------------------------------------------------------- blocks of text


#: What frees the memory that other operators keep in a worker process.
RELEASE: list[Callable[[], None]] = []


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their text bytes end to end, offsets of each text) in blocks of about `limit` bytes; null is empty."""
    for free in RELEASE:
        free()
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = pc.fill_null(batch.column(at), "").cast(pa.large_string())
        if not len(texts):
            continue
        raw = texts.buffers()
        offsets = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(texts))
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n + (n >> 3), 1 << 10)
        have = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span of data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(_STEP, len(data)), out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_BACK, len(sums))[start])


_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x41:0x5B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWERED = _BYTE[_LOWER]
#: The lower-cased byte inside words, 0 outside.
LOWERED_WORD = np.where(_WORD, _LOWER, 0).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased, that don't cross texts: (start, end, text number, hash)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    is_word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, is_word
    here = np.empty(len(data) + 1, bool)
    here[:-1], here[-1] = is_word, False
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    text = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, text, span_hash(prefix_sums(data, _LOWERED), starts, ends)


def counts_by_text(text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, minlength=n)


_MULT = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingles(text: np.ndarray, hashes: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of `width` words; a text of fewer words, but not none, is one shingle."""
    count = counts_by_text(text, n_texts)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    n = len(hashes)
    full = np.zeros(n, np.uint64)
    m = max(0, n - width + 1)
    for j in range(width):
        full[:m] += hashes[j : j + m] * _MULT[j]
    keep = np.zeros(n, bool)
    keep[:m] = text[:m] == text[width - 1 : width - 1 + m]
    short = np.flatnonzero((count > 0) & (count < width))
    for t in short:
        at = first[t]
        full[at] = sum((int(hashes[at + j]) * int(_MULT[j]) for j in range(count[t])), int(count[t])) % (1 << 64)
        keep[at] = True
    where = np.flatnonzero(keep)
    return text[where], mix(full[where])


# ---------------------------------------------------------------- sorted groups


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share keys; the rows come sorted by them. Only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[a] for c in columns)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def chunks(batches: Iterable[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of at least `least` rows that hold whole groups of sorted rows; a larger group comes as part of one table."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.ones(batch.num_rows, bool)
        change[1:] = False
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is None or tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        begin = 0
        for at in np.flatnonzero(change).tolist():
            if size + at - begin >= least:
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, at
        held.append(batch.slice(begin))
        size += batch.num_rows - begin
    if held:
        yield pa.Table.from_batches(held)


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """0, 1, … for the runs of equal keys in sorted rows."""
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        c = table[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


class Forest:
    """Components of numbered things, as pairs of them are told; each has the smallest number that reaches it."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def blobs(values: list[np.ndarray]) -> pa.Array:
    """A binary column of the arrays' bytes."""
    return pa.array([v.tobytes() for v in values], pa.binary())
