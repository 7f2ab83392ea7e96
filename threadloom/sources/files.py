"""Folders as they may be read: links and ways out of the root are refused before Spark lists anything; sinks."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatchcase
from itertools import chain, islice
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.storage import folder

#: Files that one plan reads, whose paths and sizes the driver holds; of more, plans read so many after each other.
BATCH = 10_000
#: Files that a plan which isn't written may read: a query holds many such plans at once.
LAZY = 1000
#: Files from which on what is read of them is never broadcast, however small it is when compressed.
WIDE = 50_000


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _matches(name: str, pattern: str) -> bool:
    """A name by a glob, of which braces may list several."""
    return any(fnmatchcase(name, p) for p in (pattern[1:-1].split(",") if pattern.startswith("{") else [pattern]))


def _local_files(top: str, links: bool = True) -> Iterator[os.DirEntry]:
    """Files below a local folder; not even the names of one folder are held. Without `links` none that a symbolic link leads to."""
    with os.scandir(top) as found:
        for e in found:
            if _hidden(e.name) or (not links and e.is_symlink()):
                continue
            if e.is_dir():
                yield from _local_files(e.path, links)
            else:
                yield e


def _folder(spark: SparkSession, root: str) -> tuple[object, object, str]:
    """The store of a folder, the folder in it, and what the paths of files below it begin with."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    local = store.getUri().getScheme() == "file"
    return store, top, f"file://{top.toUri().getPath()}" if local else store.makeQualified(top).toString().rstrip("/")


def file_names(spark: SparkSession, root: str, pattern: str, links: bool = True) -> Iterator[str]:
    """Paths below a folder of the files in it, one after the other; without `links` none that a local symbolic link leads to."""
    store, top, within = _folder(spark, root)
    if not store.exists(top):
        return
    if within.startswith("file://"):
        at = within.removeprefix("file://")
        yield from (e.path[len(at.rstrip("/")) + 1 :] for e in (_local_files(at, links) if os.path.isdir(at) else ()) if _matches(e.name, pattern))
        return
    found = store.listFiles(top, True)
    while found.hasNext():
        path = found.next().getPath().toString()[len(within) + 1 :]
        *dirs, name = path.split("/")
        if not any(map(_hidden, [*dirs, name])) and _matches(name, pattern):
            yield path


def file_paths(spark: SparkSession, root: str, pattern: str) -> Iterator[str]:
    """Paths of the files below a folder, one after the other."""
    within = _folder(spark, root)[-1].rstrip("/")
    yield from (f"{within}/{name}" for name in file_names(spark, root, pattern))


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """While a plan's files are listed: by as many tasks as run at once, not one a path, and without the session's cache, which keeps what it is told of files."""
    few = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(2 * spark.sparkContext.defaultParallelism), "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
    before = {k: spark.conf.get(k, None) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_files(spark: SparkSession, root: str, pattern: str, load: Callable[[DataFrameReader, str | list[str]], DataFrame]) -> DataFrame:
    """What `load` makes of the files below a folder whose names match; of more than LAZY files it is written, BATCH by BATCH.

    Spark's readers keep what they know of each file on the driver, so the number of files of one plan is bounded.
    """
    reader = lambda: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    paths, lazy = file_paths(spark, root, pattern), min(LAZY, BATCH)
    first = list(islice(paths, lazy + 1))
    if len(first) <= lazy:
        with _listing(spark):
            return load(reader(), root)
    return read_paths(spark, chain(first, paths), load, reader)


def read_paths(spark: SparkSession, paths: Iterator[str], load: Callable[[DataFrameReader, str | list[str]], DataFrame], reader: Callable[[], DataFrameReader]) -> DataFrame:
    """What `load` makes of files of which there is one at least, written BATCH by BATCH."""
    at, schema, n = folder(spark, "files"), None, 0
    tasks = max(64, 2 * spark.sparkContext.defaultParallelism)
    while batch := list(islice(paths, BATCH)):
        # a path is taken to the letter
        with _listing(spark):
            rows = load(reader(), [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in batch])
        schema, n = rows.schema, n + len(batch)
        rows.coalesce(tasks).write.mode("append").parquet(at)
        del rows
        gc.collect()  # the plans of earlier batches, and all that they know of their files, live as long as Python's handles of them
    out = spark.read.schema(schema).parquet(at)
    return out.hint("merge") if n > WIDE else out


def unsafe_entries(root: str) -> list[str]:
    """Symbolic links below a local root, by which alone something there can lie outside it. Other stores have no links to refuse."""
    found, below = [], [root]
    while below:
        with os.scandir(below.pop()) as entries:
            for e in entries:
                if e.is_symlink():
                    found.append(str(Path(e.path)))
                elif e.is_dir():
                    below.append(e.path)
    return sorted(found)


def to_json_documents(rows: DataFrame) -> DataFrame:
    """One canonical JSON document a row: fields in the order of their names, nulls kept."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
