"""Files of a folder of many, each read once, by tasks: no plan knows of them, and a loader takes from what was read all it needs.

A file's row has its place, its time, its digest, and its lines or its whole content. What is too long to be held at once has
neither, and is read in ranges by Spark's readers.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.storage import folder
from threadloom.sources import files
from threadloom.sources.sink import READ, listed, opened

#: Files from which on a folder is read by tasks.
MANY = 1000
#: Bytes up to which a file's lines are held at once.
PIECE = 4 << 20
SCHEMA = "name string, path string, modified timestamp, size bigint, print string, lines array<binary>, closed boolean, content binary, long boolean"
ARROW = pa.schema([("name", pa.string()), ("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("size", pa.int64()), ("print", pa.string()), ("lines", pa.list_(pa.binary())), ("closed", pa.bool_()), ("content", pa.binary()), ("long", pa.bool_())])


class Taken:
    """rows as SCHEMA has them, and the folder that their names lie below."""

    def __init__(self, rows: DataFrame, within: str) -> None:
        self.rows, self.within = rows, within

    def paths(self, condition: str | Column) -> Iterator[str]:
        """Paths of the files for which it holds, as Spark's readers take them."""
        yield from (f"{self.within}/{r[0]}" for r in self.rows.where(condition).select("name").toLocalIterator())

    def where(self, condition: Column) -> Taken:
        return Taken(self.rows.where(condition), self.within)

    def named(self, name: str) -> Taken:
        """Those of that name, in whatever folder."""
        return self.where(F.substring_index("name", "/", -1) == name)


def taken(spark: SparkSession, root: str, pattern: str, whole: str = "", links: bool = False, limit: int = 64 << 20) -> Taken | None:
    """What tasks read of the files below a folder whose names match and that aren't empty; of those that match `whole` their content, else lines.

    `links`: whether symbolic links are followed. `limit`: bytes up to which a digest is that of the content. None if there
    are no more than MANY files, or if tasks can't open the store: then Spark's readers read them.
    """
    within = files._folder(spark, root)[-1].rstrip("/")
    try:
        opened(within)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    names = files.file_names(spark, root, pattern, links)
    first = list(islice(names, MANY + 1))
    if len(first) <= MANY:
        return None
    at, n = listed(spark, chain(first, names))
    out, tasks = folder(spark, "taken"), max(n, 4 * spark.sparkContext.defaultParallelism)
    rows = spark.read.schema("name string").json(at).repartition(tasks).mapInArrow(_rows(within, whole, limit), SCHEMA)
    rows.write.parquet(out)
    rows = spark.read.schema(SCHEMA).parquet(out)
    return Taken(rows.hint("merge"), within)


def _url(path: str) -> str:
    """A path as the columns of Spark's readers have it: what a URL may not hold is escaped, other letters than ASCII's stay."""
    keeps = lambda c: ord(c) > 127 and unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp")
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/]", lambda m: m[0] if keeps(m[0]) else quote(m[0], safe=""), path)


def _rows(within: str, whole: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    scheme, _, top = within.partition("://")
    begin = "file:" if scheme == "file" else f"{scheme}://"

    def row(store: fs.FileSystem, root: str, name: str) -> dict:
        info = store.get_file_info(f"{root}/{name}")
        out = {"name": name, "path": f"{begin}{_url(f'{top}/{name}')}", "modified": info.mtime_ns // 1_000_000 * 1000, "long": False}
        text = bool(whole) and files._matches(posixpath.basename(name), whole)
        with store.open_input_stream(f"{root}/{name}") as f:
            if not text and info.size > PIECE:
                digest = hashlib.sha256()
                while info.size <= limit and (some := f.read(PIECE)):
                    digest.update(some)
                return out | {"size": info.size, "print": digest.hexdigest() if info.size <= limit else None, "long": True}
            data = f.read()
        out |= {"size": len(data), "print": hashlib.sha256(data).hexdigest() if len(data) <= limit else None}
        if text:
            return out | {"content": data}
        # Spark's reader leaves out a byte order mark
        lines = data.removeprefix(b"\xef\xbb\xbf").split(b"\n")
        closed = not lines[-1]
        return out | {"lines": lines[:-1] if closed else lines, "closed": closed}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(within)
        for batch in batches:
            some, size = [], 0
            for name in batch.column(0).to_pylist():
                if not (one := row(store, root, name))["size"]:
                    continue  # Spark's readers pass over empty files
                some.append(one)
                if (size := size + (0 if one["long"] else one["size"])) >= READ:
                    yield pa.RecordBatch.from_pylist(some, ARROW)
                    some, size = [], 0
            yield pa.RecordBatch.from_pylist(some, ARROW)

    return read
