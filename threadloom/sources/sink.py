"""A sink of named files: each row is a file below a folder, and a job's files appear when all of its tasks are done.

Tasks write into a folder of the job's own beside the place where the files go; the commit moves them there, and an abort
removes that folder, so a failed task or job leaves nothing and a task that is done twice counts once. Rows of one name come
to one task, in the order of names, which finds repeated ones; it lists its names in a file, which the commit reads piece by
piece, so nothing holds the names of all files. Names are relative paths; one that leads out of the folder is an error. Any
store that pyarrow opens will do.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from threadloom.functions import redaction
from threadloom.plans.storage import folder
from threadloom.sources.files import file_names

FORMAT = "threadloom_files"
#: Names that a commit holds at once.
MOVED = 1000
#: Names that a list of files to be read holds; a task reads about so many files.
LISTED = 10_000
#: Bytes of files from which on a task hands on what it has read.
READ = 16 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"\Afile:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def checked(name: str) -> str:
    """A file's name, if it is a relative path that stays below its folder."""
    if not name or name.startswith("/") or "\\" in name or any(p in ("", ".", "..") for p in name.split("/")):
        raise ValueError(f"not a name below a folder: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, and the file beside it that lists the files in it; none if there are none."""

    folder: str
    listed: str | None


class FileWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.stage = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"
        store, root = opened(self.path)
        store.create_dir(f"{root}/{self.stage}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, root = opened(self.path)
        task = TaskContext.get()
        folder = f"{root}/{self.stage}/{task.partitionId()}-{task.taskAttemptId()}"
        names, before, made = None, None, None
        try:
            for row in rows:
                at = f"{folder}/{checked(row['name'])}"
                if row["name"] == before:
                    raise ValueError("two rows have the same name")
                if store.get_file_info(f"{root}/{self.stage}").type == fs.FileType.NotFound:
                    raise RuntimeError("the job has been given up")  # a task that outlives it must not write again
                if (parent := posixpath.dirname(at)) != made:
                    store.create_dir(parent, recursive=True)
                    made = parent
                with store.open_output_stream(at) as out:
                    out.write((row["body"] or "").encode())
                names = names or store.open_output_stream(f"{folder}.names")
                names.write(f"{json.dumps(before := row['name'])}\n".encode())
        finally:
            if names is not None:
                names.close()
        return Written(folder, names and f"{folder}.names")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is None or m.listed is None:
                    continue
                made = None
                with store.open_input_stream(m.listed) as f:
                    lines = io.BufferedReader(f, 1 << 20)
                    while some := [json.loads(x) for x in islice(lines, MOVED)]:
                        for name in some:
                            if (parent := posixpath.dirname(f"{root}/{name}")) != made:
                                store.create_dir(parent, recursive=True)
                                made = parent
                        list(pool.map(lambda n: store.move(f"{m.folder}/{n}", f"{root}/{n}"), some))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.stage}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Writes rows (name, body) as files below a folder; files of other names stay as they are."""
    rows.sparkSession.dataSource.register(FileSink)
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = rows.select("name", F.col("body").cast("string").alias("body")).repartition(tasks, "name").sortWithinPartitions("name")
    rows.write.format(FORMAT).option("path", path).mode("append").save()


def documents(rows: DataFrame, name: Column, title: Column, body: Column, kind: str = "markdown") -> DataFrame:
    """(name, body): a Markdown or JSON document for each row, its words redacted."""
    title, body = redaction.redacted_text(title), redaction.redacted_text(body)
    if kind == "json":
        fields = F.struct(body.alias("body"), F.lit(1).alias("schema_version"), title.alias("title"))
        return rows.select(name.alias("name"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("body"))
    if kind != "markdown":
        raise ValueError(f"no such kind of document: {kind}")
    return rows.select(name.alias("name"), F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n")).alias("body"))


def listed(spark: SparkSession, names: Iterator[str]) -> tuple[str, int]:
    """(folder, number) of files that list names, LISTED of them each."""
    at, n = folder(spark, "listed"), 0
    store, lists = opened(at)
    store.create_dir(lists, recursive=True)
    while some := list(islice(names, LISTED)):
        with store.open_output_stream(f"{lists}/{n:06}.json") as out:
            out.write("".join(f"{json.dumps({'name': x})}\n" for x in some).encode())
        n += 1
    return at, n


def read_documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(name, body) of the files below a folder, by the last part of their names; tasks read them.

    Their paths are listed in files of LISTED each, so neither the driver nor a plan holds what is known of each file.
    """
    store, root = opened(path)
    if store.get_file_info(root.rstrip("/")).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    at, n = listed(spark, file_names(spark, path, pattern))
    tasks = max(n, 2 * spark.sparkContext.defaultParallelism)
    rows = spark.read.schema("name string").json(at).repartition(tasks).mapInArrow(_bodies(path), "name string, body binary")
    return rows.select("name", F.col("body").cast("string").alias("body"))


def _bodies(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path.rstrip("/"))
        made = lambda: pa.record_batch([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["name", "body"])
        for batch in batches:
            names, bodies, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as f:
                    bodies.append(f.read())
                names.append(posixpath.basename(name))
                if (size := size + len(bodies[-1])) >= READ:
                    yield made()
                    names, bodies, size = [], [], 0
            yield made()

    return read
