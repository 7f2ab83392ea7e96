"""Conversation logs of six sources as sessions, turns and warnings.

Every loader takes a folder and gives a `Scan` of lazy DataFrames over `spark.read.text` lines numbered by their place in
the file. What can't be read becomes a row of warnings, never an error; the rest of the file is kept.
"""

from __future__ import annotations

import hashlib
import os
import re
import sqlite3
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import guarded, text
from threadloom.plans.storage import stored
from threadloom.schema import SESSIONS, TURNS, WARNINGS
from threadloom.sources.files import read_files, read_paths, unsafe_entries
from threadloom.sources.taken import Taken, taken

UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: Sources whose read is partial as soon as there is a warning.
STRICT = ("codex", "grok", "opencode")


@dataclass(frozen=True)
class Scan:
    """sessions and turns as threadloom.schema has them; warnings tell what was left out."""

    sessions: DataFrame
    turns: DataFrame
    warnings: DataFrame

    def status(self) -> DataFrame:
        """(source_id, adapter, read_status) of each session."""
        n = self.turns.groupBy("source_id").agg(F.count("*").alias("turns"))
        w = self.warnings.where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("warnings"))
        rows = self.sessions.join(n, "source_id", "left").join(w, "source_id", "left")
        t, k = F.coalesce("turns", F.lit(0)), F.coalesce("warnings", F.lit(0))
        status = F.when(t == 0, "unavailable").when((k > 0) & F.col("adapter").isin(*STRICT), "partial").otherwise("complete")
        return rows.select("source_id", "adapter", status.alias("read_status"))


def namespace(root: str) -> str:
    return "store-" + hashlib.sha256(root.rstrip("/").encode()).hexdigest()


def _safe(root: str) -> Callable[[DataFrame], DataFrame]:
    """Leaves out symbolic links and what lies outside the root; their paths prune the scan before anything is read."""
    bad = unsafe_files(root)
    return lambda files: files.where(~_local(F.col("_metadata.file_path")).isin(bad)) if bad else files


def _local(url: Column) -> Column:
    """A local file's URL as a path that is still escaped; URLs come with one slash or three."""
    return F.regexp_replace(url, r"\Afile:/+", "/")


def unsafe_files(root: str) -> list[str]:
    local = root.removeprefix("file://") if root.startswith("file://") else root
    if "://" in local or not os.path.isdir(local):
        return []
    out = []
    for path in unsafe_entries(local):
        inside = [os.path.join(d, f) for d, _, names in os.walk(path, followlinks=True) for f in names] if os.path.isdir(path) else [path]
        out += [quote(os.path.abspath(x)) for x in inside]
    return out


def unsafe_warnings(spark: SparkSession, root: str) -> DataFrame:
    rows = [("unsafe-session-source", os.path.basename(x), None, None) for x in unsafe_files(root)]
    return spark.createDataFrame(rows, WARNINGS)


def _ranged(safe: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda r, at: safe(r.option("lineSep", "\n").text(at)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("range"), "value", F.monotonically_increasing_id().alias("at"),
    )


def lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", read: Taken | None = None) -> DataFrame:
    """(path, line, value, complete) of the files below root, numbered from 1 in each file; blank lines count but have no row.

    Files are read in ranges, many tasks a file: a range tells how many lines it has, the sum of those before it in its file
    is where its own numbers begin. `complete` is false for a last line without its line break, which the bytes of all lines
    tell: with a break each, they are the file's size. `read`: the files as tasks have read them, if they have; of those too
    long for it alone ranges are read.
    """
    if read is None:
        return _numbered(read_files(spark, root, pattern, _ranged(_safe(root))))
    number = F.col("i") + 1
    told = read.rows.where("lines is not null").select("path", "modified", F.size("lines").alias("n"), "closed", F.posexplode("lines").alias("i", "v"))
    rows = told.select("path", "modified", number.cast("int").alias("line"), F.col("v").cast("string").alias("value"), (F.col("closed") | (number < F.col("n"))).alias("complete"))
    rows = rows.where(F.trim("value") != "")
    return rows if (long := _long(spark, read, "long")) is None else rows.unionByName(long)


def _long(spark: SparkSession, read: Taken, condition: str) -> DataFrame | None:
    """Lines of those files for which it holds, read in ranges; none if there are no such files."""
    paths = read.paths(condition)
    first = next(paths, None)
    return None if first is None else _numbered(read_paths(spark, chain([first], paths), _ranged(lambda rows: rows), lambda: spark.read))


def _numbered(rows: DataFrame) -> DataFrame:
    """Lines of ranges (path, modified, size, range, value, at) with their numbers in their files."""
    ranges = rows.groupBy("path", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    whole = Window.partitionBy("path")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # Spark's reader leaves out a byte order mark
    missing = F.sum("bytes").over(whole) - F.col("size")
    ranges = ranges.select("path", "range", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("lines"), missing.isin(0, -3).alias("closed"))
    ranges = stored(ranges, "ranges")
    line = F.col("before") + F.col("at") - F.col("first") + 1
    rows = rows.join(ranges, ["path", "range"]).select("path", "modified", line.cast("int").alias("line"), "value", (F.col("closed") | (line < F.col("lines"))).alias("complete"))
    return rows.where(F.trim("value") != "")


#: Bytes up to which a file's fingerprint is that of its content, read as one row.
WHOLE = 64 << 20


def _digests(rows: DataFrame) -> DataFrame:
    """(path, fingerprint) of files by their lines."""
    digest = F.sha2(F.concat_ws(":", "line", "complete", "value").cast("binary"), 256)
    number = lambda k: F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy("path").agg(F.concat_ws(":", F.count("*"), *(number(k) for k in range(4))).alias("sums"))
    return sums.select("path", F.sha2(F.col("sums").cast("binary"), 256).alias("fingerprint"))


def fingerprints(spark: SparkSession, root: str, pattern: str = "*.jsonl", read: Taken | None = None) -> DataFrame:
    """(path, fingerprint): SHA-256 of each whole file; of one of more than WHOLE bytes that of its lines' digests, each with its number, summed. `read`: as in lines."""
    if read is not None:
        told = read.rows.where("print is not null").select("path", F.col("print").alias("fingerprint"))
        return told if (long := _long(spark, read, "print is null")) is None else told.unionByName(_digests(long))
    safe, path = _safe(root), F.col("_metadata.file_path").alias("path")
    small = read_files(spark, root, pattern, lambda r, at: safe(r.format("binaryFile").load(at)).where(F.col("length") <= WHOLE).select(path, F.sha2("content", 256).alias("fingerprint")))
    large = read_files(spark, root, pattern, lambda r, at: safe(r.format("binaryFile").load(at)).where(F.col("length") > WHOLE).select(path))
    if large.isEmpty():
        return small
    return small.unionByName(_digests(lines(spark, root, pattern).join(large, "path", "left_semi")))


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Lines with their record r; ok is false where a line isn't a JSON object. A field of another type than the schema's is null."""
    rows = rows.withColumn("v", F.try_parse_json("value"))
    good = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    return rows.withColumn("ok", good).withColumn("r", guarded.guarded(F.col("v"), schema)).drop("v")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def _identity(adapter: str, ns: str, native: Column) -> list[Column]:
    return [F.concat_ws(":", F.lit(adapter), F.lit(ns), native).alias("source_id"), F.lit(adapter).alias("adapter"), F.lit(ns).alias("namespace"), native.alias("native_id")]


def _sessions(rows: DataFrame) -> DataFrame:
    """Rows with the columns of SESSIONS; what a loader doesn't give is null. One row for each id: the first by path."""
    given = set(rows.columns)
    cols = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in SESSIONS.fields]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("locator"))).where("_n = 1")
    return first.select(*cols)


def _turns(rows: DataFrame, first: int, order: tuple[str, ...] = ("path", "line")) -> DataFrame:
    """Visible turns numbered from `first` in their order; rows: source_id, role, text, locator, at and the order's columns."""
    by = Window.partitionBy("source_id").orderBy(*order)
    rows = rows.where(F.col("role").isNotNull() & (F.coalesce("text", F.lit("")) != "")).withColumn("ordinal", F.row_number().over(by) - 1 + first)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TURNS.fields))


def _warnings(rows: DataFrame, code: str | Column, message: Column) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    sid = F.col("source_id") if "source_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(code.alias("code"), message.alias("message"), sid.alias("source_id"), F.lit(None).cast("string").alias("project_hint"))


def _malformed(rows: DataFrame, code: str) -> DataFrame:
    which = F.when(F.col("complete"), code).otherwise("truncated-" + code.removeprefix("malformed-"))
    return _warnings(rows.where(~F.col("ok")), which, F.concat(F.lit("line "), F.col("line").cast("string")))


def _duplicates(rows: DataFrame) -> DataFrame:
    more = rows.groupBy("source_id").agg(F.count_distinct("locator").alias("n")).where("n > 1")
    return _warnings(more, "duplicate-session-id", F.concat(F.col("n").cast("string"), F.lit(" files")))


def _blocks(parts: Column, kinds: list[str] | Column) -> Column:
    """The texts of an array's parts of the given kinds, a line each."""
    kind = (lambda p: p["type"].isin(*kinds)) if isinstance(kinds, list) else (lambda p: p["type"] == kinds)
    return F.array_join(F.transform(F.filter(parts, lambda p: kind(p) & p["text"].isNotNull()), lambda p: p["text"]), "\n")


# ---------------------------------------------------------------- the six sources


def codex(spark: SparkSession, root: str) -> Scan:
    """Session logs whose name ends in the session's UUID; a session is complete if its last lifecycle event says so."""
    ns = namespace(root)
    schema = (
        "timestamp string, type string, payload struct<id:string,session_id:string,timestamp:string,cwd:string,model_provider:string,type:string,role:string,"
        "model:string,effort:string,content:array<struct<type:string,text:string>>>"
    )
    native = F.lower(F.regexp_extract("path", rf"(?i)-({UUID})\.jsonl$", 1))
    read = taken(spark, root, "*.jsonl", limit=WHOLE)
    rows = parsed(lines(spark, root, read=read), schema).withColumn("native", native)
    unnamed = _warnings(rows.where("native = ''").select("path").distinct(), "unrecognized-session-name", F.regexp_extract("path", r"([^/]+)$", 1))
    rows = rows.where("native <> ''").select("*", *_identity("codex", ns, F.col("native")))
    rows = stored(rows, "codex")
    good = rows.where("ok")
    kind, p = F.col("r.type"), F.col("r.payload")
    meta, context = kind == "session_meta", kind == "turn_context"
    event = (kind == "event_msg") & p["type"].isin("task_started", "task_complete")
    when = text.parse_time(F.col("r.timestamp"))
    line = F.col("line")
    heads = good.groupBy("source_id", "adapter", "namespace", "native_id", F.col("path").alias("locator")).agg(
        F.min_by(F.struct(p["cwd"], p["timestamp"], p["model_provider"]), F.when(meta, line)).alias("m"),
        F.min(when).alias("first"),
        F.max(when).alias("updated_at"),
        F.max_by(p["type"], F.when(event, line)).alias("last"),
        text.header_value(F.max_by(p["model"], F.when(context & p["model"].isNotNull(), line))).alias("model_id"),
        text.header_value(F.max_by(p["effort"], F.when(context & p["effort"].isNotNull(), line))).alias("effort"),
    )
    heads = heads.withColumn("project_hint", F.col("m.cwd")).withColumn("started_at", F.coalesce(text.parse_time(F.col("m.timestamp")), "first"))
    heads = heads.withColumn("model_provider", text.header_value(F.col("m.model_provider"))).withColumn("health", F.when(F.col("last") == "task_complete", "complete").otherwise("unknown"))
    missing = _warnings(heads.where("m is null"), "missing-session-metadata", F.col("locator"))
    heads = heads.where("m is not null").join(fingerprints(spark, root, read=read).withColumnRenamed("path", "locator"), "locator", "left")
    role = F.when((kind == "response_item") & (p["type"] == "message"), F.when(p["role"] == "user", "user").when(p["role"] == "assistant", "agent"))
    said = good.withColumn("role", role).withColumn("text", _blocks(p["content"], F.when(F.col("role") == "user", "input_text").otherwise("output_text")))
    turns = _turns(said.withColumn("locator", F.concat(F.lit("jsonl:"), F.col("line").cast("string"))).withColumn("at", when), 0)
    warnings = unnamed.unionByName(_malformed(rows, "malformed-jsonl")).unionByName(missing).unionByName(_duplicates(heads)).unionByName(unsafe_warnings(spark, root))
    return Scan(_sessions(heads), turns, warnings)


def _folder_hints(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(escaped path of a project's folder, what its .cwd file says). Spark's readers pass over names that begin with a dot; there is one such file a project."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/.cwd")
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in store.globStatus(at) or ():
        path = found.getPath()
        if found.isFile() and not store.getFileLinkStatus(path).isSymlink():
            stream = store.open(path)
            try:
                text_ = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
            finally:
                stream.close()
            out.append((_escaped(path.getParent().toString()), text_.strip()))
    return out


def _escaped(path: str) -> str:
    """A path as the reader's columns have it, without a local file's scheme."""
    return quote(re.sub(r"\Afile:/+", "/", path), safe="/:")


def grok(spark: SparkSession, root: str) -> Scan:
    """A folder for each session, below one named by its percent-encoded project: summary.json and updates.jsonl."""
    ns = namespace(root)
    native, group = F.lower(F.regexp_extract("path", rf"(?i)/({UUID})/[^/]+$", 1)), F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]+$", 1)
    summary = "created_at string, updated_at string, git_root_dir string, generated_title string, current_model_id string"
    read = taken(spark, root, "{summary.json,updates.jsonl}", "summary.json", links=True, limit=WHOLE)
    if read is None:
        heads = read_files(spark, root, "summary.json", lambda r, at: r.text(at, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value"))
    else:
        heads = read.named("summary.json").rows.select("path", "modified", F.col("content").cast("string").alias("value"))
        if bad := unsafe_files(root):
            read = read.where(~_local(F.col("path")).isin(bad))
    heads = heads.withColumn("ok", F.try_parse_json("value").isNotNull()).withColumn("r", guarded.parsed(F.col("value"), summary)).withColumn("native", native).where("native <> ''")
    # a file URL escapes the percent signs of the folder's own name
    folder = text.percent_decoded(F.regexp_replace(group, "%25", "%"))
    heads = heads.select("*", *_identity("grok", ns, F.col("native")), F.col("path").alias("locator"))
    # a project's folder may say in a file of its own what its name can't
    hints = spark.createDataFrame(_folder_hints(spark, root), "group_dir string, cwd string")
    heads = heads.withColumn("group_dir", F.regexp_extract(_local(F.col("path")), r"^(.*)/[^/]+/[^/]+$", 1)).join(hints, "group_dir", "left")
    parse = lambda c: text.parse_time(F.col(c))
    drift = heads.where("ok").where(parse("r.created_at").isNull() | parse("r.updated_at").isNull())
    sessions = heads.where("ok").select(
        "*", F.coalesce(parse("r.created_at"), "modified").alias("started_at"), F.coalesce(parse("r.updated_at"), "modified").alias("updated_at"),
        F.coalesce("r.git_root_dir", text.first_non_blank(F.trim("cwd")), folder).alias("project_hint"), F.col("r.generated_title").alias("title"), F.lit("unknown").alias("health"), text.header_value(F.col("r.current_model_id")).alias("model_id"),
    )
    prints = fingerprints(spark, root, "{summary.json,updates.jsonl}", read).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.concat_ws(":", F.regexp_extract("path", r"([^/]+)$", 1), "fingerprint").alias("f"))
    prints = prints.groupBy("dir").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "\n"), 256).alias("fingerprint"))
    sessions = sessions.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).join(prints, "dir", "left")
    schema = "method string, timestamp bigint, params struct<sessionId:string,update:struct<sessionUpdate:string,content:struct<type:string,text:string>>>"
    rows = parsed(lines(spark, root, "updates.jsonl", read and read.named("updates.jsonl")), schema).withColumn("native", native).where("native <> ''")
    rows = rows.select("*", *_identity("grok", ns, F.col("native")))
    u = F.col("r.params.update")
    kind = F.when(u["sessionUpdate"] == "user_message_chunk", "user").when(u["sessionUpdate"] == "agent_message_chunk", "agent")
    role = F.when(F.col("r.method").isin("session/update", "_x.ai/session/update") & (F.lower("r.params.sessionId") == F.col("native")) & (u["content"]["type"] == "text"), kind)
    said = rows.where("ok").withColumn("role", role).withColumn("text", u["content"]["text"]).withColumn("locator", F.concat(F.lit("updates.jsonl:"), F.col("line").cast("string"))).withColumn("at", text.epoch_time(F.col("r.timestamp"), "s"))
    warnings = _malformed(rows, "malformed-update").unionByName(_warnings(heads.where("not ok"), "malformed-summary", F.col("path"))).unionByName(_warnings(drift, "summary-time-drift", F.col("path")))
    return Scan(_sessions(sessions), _turns(said, 0), warnings)


CATALOG_LIMIT = 500
OPENCODE_LEAST, OPENCODE_BELOW = (1, 17, 18), (2, 0, 0)


def supported_version(version: Column) -> Column:
    """Whether a version lies in the range whose exports are understood."""
    parts = F.transform(F.split(F.regexp_extract(version, r"^v?(\d+\.\d+\.\d+)$", 1), r"\."), lambda x: x.cast("int"))
    ok = F.rlike(version, F.lit(r"^v?\d+\.\d+\.\d+$"))
    return F.when(ok, (parts >= F.array(*map(F.lit, OPENCODE_LEAST))) & (parts < F.array(*map(F.lit, OPENCODE_BELOW)))).otherwise(False)


#: An export: what is known of a session, and its messages.
EXPORT = "info struct<id:string,directory:string,model:struct<id:string,providerID:string,variant:string>,time:struct<created:bigint,updated:bigint>>, messages array<struct<info:struct<id:string,sessionID:string,role:string,time:struct<created:bigint>>,parts:array<struct<type:string,text:string,ignored:boolean>>>>"


def _exports(spark: SparkSession, exports: str) -> DataFrame:
    """(path, value) of the files of exports."""
    if (read := taken(spark, exports, "*.json", "*", links=True)) is not None:
        return read.rows.select("path", F.col("content").cast("string").alias("value"))
    return read_files(spark, exports, "*.json", lambda r, at: r.text(at, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def _export_turns(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of exports (source_id, nid, r) with created and mid, messages that aren't of that session or lack what a turn needs)."""
    said = files.select("source_id", "nid", F.posexplode("r.messages").alias("at_", "m"))
    info = F.col("m.info")
    fine = info["id"].isNotNull() & (info["sessionID"] == F.col("nid")) & info["time"]["created"].isNotNull() & info["role"].isin("user", "assistant")
    told = said.where(fine).withColumn("n", F.row_number().over(Window.partitionBy("source_id", info["id"]).orderBy("at_"))).where("n = 1")
    parts = F.filter("m.parts", lambda p: (p["type"] == "text") & ~F.coalesce(p["ignored"], F.lit(False)) & p["text"].isNotNull())
    told = told.select("source_id", F.when(info["role"] == "user", "user").otherwise("agent").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.concat(F.lit("message:"), info["id"]).alias("locator"), text.epoch_time(info["time"]["created"], "ms").alias("at"), info["time"]["created"].alias("created"), info["id"].alias("mid"))
    return told, said.where(~F.coalesce(fine, F.lit(False)))


def reread_exports(spark: SparkSession, records: DataFrame, exports: str, start: int = 0, stop: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns of the half-open range, (source_id, read_status, model_id, model_provider, effort), warnings) of chosen records, each by its own export.

    records: source_id, adapter, native_id, fingerprint (the time of the last update, as a number), locator, project_hint.
    An export is a file of its session's name. A record is refused if it isn't of this source, isn't told by such a number,
    or has another place, if there is no export that can be read, or if that is of another session or project. An export
    that has been updated since is read, and told.
    """
    files = _exports(spark, exports).select(_stem(F.col("path")).alias("file"), guarded.parsed(F.col("value"), EXPORT).alias("r"))
    rows = records.join(files, F.col("native_id") == F.col("file"), "left")
    folder = lambda c: F.regexp_replace(c, r"/+\z", "")
    info = F.col("r.info")
    code = (
        F.when(~F.coalesce(F.col("adapter") == "opencode", F.lit(False)), "wrong-source")
        .when(~F.coalesce(F.rlike("fingerprint", F.lit(r"\A[0-9]+\z")), F.lit(False)), "unsupported-fingerprint")
        .when(~F.coalesce(F.col("locator") == F.concat(F.lit("session:"), "native_id"), F.lit(False)), "identity-mismatch")
        .when(F.col("file").isNull(), "missing-source")
        .when(F.col("r.messages").isNull(), "malformed-export")
        .when(~F.coalesce(info["id"] == F.col("native_id"), F.lit(False)), "identity-mismatch")
        .when(~F.coalesce(folder(info["directory"]) == folder(F.col("project_hint")), F.lit(False)), "project-mismatch")
    )
    rows = stored(rows.withColumn("code", code).withColumn("nid", F.col("native_id")), "exports")
    kept = rows.where("code is null")
    told, broken = _export_turns(kept)
    turns = selected(_turns(told, 0, ("created", "mid")), start, stop)
    refused = _warnings(rows.where("code is not null"), F.col("code"), F.lit("the record wasn't read"))
    changed = _warnings(kept.where(~info["time"]["updated"].cast("string").eqNullSafe(F.col("fingerprint"))), "source-changed", F.lit("the export is newer than the record"))
    warnings = refused.unionByName(changed).unionByName(_warnings(broken, "malformed-message", F.col("at_").cast("string")))
    n, w = turns.groupBy("source_id").agg(F.count("*").alias("turns")), warnings.groupBy("source_id").agg(F.count("*").alias("warned"))
    heads = rows.select("source_id", *(text.header_value(F.when(F.col("code").isNull(), info["model"][f])).alias(c) for f, c in (("id", "model_id"), ("providerID", "model_provider"), ("variant", "effort"))))
    heads = heads.join(n, "source_id", "left").join(w, "source_id", "left")
    status = F.when(F.coalesce("turns", F.lit(0)) == 0, "unavailable").when(F.col("warned").isNotNull(), "partial").otherwise("complete")
    return turns, heads.select("source_id", status.alias("read_status"), "model_id", "model_provider", "effort"), warnings


def opencode(spark: SparkSession, catalog: str, exports: str, directory: str | None = None, version: str | None = None) -> Scan:
    """Catalogs, JSON arrays of sessions, and a JSON export of each session. `catalog`: a file, or a folder of the pages of
    one that is longer than what is read of a file; a session that several pages name counts once, as it was updated last.
    `version`: of the program that wrote them, if it is known; with one whose exports aren't understood nothing is read."""
    ns = namespace(exports)
    if version is not None:
        told = spark.createDataFrame([(version,)], "v string").where(~supported_version(F.col("v")))
        if not told.isEmpty():
            return Scan(spark.createDataFrame([], SESSIONS), spark.createDataFrame([], TURNS), _warnings(told, "unsupported-version", F.col("v")))
    entry = "array<struct<id:string,directory:string,title:string,version:string,updated:bigint,created:bigint,time:struct<created:bigint,updated:bigint>>>"
    rows = spark.read.text(catalog, wholetext=True).select(F.col("_metadata.file_path").alias("page"), F.posexplode(guarded.parsed(F.col("value"), entry)).alias("at", "e"))
    crowded = rows.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > CATALOG_LIMIT)
    rows = rows.where(F.col("at") < CATALOG_LIMIT)
    if directory is not None:
        rows = rows.where(F.regexp_replace("e.directory", r"/+$", "") == directory.rstrip("/"))
    updated, created = F.coalesce("e.time.updated", "e.updated"), F.coalesce("e.time.created", "e.created")
    latest = F.row_number().over(Window.partitionBy("e.id").orderBy(updated.desc_nulls_last(), "page", "at"))
    rows = rows.withColumn("again", latest).where((F.col("again") == 1) | F.col("e.id").isNull())
    rows = rows.select("e", updated.alias("u"), created.alias("c"), *_identity("opencode", ns, F.col("e.id")), F.concat(F.lit("session:"), F.col("e.id")).alias("locator"))
    good = F.rlike("e.id", F.lit(r"^ses_[A-Za-z0-9_-]{1,128}$")) & (F.trim("e.title") != "") & (F.col("u") >= 0) & (F.col("c") >= 0)
    good = F.coalesce(good, F.lit(False))
    files = _exports(spark, exports).withColumn("r", guarded.parsed(F.col("value"), EXPORT)).where("r.info.id is not null and path not like '%session-list%'")
    ids = rows.select("source_id", F.col("native_id").alias("nid"), "u")
    files = stored(files.join(ids, F.col("r.info.id") == F.col("nid")).select("path", "r", "source_id", "nid", "u"), "exports")  # what is told of sessions, turns and warnings reads it
    m = F.col("r.info.model")
    head = files.select(F.col("source_id").alias("sid"), text.header_value(m["id"]).alias("model_id"), text.header_value(m["providerID"]).alias("model_provider"), text.header_value(m["variant"]).alias("effort")).dropDuplicates(["sid"])
    sessions = rows.where(good).join(head, F.col("source_id") == F.col("sid"), "left").select(
        "source_id", "adapter", "namespace", "native_id", "locator", F.col("u").cast("string").alias("fingerprint"), F.col("e.directory").alias("project_hint"), text.epoch_time(F.col("c"), "ms").alias("started_at"),
        text.epoch_time(F.col("u"), "ms").alias("updated_at"), F.col("e.title").alias("title"), F.lit("unknown").alias("health"), "model_id", "model_provider", "effort",
    )
    told, broken_messages = _export_turns(files)
    stale = files.where(F.col("r.info.time.updated") != F.col("u"))
    broken = files.where("r.messages is null")
    warnings = _warnings(rows.where(~good), "unsupported-session", F.col("locator")).unionByName(_warnings(stale, "source-changed", F.col("path"))).unionByName(_warnings(broken, "malformed-export", F.col("path")))
    warnings = warnings.unionByName(_warnings(crowded, "catalog-limit", F.concat(F.lit("more than "), F.lit(str(CATALOG_LIMIT))))).unionByName(_warnings(broken_messages, "malformed-message", F.col("at_").cast("string")))
    return Scan(_sessions(sessions), _turns(told, 0, ("created", "mid")), warnings)


def _store_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The meta row of each chat store, a SQLite file; null where it can't be read."""
    for batch in batches:
        out = []
        for content in batch["content"]:
            db = sqlite3.connect(":memory:")
            try:
                db.deserialize(bytes(content))
                row = db.execute("SELECT value FROM meta WHERE key = '0'").fetchone()
                out.append(row[0] if row and isinstance(row[0], str) else None)
            except sqlite3.Error:
                out.append(None)
            finally:
                db.close()
        yield pd.DataFrame({"path": batch["path"], "value": out})


def _sidecars(spark: SparkSession, chats: str) -> DataFrame:
    """(nid, workspace, s, store, print, broken_meta, broken_store): what lies beside a chat, by chat and workspace folder."""
    at = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("nid"), F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]+$", 1).alias("workspace")
    kinds = "title string, createdAtMs bigint, updatedAtMs bigint, cwd string"
    if (read := taken(spark, chats, "{meta.json,store.db}", "*", links=True)) is not None:
        files = read.rows.select(F.concat(F.lit("/"), "name").alias("path"), "content")
    else:
        files = read_files(spark, chats, "{meta.json,store.db}", lambda r, at: r.format("binaryFile").load(at).select("path", "content"))
    is_meta = F.endswith("path", F.lit("/meta.json"))
    meta = files.where(is_meta).select(*at, F.decode("content", "UTF-8").alias("value"), F.sha2("content", 256).alias("meta_print"))
    meta = meta.withColumn("broken_meta", ~F.startswith(F.ltrim("value"), F.lit("{")) | F.try_parse_json("value").isNull()).withColumn("s", guarded.parsed(F.col("value"), kinds)).drop("value")
    store = files.where(~is_meta)
    values = store.mapInPandas(_store_values, "path string, value string").select(*at, store_meta(F.col("value")).alias("store"))
    values = values.withColumn("broken_store", F.col("store").isNull())
    prints = store.select(*at, F.sha2("content", 256).alias("store_print"))
    return meta.join(values, ["nid", "workspace"], "full").join(prints, ["nid", "workspace"], "full")


def cursor(spark: SparkSession, root: str, chats: str | None = None) -> Scan:
    """<slug>/agent-transcripts/<id>/<id>.jsonl; titles, times and the model from what lies beside the chat, meta.json before
    the store. A chat's folder is <md5 of the workspace>/<id>: of several of one id that of the transcript's own workspace
    wins, which its meta.json's folder tells."""
    ns = namespace(root)
    schema = "role string, message struct<content:array<struct<type:string,text:string,name:string,input:struct<model:string>>>>"
    native = F.regexp_extract("path", r"/agent-transcripts/([^/]+)/[^/]+\.jsonl$", 1)
    read = taken(spark, root, "*.jsonl", limit=WHOLE)
    rows = parsed(lines(spark, root, read=read), schema).withColumn("native", native).where("native <> ''").select("*", *_identity("cursor", ns, F.col("native")))
    parts = F.col("r.message.content")
    model = F.get(F.filter(parts, lambda p: (p["type"] == "tool_use") & (p["name"] == "Task") & p["input"]["model"].isNotNull()), F.lit(0))["input"]["model"]
    heads = rows.groupBy("source_id", "adapter", "namespace", "native_id", F.col("path").alias("locator")).agg(F.max("modified").alias("modified"), text.header_value(F.max_by(model, F.when(model.isNotNull(), F.col("line")))).alias("task_model"))
    heads = heads.join(fingerprints(spark, root, read=read).withColumnRenamed("path", "locator"), "locator", "left")
    warnings = _malformed(rows, "malformed-turn").unionByName(unsafe_warnings(spark, root))
    if chats is not None:
        slug = F.regexp_extract("locator", r"/([^/]+)/agent-transcripts/", 1)
        beside = heads.select("source_id", "native_id", slug.alias("slug")).join(_sidecars(spark, chats), F.col("native_id") == F.col("nid"))
        own = (F.col("workspace") == text.workspace_folder(F.col("s.cwd"))) & (text.path_slug(F.ltrim(F.col("s.cwd"), F.lit("/"))) == F.col("slug"))
        rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.coalesce(own, F.lit(False)).desc(), "workspace"))
        beside = beside.withColumn("n", rank).where("n = 1").drop("n", "native_id", "nid", "slug")
        heads = heads.join(beside, "source_id", "left")
        drift = heads.select("source_id", F.explode(F.array_compact(F.array(F.when(F.col("broken_meta"), "cursor-meta-drift"), F.when(F.col("broken_store"), "cursor-store-drift")))).alias("code"))
        warnings = warnings.unionByName(_warnings(drift, F.col("code"), F.lit("what lies beside the chat can't be read")))
        heads = heads.withColumn("fingerprint", F.sha2(F.concat_ws("\n", "fingerprint", "meta_print", "store_print").cast("binary"), 256))
    else:
        kinds = {"s": "struct<title:string,createdAtMs:bigint,updatedAtMs:bigint,cwd:string>", "store": "struct<name:string,createdAt:bigint,updatedAt:bigint,lastUsedModel:string,mode:string>"}
        heads = heads.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    ms = lambda c: text.epoch_time(F.col(c), "ms")
    sessions = heads.select(
        "*", F.coalesce(ms("s.createdAtMs"), ms("store.createdAt"), "modified").alias("started_at"), F.coalesce(ms("s.updatedAtMs"), ms("store.updatedAt"), "modified").alias("updated_at"),
        text.first_non_blank(F.trim("s.title"), F.trim("store.name")).alias("title"), F.col("s.cwd").alias("project_hint"), F.lit("unknown").alias("health"),
        text.merged_header(F.col("task_model"), F.col("store.lastUsedModel")).alias("model_id"), text.header_value(F.col("store.mode")).alias("effort"),
    )
    role = F.when(F.col("r.role") == "user", "user").when(F.col("r.role") == "assistant", "agent")
    said = rows.where("ok").withColumn("role", role).withColumn("text", _blocks(parts, ["text"])).withColumn("locator", F.concat(F.lit("line:"), F.col("line").cast("string"))).withColumn("at", F.lit(None).cast("timestamp"))
    return Scan(_sessions(sessions), _turns(said, 1), warnings)


def store_meta(value: Column) -> Column:
    """A chat store's meta row, JSON in hexadecimal: struct(name, createdAt, updatedAt, lastUsedModel, mode)."""
    return guarded.parsed(F.decode(F.unhex(value), "UTF-8"), "name string, createdAt bigint, updatedAt bigint, lastUsedModel string, mode string")


def claude(spark: SparkSession, root: str) -> Scan:
    """projects/<slug>/<id>.jsonl; the last ai-title is the title, content is a text or a list of blocks."""
    ns = namespace(root)
    schema = "type string, timestamp string, sessionId string, cwd string, aiTitle string, message struct<role:string,model:string,content:variant>"
    read = taken(spark, root, "*.jsonl", limit=WHOLE)
    rows = parsed(lines(spark, root, read=read), schema).select("*", *_identity("claude", ns, _stem(F.col("path"))))
    good, when, line = rows.where("ok"), text.parse_time(F.col("r.timestamp"), naive_is_utc=True), F.col("line")
    heads = good.groupBy("source_id", "adapter", "namespace", "native_id", F.col("path").alias("locator")).agg(
        F.coalesce(F.min(when), F.min("modified")).alias("started_at"), F.coalesce(F.max(when), F.max("modified")).alias("updated_at"), F.max_by("r.aiTitle", F.when(F.col("r.type") == "ai-title", line)).alias("title"),
        F.min_by("r.cwd", F.when(F.col("r.cwd").isNotNull(), line)).alias("project_hint"), text.header_value(F.max_by("r.message.model", F.when(F.col("r.message.model").isNotNull(), line))).alias("model_id"),
    )
    heads = heads.join(fingerprints(spark, root, read=read).withColumnRenamed("path", "locator"), "locator", "left").withColumn("model_provider", F.lit("anthropic")).withColumn("health", F.lit("unknown"))
    content = F.col("r.message.content")
    body = F.coalesce(guarded.guarded(content, "string"), _blocks(guarded.guarded(content, "array<struct<type:string,text:string>>"), ["text"]))
    role = F.when(F.col("r.type") == "user", "user").when(F.col("r.type") == "assistant", "agent")
    said = good.withColumn("role", role).withColumn("text", body).withColumn("locator", F.concat(F.lit("line:"), line.cast("string"))).withColumn("at", when)
    return Scan(_sessions(heads), _turns(said, 1), _malformed(rows, "malformed-turn").unionByName(_duplicates(heads)))


PROSE_LIMIT = 4096
TOOL_MARKS = ("<tool_call", "</tool_call", "<function_call", "```tool")


def antigravity(spark: SparkSession, history: str, brain: str, workspace: str | None = None) -> Scan:
    """history.jsonl names conversations of a workspace; each has one transcript below the brain folder."""
    ns = namespace(brain)
    rows = parsed(lines(spark, history, read=taken(spark, history, "*.jsonl", limit=WHOLE)), "display string, timestamp bigint, workspace string, conversationId string")
    known = rows.where("ok").where(F.rlike("r.conversationId", F.lit(rf"^{UUID}$")))
    if workspace is not None:
        known = known.where(F.regexp_replace("r.workspace", r"/+$", "") == workspace.rstrip("/"))
    at = text.epoch_time(F.col("r.timestamp"), "ms")
    named = F.when(F.trim("r.display") != "", F.col("line"))
    heads = known.groupBy(F.col("r.conversationId").alias("nid")).agg(F.min(at).alias("started_at"), F.max(at).alias("updated_at"), F.max_by("r.display", named).alias("title"), F.max_by("r.workspace", "line").alias("project_hint"))
    read = taken(spark, brain, "*.jsonl", limit=WHOLE)
    said = parsed(lines(spark, brain, read=read), "source string, type string, content string, created_at string").withColumn("nid", F.lower(F.regexp_extract("path", rf"(?i)/({UUID})/", 1))).join(heads.select("nid"), "nid", "left_semi")
    said = said.select("*", *_identity("antigravity", ns, F.col("nid")))
    sessions = heads.select("*", *_identity("antigravity", ns, F.col("nid"))).join(said.groupBy("source_id").agg(F.min("path").alias("locator")), "source_id", "left")
    sessions = sessions.join(fingerprints(spark, brain, read=read).withColumnRenamed("path", "locator"), "locator", "left").withColumn("health", F.lit("unknown"))
    c = F.col("r.content")
    asked = F.regexp_extract(c, r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", 1)
    prose = (F.length(c) <= PROSE_LIMIT) & ~F.contains(c, F.lit("file:///")) & ~F.exists(F.array(*map(F.lit, TOOL_MARKS)), lambda m: F.contains(c, m))
    user = (F.col("r.source") == "USER_EXPLICIT") & (F.col("r.type") == "USER_INPUT")
    agent = (F.col("r.source") == "MODEL") & (F.col("r.type") == "PLANNER_RESPONSE") & prose
    told = said.where("ok").withColumn("role", F.when(user, "user").when(agent, "agent")).withColumn("text", F.trim(F.when(user & (asked != ""), asked).otherwise(c)))
    told = told.withColumn("locator", F.concat(F.lit("line:"), F.col("line").cast("string"))).withColumn("at", text.parse_time(F.col("r.created_at"), naive_is_utc=True))
    missing = _warnings(sessions.where("locator is null"), "missing-transcript", F.col("native_id"))
    return Scan(_sessions(sessions), _turns(told, 1), _malformed(said, "malformed-turn").unionByName(missing).unionByName(_malformed(rows, "malformed-history")))


def union(scans: list[Scan]) -> Scan:
    """Several sources as one, in the order given."""
    out = scans[0]
    for s in scans[1:]:
        out = Scan(out.sessions.unionByName(s.sessions), out.turns.unionByName(s.turns), out.warnings.unionByName(s.warnings))
    return out


#: Loaders by source, in the order in which sources are read.
REGISTRY = {"codex": codex, "grok": grok, "cursor": cursor, "claude": claude, "antigravity": antigravity, "opencode": opencode}


def configured(spark: SparkSession, places: dict[str, dict]) -> Scan:
    """All sources that have a place (the loader's arguments), in the registry's order."""
    return union([load(spark, **places[k]) for k, load in REGISTRY.items() if k in places])


def has_files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> bool:
    """Whether a project's folder of a source holds any of its files, which is when the source counts as configured."""
    local = root.removeprefix("file://") if root.startswith("file://") else root
    if "://" not in local and not os.path.isdir(local):
        return False
    return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path").isEmpty()


def reread(now: Scan, records: DataFrame, start: int = 0, stop: int | None = None, after: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns of the half-open range, (source_id, read_status), warnings) of chosen records (source_id, adapter, fingerprint, locator).

    now: the source as it is. A record is refused, and has no turn, if it isn't of this source or isn't there any more, if
    its id stands for another file, or if its content is another; `after`: fingerprints (source_id, fingerprint) taken after
    the read, by which a source that changed meanwhile is refused, too.
    """
    here = now.sessions.select("source_id", F.col("adapter").alias("is_adapter"), F.col("fingerprint").alias("is_print"), F.col("locator").alias("is_locator"))
    rows = records.join(here, "source_id", "left")
    own = F.col("is_adapter").isNotNull()
    changed = F.lit(False)
    if after is not None:
        rows = rows.join(after.select("source_id", F.col("fingerprint").alias("then")), "source_id", "left")
        changed = own & ~F.col("then").eqNullSafe(F.col("is_print"))
    code = (
        F.when(~F.col("adapter").isin(*REGISTRY), "wrong-source")
        .when(~own, "missing-source")
        .when(F.col("adapter") != F.col("is_adapter"), "wrong-source")
        .when(F.col("locator") != F.col("is_locator"), "identity-mismatch")
        .when(F.col("fingerprint") != F.col("is_print"), "source-changed")
        .when(changed, "source-changed-during-read")
    )
    rows = rows.select("source_id", "adapter", code.alias("code"))
    told = _warnings(rows.where("code is not null"), F.col("code"), F.lit("the record wasn't read"))
    kept = rows.where("code is null")
    turns = selected(now.turns.join(kept.select("source_id"), "source_id", "left_semi"), start, stop)
    whole = now.warnings.join(kept.select("source_id"), "source_id", "left_semi").unionByName(told)
    n = turns.groupBy("source_id").agg(F.count("*").alias("turns"))
    w = whole.groupBy("source_id").agg(F.count("*").alias("warned"))
    rows = rows.join(n, "source_id", "left").join(w, "source_id", "left")
    status = F.when(F.coalesce("turns", F.lit(0)) == 0, "unavailable").when((F.coalesce("warned", F.lit(0)) > 0) & F.col("adapter").isin(*STRICT), "partial").otherwise("complete")
    return turns, rows.select("source_id", status.alias("read_status")), whole


def selected(turns: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Turns of the half-open range of ordinals."""
    return turns.where((F.col("ordinal") >= start) & (F.lit(stop is None) | (F.col("ordinal") < F.lit(stop if stop is not None else 0))))
