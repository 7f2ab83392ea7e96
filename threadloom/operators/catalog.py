"""Catalog maintenance: upserts, handles, tombstones, titles, purges, and versions that switch as a whole."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from threadloom.functions import redaction, text
from threadloom.schema import HANDLE_LETTERS, OTHER_LETTER


#: Tables in the order in which they go: what refers to another one before it.
PURGE_ORDER = ("maxima", "postings", "capsules", "edges", "checkpoints", "sessions")


def handle_letter(adapter: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in HANDLE_LETTERS.items() for x in kv))[adapter], F.lit(OTHER_LETTER))


def upsert_sessions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored sessions with the fresh ones over them: a fresh title wins if there is one, and the source is available again.

    Both sides are keyed by source_id, so one shuffle on it serves the join and what follows by that key.
    """
    columns = [c for c in stored.columns if c != "source_id"]
    old, new = stored.alias("old"), fresh.alias("new")
    both = old.join(new, "source_id", "full")
    is_new = F.col("new.adapter").isNotNull()

    def merged(c: str) -> Column:
        if c == "title":
            return F.coalesce(F.col("new.title"), F.col("old.title"))
        if c == "native_available":
            return F.when(is_new, F.lit(True)).otherwise(F.col("old.native_available"))
        if c not in fresh.columns:
            return F.col(f"old.{c}")
        return F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    return both.select("source_id", *(merged(c).alias(c) for c in columns))


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with those of the same key replaced by the fresh ones; checkpoints and capsules are kept this way."""
    return stored.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def allocate_handles(sessions: DataFrame) -> DataFrame:
    """Handles: the source's letter and a number that runs within project and letter. A handle once given stays."""
    rows = sessions.withColumn("letter", handle_letter(F.col("adapter")))
    old = F.col("handle") if "handle" in sessions.columns else F.lit(None).cast("string")
    rows = rows.withColumn("handle", old)
    mine = F.when(F.startswith("handle", "letter"), F.substring("handle", 2, 18).cast("bigint"))
    last = F.coalesce(F.max(mine).over(Window.partitionBy("project_key", "letter")), F.lit(0))
    order = Window.partitionBy("project_key", "letter", F.col("handle").isNull()).orderBy("started_at", "source_id")
    number = F.row_number().over(order)
    return rows.withColumn("handle", F.coalesce("handle", F.concat("letter", (last + number).cast("string")))).drop("letter")


def resolve_tokens(tokens: DataFrame, sessions: DataFrame, project_key: str) -> DataFrame:
    """(token, source_id, refusal): handles in any case and canonical ids; what names nothing says why."""
    own = sessions.where(F.col("project_key") == project_key).select("source_id", "handle")
    t = tokens.select("token").withColumn("canonical", F.contains("token", F.lit(":"))).withColumn("upper", F.upper("token"))
    ok = F.rlike("upper", F.lit(r"\A[A-Z][1-9][0-9]*\z"))
    parts = F.split("token", ":")
    whole = (F.size(parts) == 3) & F.forall(parts, lambda p: (p != "") & (F.trim(p) == p))
    found = t.join(own, F.when(~t["canonical"], t["upper"]) == own["handle"], "left")
    reason = (
        F.when((F.trim("token") != F.col("token")) | (F.col("token") == ""), "untrimmed")
        .when(F.col("canonical") & ~whole, "malformed-id")
        .when(F.col("canonical"), F.lit(None).cast("string"))
        .when(~ok, "malformed-handle")
        .when(F.col("source_id").isNull(), "unknown-handle")
    )
    return found.select("token", F.when(reason.isNull(), F.when(F.col("canonical"), F.col("token")).otherwise(F.col("source_id"))).alias("source_id"), reason.alias("refusal"))


def delete_or_tombstone(sessions: DataFrame, removed: DataFrame, edges: DataFrame) -> DataFrame:
    """Removed sessions go, but those that an edge touches stay, marked as natively gone."""
    gone = removed.select("source_id").distinct().withColumn("gone", F.lit(True))
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("source_id")).distinct().withColumn("linked", F.lit(True))
    rows = sessions.join(gone, "source_id", "left").join(ends, "source_id", "left")
    rows = rows.where(F.col("gone").isNull() | F.col("linked").isNotNull())
    return rows.withColumn("native_available", F.col("native_available") & F.col("gone").isNull()).drop("gone", "linked")


def backfill_titles(sessions: DataFrame, capsules: DataFrame) -> DataFrame:
    """Sessions with a blank title take their capsule's label, redacted and cut."""
    label = capsules.select("source_id", redaction.kept_title(F.col("display_name"), text.TITLE_LIMIT).alias("label"))
    blank = F.col("title").isNull() | (F.trim("title") == "")
    return sessions.join(label, "source_id", "left").withColumn("title", F.when(blank, F.coalesce("label", "title")).otherwise(F.col("title"))).drop("label")


def purge_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of what a purge removes, children before parents."""
    names = [n for n in PURGE_ORDER if n in tables] + sorted(set(tables) - set(PURGE_ORDER))
    counts = [tables[n].agg(F.count("*").alias("rows")).select(F.lit(i).alias("step"), F.lit(n).alias("table"), "rows") for i, n in enumerate(names)]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


class Conflict(RuntimeError):
    """Somebody else has committed to what this commit was derived from."""


class Tables(dict):
    """A version's tables by name, and the version that they are of."""

    def __init__(self, version: dict, tables: dict[str, DataFrame]) -> None:
        super().__init__(tables)
        self.version = version

    @property
    def number(self) -> int:
        return self.version["number"]


#: A catalog without a version.
EMPTY = {"number": 0, "tables": {}}


def _parted(root: Catalog, held: dict) -> dict:
    """Form 2 of a version of form 1, whose tables are folders by project: their rows are dealt into parts."""
    tables = {}
    for name in held["tables"]:
        df = root.spark.read.parquet(f"{root.root}/{held['snapshot']}/{name}")
        if "project_key" in df.columns:
            df = df.withColumn("project_key", F.col("project_key").cast("string"))
        tables[name] = {"schema": json.loads(df.schema.json()), "parts": root._write(name, df, 0)}
    return {"schema_version": 2, "tables": tables}


def _logged(root: Catalog, held: dict) -> dict:
    """Form 3 of a version of form 2, whose tables have no segments: what they have is their base."""
    return {"schema_version": 3, "tables": held["tables"]}


class Catalog:
    """Versioned tables in a folder of any store that Spark reads.

    A version is a small numbered file that names, for each table, its schema and the folders of each part. A commit writes
    folders of its own and then creates the next number's file, whole and under a name that must not be there yet; no file
    is ever replaced. Readers take the highest number whose file is whole, so they see all of a commit or nothing, whenever
    a writer dies. Rows with a project_key are dealt into PARTS parts by it: what a commit doesn't touch is named again.

    Commits compare and set. A commit tells the version that its rows were derived from (by default the one that this
    catalog has handed out or written last). If a part that it touches isn't in the newest version as it was in that one,
    the commit is refused and its data is removed; if only other parts have changed, it is put on top of them. Two writers
    never lose each other's rows.

    commit() writes parts whole. change() appends a segment: the new rows, and the keys whose earlier rows they replace or
    that are gone; readers leave those out. So what a change writes grows with the change and not with the table. merge()
    joins a part's latest segments, as many as aren't much larger than those after them, so there are few of them and a row
    is written again a logarithmic number of times. A base and its segments are numbered by the version they came from.

    The store must refuse to rename a file over another one, as HDFS does; on a local disk a hard link does that. Folders
    that none of the last KEPT versions names are removed; a dead writer's, once they are PATIENCE seconds old.
    """

    VERSION, PARTS, KEPT, PATIENCE = 3, 64, 2, 86400
    #: Numbers of swept versions that are remembered, so that a slow writer can't take one again.
    MARKS = 10_000
    #: A segment is joined with those after it if it is at most so many times their size.
    GROWTH = 2
    #: From each form to the next; a form is a whole version file, so a crash between two steps loses nothing.
    MIGRATIONS = {1: _parted, 2: _logged}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.seen: dict = EMPTY

    # ------------------------------------------------------------ files

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self._list("versions") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def _text(self, name: str) -> str:
        """A file's text; FileNotFoundError if it has gone meanwhile."""
        try:
            stream = self._fs().open(self._path(name))
        except Exception as e:  # the store's own kinds of error
            if self._fs().exists(self._path(name)):
                raise
            raise FileNotFoundError(name) from e
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _parsed(self, name: str) -> dict | None:
        try:
            return json.loads(self._text(name))
        except ValueError:
            return None

    def _read(self, number: int) -> dict | None:
        """A version's file; None if its writer died over it, or if it is of an earlier form."""
        held = self._parsed(f"versions/{number:012d}.json")
        return held if held and held["schema_version"] == self.VERSION else None

    def _listed(self, most: int) -> tuple[list[dict], int]:
        """The newest whole versions of whatever form, at most so many, and the highest number that is taken, of one listing.

        A version that goes while it is read has been followed by others, so they are listed again.
        """
        while True:
            numbers, found = self._numbers(), []
            try:
                for n in reversed(numbers):
                    if len(found) < most and (held := self._parsed(f"versions/{n:012d}.json")) is not None:
                        found.append(held)
                if not numbers and self._fs().exists(self._path("CURRENT")):
                    found = [x for x in [self._parsed("CURRENT")] if x is not None]
                return found, max([0, *numbers])
            except FileNotFoundError:
                continue

    def _latest(self) -> dict | None:
        """The newest whole version of whatever form."""
        return next(iter(self._listed(1)[0]), None)

    def _checked(self, found: list[dict]) -> list[dict]:
        """Versions of the present form. A catalog of an unknown form is an error, and so is one that wants a migration."""
        if found and found[0]["schema_version"] != self.VERSION:
            held, newer = found[0], found[0]["schema_version"] > self.VERSION
            raise ValueError(f"the catalog's version {held['schema_version']} is {'newer' if newer else 'older'} than {self.VERSION}" + ("" if newer else ": migrate() it"))
        return [x for x in found if x["schema_version"] == self.VERSION]

    def _whole(self, most: int) -> list[dict]:
        """The newest whole versions, at most so many."""
        return self._checked(self._listed(most)[0])

    def current(self) -> dict | None:
        return next(iter(self._whole(1)), None)

    def migrate(self) -> list[int]:
        """Takes an older catalog step by step to the present form; the forms that it went through.

        Each step writes the next form as a version of its own. A step that dies leaves the form before it as the newest,
        and is done again; steps must lead from each form to the next without a gap.
        """
        done = []
        while (held := self._latest()) is not None and held["schema_version"] < self.VERSION:
            step = self.MIGRATIONS.get(held["schema_version"])
            if step is None:
                raise ValueError(f"no migration leads on from {held['schema_version']}")
            number = max([0, *self._numbers()]) + 1
            self._publish(number, json.dumps(step(self, held) | {"number": number, "id": uuid.uuid4().hex}))
            done.append(held["schema_version"] + 1)
        self.current()
        return done

    # ------------------------------------------------------------ reading

    @classmethod
    def part_of(cls, project_key: str) -> str:
        return str(zlib.crc32(project_key.encode()) % cls.PARTS)

    @classmethod
    def part(cls, project_key: Column) -> Column:
        """The number of part_of() as a column."""
        return F.crc32(F.coalesce(project_key, F.lit("")).cast("binary")) % cls.PARTS

    def tables(self, parts: Iterable[str] | None = None) -> Tables:
        """The tables, typed as they were committed; with `parts` only those are read of tables that have parts."""
        held = self.current() or EMPTY
        self.seen = held
        wanted = None if parts is None else set(parts) | {"all"}
        return Tables(held, {name: self._rows(table, wanted) for name, table in held["tables"].items()})

    def numbered(self, name: str, parts: Iterable[str] | None = None, version: dict | None = None) -> DataFrame:
        """A table with `_at`, the number of the segment that each row came in."""
        table = (version or self.current())["tables"][name]
        return self._rows(table, None if parts is None else set(parts) | {"all"}, numbered=True)

    def _rows(self, table: dict, wanted: set[str] | None, numbered: bool = False, segments: dict[str, set[str]] | None = None) -> DataFrame:
        """A table's rows without those that later segments replace; segments: for each part the folders that are read."""
        schema = StructType.fromJson(table["schema"])
        chosen = lambda k: wanted is None or k in wanted
        logs = {k: v for k, v in table.get("log", {}).items() if chosen(k)}
        paths = [x for k, x in sorted(table["parts"].items()) if chosen(k)] + [s["rows"] for _, v in sorted(logs.items()) for s in v if s["rows"]]
        if segments is not None:
            paths = [x for x in paths if any(x in v for v in segments.values())]
        gone = [s["gone"] for _, v in sorted(logs.items()) for s in v if s["gone"]]
        if not paths:
            return self.spark.createDataFrame([], StructType([*schema.fields, StructField("_at", LongType())]) if numbered else schema)
        at = F.coalesce(F.expr(r"try_cast(regexp_extract(_metadata.file_path, '.*/data/[^/]+-([0-9]{12})-[0-9a-f]{32}/', 1) as bigint)"), F.lit(0))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in paths))
        if not gone and not numbered:
            return rows
        rows = rows.withColumn("_at", at)
        if gone:
            key = table["key"]
            last = self.spark.read.schema(f"{key} string, project_key string").parquet(*(f"{self.root}/{x}" for x in gone)).withColumn("_gone", at)
            last = last.groupBy(F.col(key).alias("_key"), F.col("project_key").alias("_project")).agg(F.max("_gone").alias("_gone"))
            rows = rows.join(last, (F.col(key) == F.col("_key")) & F.col("project_key").eqNullSafe(F.col("_project")) & (F.col("_at") < F.col("_gone")), "left_anti")
        return rows if numbered else rows.drop("_at")

    # ------------------------------------------------------------ writing

    def _write(self, name: str, df: DataFrame, at: int, sort: list[str] | None = None, touched: list[str] | None = None) -> dict[str, str]:
        """The folder of each part of a table's rows, written as of a number."""
        folder = f"data/{name}-{at:012d}-{uuid.uuid4().hex}"
        if "project_key" not in df.columns:
            df.write.parquet(f"{self.root}/{folder}")
            return {"all": folder}
        rows = df.withColumn("_part", self.part(F.col("project_key")))
        if touched is not None:
            rows = rows.where(F.col("_part").isin([int(x) for x in touched]))
        if sort:
            # by ranges, so that a value which is most of a part is still several files
            rows = rows.repartitionByRange("_part", *sort).sortWithinPartitions("_part", *sort)
        rows.write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        return {n.removeprefix("_part="): f"{folder}/{n}" for n in self._list(folder) if n.startswith("_part=")}

    def commit(self, tables: dict[str, DataFrame], parts: Iterable[str] | None = None, sort: dict[str, list[str]] | None = None, read: dict | None = None, reads: Iterable[str] | None = None) -> int:
        """Writes parts of tables whole, as the next version; its number. Tables that aren't given stay as they are.

        parts: those whose rows may have changed; all others are kept unread. sort: columns by which a table's files are
        sorted. read: the version that the rows were derived from; reads: the tables that they were derived from, all if
        it isn't told.
        """
        read = self.seen if read is None else read
        touched = None if parts is None else sorted(set(parts))
        new = {}
        for name, df in tables.items():
            whole = touched is None or name not in read["tables"] or "project_key" not in df.columns
            new[name] = (whole, json.loads(df.schema.json()), self._write(name, df, read["number"] + 1, (sort or {}).get(name), None if whole else touched))

        def put(now: dict) -> dict:
            out = dict(now)
            for name, (whole, schema, folders) in new.items():
                had = {} if whole else now[name]
                keep = lambda x: {k: v for k, v in x.items() if k not in touched}
                out[name] = {"schema": schema, "parts": keep(had["parts"]) | folders if had else folders}
                if had.get("log") and keep(had["log"]):
                    out[name] |= {"key": had["key"], "log": keep(had["log"])}
            return out

        return self._settle(read, touched, reads, put, [x for _, _, f in new.values() for x in f.values()])

    def change(self, tables: dict[str, DataFrame], gone: dict[str, DataFrame], parts: Iterable[str], sort: dict[str, list[str]] | None = None, read: dict | None = None, key: str = "source_id") -> int:
        """Appends rows to tables, and takes away the earlier rows of the keys in `gone` (project_key, key) of each table; the version's number.

        parts: all that the rows and the keys are of. Tables must have a project_key.
        """
        read = self.seen if read is None else read
        touched, at = sorted(set(parts)), read["number"] + 1
        new: dict[str, tuple] = {}
        for name in {**tables, **gone}:
            known = name in read["tables"]
            rows = self._write(name, tables[name], at, (sort or {}).get(name)) if name in tables else {}
            away = self._write(f"{name}.gone", gone[name].select("project_key", F.col(key).cast("string").alias(key)), at) if known and name in gone else {}
            new[name] = (json.loads(tables[name].schema.json()) if name in tables else read["tables"][name]["schema"], rows, away)
        folders = [x for _, rows, away in new.values() for x in [*rows.values(), *away.values()]]
        if not {k for _, rows, away in new.values() for k in [*rows, *away]} <= set(touched):
            self._remove(folders)
            raise ValueError("the rows are of parts that aren't told")
        size = {x: self._fs().getContentSummary(self._path(x)).getLength() for x in folders}

        def put(now: dict) -> dict:
            out = dict(now)
            for name, (schema, rows, away) in new.items():
                table = now.get(name, {"schema": schema, "parts": {}})
                base, log = dict(table["parts"]), {k: list(v) for k, v in table.get("log", {}).items()}
                for k in sorted({*rows, *away}, key=int):
                    if k not in base and k not in log:
                        base |= {k: rows[k]} if k in rows else {}
                    else:
                        log.setdefault(k, []).append({"at": at, "rows": rows.get(k), "gone": away.get(k), "bytes": size.get(rows.get(k), 0) + size.get(away.get(k), 0)})
                out[name] = {"schema": table["schema"], "parts": base, "key": key, "log": log}
            return out

        return self._settle(read, touched, None, put, folders)

    def merge(self, every: bool = False, sort: dict[str, list[str]] | None = None, derived: dict | None = None) -> int | None:
        """Joins the latest segments of each part, all of them if `every`; the version's number, None if there is nothing to join.

        The tables of one part are joined from the same segment on. derived: by table, what makes its joined rows of the
        other joined tables, its own rows and the number that each part is joined from.
        """
        held = self.current() or EMPTY
        first = self._joinable(held, every)
        if not first:
            return None
        at, made, written, folders = held["number"] + 1, {}, {}, []
        logged = {n: t for n, t in held["tables"].items() if t.get("log")}
        own = lambda t, k: [s for s in t.get("log", {}).get(k, []) if s["at"] >= first[k]]
        for name, table in logged.items():
            chosen = {k: {s["rows"] for s in own(table, k) if s["rows"]} | ({table["parts"][k]} if first[k] == 0 and k in table["parts"] else set()) for k in first}
            made[name] = self._rows(table, set(first), segments=chosen)
        starts = self.spark.createDataFrame([(int(k), n) for k, n in first.items()], "_part int, _from bigint")
        for name, make in (derived or {}).items():
            if name in made:
                made[name] = make(made, made[name], starts, self.part)
        for name, df in made.items():
            rows = self._write(name, df, at, (sort or {}).get(name))
            older = [s["gone"] for k in first if first[k] for s in own(logged[name], k) if s["gone"]]
            key = logged[name]["key"]
            away = {}
            if older:
                gone = self.spark.read.schema(f"{key} string, project_key string").parquet(*(f"{self.root}/{x}" for x in older)).distinct()
                away = self._write(f"{name}.gone", gone, at)
            written[name] = (rows, away)
            folders += [*rows.values(), *away.values()]
        size = {x: self._fs().getContentSummary(self._path(x)).getLength() for x in folders}

        def put(now: dict) -> dict:
            out = dict(now)
            for name, (rows, away) in written.items():
                table = now[name]
                base, log = dict(table["parts"]), dict(table["log"])
                for k, start in first.items():
                    kept = [s for s in log.get(k, []) if s["at"] < start]
                    if start:
                        joined = {"at": at, "rows": rows.get(k), "gone": away.get(k), "bytes": size.get(rows.get(k), 0) + size.get(away.get(k), 0)}
                        log[k] = [*kept, *([joined] if joined["rows"] or joined["gone"] else [])]
                    else:
                        base.pop(k, None)
                        log.pop(k, None)
                        base |= {k: rows[k]} if k in rows else {}
                out[name] = table | {"parts": base, "log": {k: v for k, v in log.items() if v}}
            return out

        return self._settle(held, sorted(first), None, put, folders)

    def _joinable(self, held: dict, every: bool) -> dict[str, int]:
        """For each part whose segments want joining the number of the first one that is joined, 0 for the base."""
        sizes: dict[str, dict[int, int]] = {}
        for table in held["tables"].values():
            for k, log in table.get("log", {}).items():
                for s in log:
                    own = sizes.setdefault(k, {})
                    own[s["at"]] = own.get(s["at"], 0) + s["bytes"]
        for table in held["tables"].values():
            for k in sizes:
                if table.get("log") and k in table["parts"]:
                    sizes[k][0] = sizes[k].get(0, 0) + self._fs().getContentSummary(self._path(table["parts"][k])).getLength()
        out = {}
        for k, own in sizes.items():
            order = sorted(own)
            i, total = len(order) - 1, own[order[-1]]
            while i and (every or own[order[i - 1]] <= self.GROWTH * total):
                i -= 1
                total += own[order[i]]
            if i < len(order) - 1:
                out[k] = order[i]
        return out

    def _settle(self, read: dict, touched: list[str] | None, reads: Iterable[str] | None, put, folders: list[str]) -> int:
        """Publishes what put() makes of the newest version, unless what was read has changed in it."""
        while True:
            # of one listing: a number that is taken after it can't be taken again
            found, last = self._listed(1)
            now = next(iter(self._checked(found)), EMPTY)
            names = {*read["tables"], *now["tables"]} if reads is None else set(reads)
            if now["number"] != read["number"] and any(self._state(read, n, touched) != self._state(now, n, touched) for n in names):
                self._remove(folders)
                raise Conflict(f"what was read in version {read['number']} isn't so in version {now['number']}")
            version = {"schema_version": self.VERSION, "number": last + 1, "id": uuid.uuid4().hex, "tables": put(now["tables"])}
            try:
                self._publish(version["number"], json.dumps(version))
            except Conflict:
                continue  # somebody was faster: whether that matters shows when the newest version is looked at again
            if self._used(version["number"]) not in (None, version["id"]):
                # so many versions have come since the listing that this number's has been swept already
                self._fs().delete(self._path(f"versions/{version['number']:012d}.json"), False)
                self._remove(folders)
                raise Conflict(f"version {version['number']} has been written by somebody else")
            self.seen = version
            self._sweep()
            return version["number"]

    def _used(self, number: int) -> str | None:
        """The id of the version that had this number before it was swept."""
        name = f"versions/{number:012d}.gone"
        try:
            return self._text(name)
        except FileNotFoundError:
            return None

    @staticmethod
    def _state(version: dict, name: str, touched: list[str] | None) -> dict | None:
        """What a version says of a table's parts."""
        table = version["tables"].get(name)
        if table is None:
            return None
        own = lambda x: {k: v for k, v in x.items() if touched is None or k in touched or k == "all"}
        return {"parts": own(table["parts"]), "log": own(table.get("log", {}))}

    def _remove(self, folders: list[str]) -> None:
        for x in {"/".join(f.split("/")[:2]) for f in folders}:
            self._fs().delete(self._path(x), True)

    def _publish(self, number: int, text: str) -> None:
        """Creates a version's file with all of its text; Conflict if the number is taken."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        final, draft = self._path(f"versions/{number:012d}.json"), self._path(f"versions/_{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                place = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(place(final), place(draft))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as e:  # the store's own kinds of error
            if not fs.exists(final):
                raise
            raise Conflict(f"version {number} has been written by somebody else") from e
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)

    def _sweep(self) -> None:
        """Removes versions before the last KEPT whole ones, the data that they name and no kept one does, and what dead writers left.

        A dead writer's data can't be told from a living one's work but by its age.
        """
        whole = self._whole(self.KEPT)
        kept = set().union(*map(self._folders, whole))
        for n in self._numbers():
            if n < whole[-1]["number"]:
                try:
                    old = self._read(n)  # the data of an earlier form goes by its age
                except FileNotFoundError:  # somebody else is sweeping
                    continue
                # a number that has been used says so before it is free
                self._marked(n, old.get("id", "") if old else "")
                for folder in sorted(self._folders(old) - kept) if old else ():
                    self._fs().delete(self._path(f"data/{folder}"), True)
                self._fs().delete(self._path(f"versions/{n:012d}.json"), False)
        for name in self._list("versions"):
            if name.endswith(".gone") and int(name.removesuffix(".gone")) < whole[-1]["number"] - self.MARKS:
                self._fs().delete(self._path(f"versions/{name}"), False)
        if self._fs().exists(self._path("data")):
            now = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
            for s in self._fs().listStatus(self._path("data")):
                if s.getPath().getName() not in kept and now - s.getModificationTime() > 1000 * self.PATIENCE:
                    self._fs().delete(s.getPath(), True)

    def _marked(self, number: int, text: str) -> None:
        path = self._path(f"versions/{number:012d}.gone")
        if self._fs().exists(path):
            return
        try:
            out = self._fs().create(path, False)
        except Exception:  # noqa: BLE001  somebody else is sweeping
            return
        out.write(bytearray(text.encode()))
        out.close()

    @staticmethod
    def _folders(version: dict) -> set[str]:
        """The folders of data that a version names."""
        named = [x for t in version["tables"].values() for x in t["parts"].values()]
        named += [x for t in version["tables"].values() for log in t.get("log", {}).values() for s in log for x in (s["rows"], s["gone"]) if x]
        return {x.split("/")[1] for x in named}

    def purge(self, confirmed: bool = False) -> dict[str, int]:
        """Removes all versions, then all data, and tells how many rows each table had, children before parents."""
        if not confirmed:
            raise ValueError("a purge must be confirmed")
        counts = {n: df.count() for n, df in self.tables().items()}
        for name in ("versions", "data", "CURRENT", *(n for n in self._list("") if n.startswith("snapshot-"))):
            self._fs().delete(self._path(name), True)
        self.seen = EMPTY
        order = {n: i for i, n in enumerate(PURGE_ORDER)}
        return dict(sorted(counts.items(), key=lambda x: (order.get(x[0], len(order)), x[0])))
