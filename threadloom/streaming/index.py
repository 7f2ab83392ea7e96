"""Indexing as a stream: each micro-batch of changed sessions goes through the batch operators into the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import capsules, catalog, search
from threadloom.plans.storage import dropped, stored

#: A stream's rows: a whole session in each, as a loader gives it, with its turns.
STREAM = "source_id string, project_key string, adapter string, native_id string, fingerprint string, title string, health string, started_at timestamp, updated_at timestamp, op string, turns array<struct<ordinal:int,role:string,text:string,locator:string>>"


#: Columns by which a table's files are sorted, so that a search's terms are pruned by the files' own statistics.
SORTED = {"postings": ["term", "project_key", "block", "source_id"], "maxima": ["term", "project_key", "block"]}
#: How often a batch is derived again from what another writer has committed meanwhile.
TRIES = 20


def apply_batch(store: catalog.Catalog, batch: DataFrame) -> dict[str, int]:
    """One micro-batch: unchanged fingerprints are skipped, changed sessions condensed and indexed, removed ones tombstoned,
    and all of it committed as one version. What is written grows with the batch: new rows are a segment of their own, and
    keys take the rows of earlier segments away. If another writer has committed to the same parts meanwhile, the batch is
    derived again from what is there now. Given the same batch again, nothing changes, so a retried batch does no harm."""
    last = batch.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("updated_at"), F.desc("fingerprint")))).where("_n = 1").drop("_n")
    last = last.persist()
    try:
        for _ in range(TRIES):
            try:
                return _applied(store, last)
            except catalog.Conflict:
                continue
        raise catalog.Conflict(f"the batch was refused {TRIES} times")
    finally:
        last.unpersist()


def _applied(store: catalog.Catalog, last: DataFrame) -> dict[str, int]:
    held = store.tables()
    was = held["sessions"].select("source_id", F.col("fingerprint").alias("was"), F.col("project_key").alias("was_in")) if held else last.select("source_id", "fingerprint", "project_key").toDF("source_id", "was", "was_in").limit(0)
    last = last.join(was, "source_id", "left").where((F.col("op") == "removed") | F.col("was").isNull() | (F.col("was") != F.col("fingerprint"))).persist()
    made: list[DataFrame] = []
    try:
        fresh = last.where("op <> 'removed'")
        n = {"indexed": fresh.count(), "removed": last.where("op = 'removed' and was is not null").count()}
        if not any(n.values()):
            return n
        # a session may have moved from another project's part
        keys = last.select(F.explode(F.array("project_key", "was_in")).alias("p")).where("p is not null")
        parts = [str(r[0]) for r in keys.select(store.part(F.col("p"))).distinct().collect()]
        sessions = fresh.drop("op", "turns", "was", "was_in").withColumn("native_available", F.lit(True))
        turns = fresh.select("source_id", F.explode("turns").alias("t")).select("source_id", "t.*")
        documents = capsules.build(sessions, turns)
        # written once: a sort by ranges looks at its rows before it deals them, and several tables come of each
        documents = stored(documents.withColumn("length", F.size(search.words(F.col("search_text")))), "batch-capsules")
        index = stored(search.with_blocks(search.postings(documents), documents), "batch-postings")
        made += [documents, index]
        best = search.maxima(index)
        # the rows that a session had in the part where it was
        touched = last.where("was_in is not null").select(F.col("was_in").alias("project_key"), "source_id", "op")
        gone = {}
        if held:
            mine = store.tables(parts)
            edges = mine.get("edges", mine["sessions"].select("source_id", F.col("source_id").alias("target_id")).limit(0))
            near = mine["sessions"].join(touched.select("source_id"), "source_id", "left_semi")
            after = catalog.delete_or_tombstone(catalog.upsert_sessions(near, sessions), last.where("op = 'removed'"), edges)
            # of a removed session that is still linked to only the mark changes
            left = touched.join(after.select("source_id").join(last.where("op = 'removed'").select("source_id"), "source_id", "left_semi"), "source_id", "left_anti").drop("op")
            old = store.numbered("capsules", parts, mine.version).join(left, ["project_key", "source_id"], "left_semi").select("project_key", "source_id", "search_text", "_at")
            best = best.unionByName(search.withdrawn(old)) if "maxima" in mine else best
            gone = {"sessions": touched, "capsules": left, "postings": left}
            sessions = after
        new = {"sessions": sessions, "capsules": documents, "postings": index}
        if not held or "maxima" in held:
            new["maxima"] = best
        store.change(new, gone, parts, SORTED, held.version)
        try:
            store.merge(sort=SORTED, derived={"maxima": search.joined_maxima})
        except catalog.Conflict:  # the next batch joins them
            pass
        return n
    finally:
        last.unpersist()
        for table in made:
            dropped(table)


def index_stream(spark: SparkSession, incoming: str, root: str, checkpoint: str, on_batch: Callable[[dict[str, int]], None] | None = None):
    """Indexes what lies in a folder of Parquet files and ends; files that come later are taken by the next call."""
    store = catalog.Catalog(spark, root)

    def each(batch: DataFrame, _: int) -> None:
        found = apply_batch(store, batch)
        if on_batch:
            on_batch(found)

    stream = spark.readStream.schema(STREAM).parquet(incoming).writeStream.foreachBatch(each)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
