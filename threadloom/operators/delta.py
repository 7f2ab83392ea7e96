"""Change detection by fingerprints: what is new, changed, unchanged or gone since a checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKPOINT_VERSION = 2


def fingerprint_delta(current: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(source_id, fingerprint, previous, validated, op). An unchanged source whose last read wasn't validated counts as changed.

    One full outer join on the key; nothing of the content is needed, so it is the narrowest shuffle there is.
    """
    now = current.select("source_id", "fingerprint")
    valid = F.col("validated") if "validated" in checkpoint.columns else F.lit(True)
    old = checkpoint.select("source_id", F.col("fingerprint").alias("previous"), valid.alias("validated"))
    op = (
        F.when(F.col("previous").isNull(), "new")
        .when(F.col("fingerprint").isNull(), "removed")
        .when((F.col("fingerprint") == F.col("previous")) & F.col("validated"), "unchanged")
        .otherwise("changed")
    )
    return now.join(old, "source_id", "full").select("source_id", "fingerprint", "previous", "validated", op.alias("op"))


def removed(checkpoint: DataFrame, seen: DataFrame, protected: DataFrame, complete: bool) -> DataFrame:
    """Sources of the checkpoint that are gone; none unless the enumeration was complete, and none that a warning names."""
    rows = checkpoint.select("source_id").join(seen.select("source_id"), "source_id", "left_anti").join(protected.select("source_id"), "source_id", "left_anti")
    return rows if complete else rows.where(F.lit(False))


def next_checkpoint(delta: DataFrame, read: DataFrame, gone: DataFrame) -> DataFrame:
    """(source_id, fingerprint, validated) after a run. read: (source_id, valid) of sources that could be read; gone: what removed() names.

    It begins as a copy of the checkpoint: a source that wasn't seen, or couldn't be read, keeps its state until it is known
    to be gone. New content that is invalid leaves the last good state; if there is none, it is kept as not validated.
    """
    rows = delta.join(read.select("source_id", "valid"), "source_id", "left").join(gone.select("source_id"), "source_id", "left_anti")
    taken = (F.col("op") == "unchanged") | (F.col("op").isin("new", "changed") & (F.col("valid") | (F.col("valid").isNotNull() & F.col("previous").isNull())))
    taken = F.coalesce(taken, F.lit(False))
    good = F.when(taken, (F.col("op") == "unchanged") | F.col("valid")).otherwise(F.col("validated"))
    rows = rows.select("source_id", F.when(taken, F.col("fingerprint")).otherwise(F.col("previous")).alias("fingerprint"), good.alias("validated"))
    return rows.where(F.col("fingerprint").isNotNull())


def retained_warnings(delta: DataFrame, read: DataFrame) -> DataFrame:
    """Warnings of sources whose new content is invalid, so that their last good state stays."""
    rows = delta.join(read.where(~F.col("valid")).select("source_id"), "source_id", "left_semi").where(F.col("previous").isNotNull() & F.col("op").isin("new", "changed"))
    return rows.select(F.lit("last-known-good-retained").alias("code"), F.lit("content is invalid").alias("message"), "source_id", F.lit(None).cast("string").alias("project_hint"))


def removed_elsewhere(gone: DataFrame, retained: DataFrame) -> DataFrame:
    """Removed sources but for those that another scope of the same source still holds."""
    return gone.join(retained.select("source_id"), "source_id", "left_anti")


def checked_batch(changed: DataFrame, gone: DataFrame) -> DataFrame:
    """(source_id) of sources that a run both changed and removed; a run that has any is faulty and must not be committed."""
    return changed.select("source_id").intersect(gone.select("source_id"))


def usable_checkpoint(checkpoint: DataFrame, scope: str) -> DataFrame:
    """Rows of the scope in a version that is understood; those of the version before are to be validated again, others are dropped."""
    rows = checkpoint.where((F.col("scope") == scope) & F.col("version").between(CHECKPOINT_VERSION - 1, CHECKPOINT_VERSION))
    return rows.withColumn("validated", F.col("validated") & (F.col("version") == CHECKPOINT_VERSION))


def may_advance(warnings: DataFrame) -> DataFrame:
    """One row: whether a checkpoint may advance; an unresolved project hint holds it back."""
    return warnings.agg((~F.coalesce(F.bool_or(F.col("code") == "unresolved-project"), F.lit(False))).alias("advance"))


def skipped(delta: DataFrame, spoken: DataFrame, built: DataFrame) -> DataFrame:
    """Warnings of new and changed sources that a run passes over: without a readable turn (spoken: those with one), or without a capsule (built)."""
    mark = lambda df, c: df.select("source_id", F.lit(True).alias(c)).distinct()
    rows = delta.where(F.col("op").isin("new", "changed")).join(mark(spoken, "spoken"), "source_id", "left").join(mark(built, "built"), "source_id", "left")
    code = F.when(F.col("spoken").isNull(), "session-not-indexed").when(F.col("built").isNull(), "capsule-not-built")
    rows = rows.withColumn("code", code).where("code is not null")
    message = F.when(F.col("code") == "session-not-indexed", "no turn of the changed session can be read").otherwise("no capsule can be made of the changed session")
    return rows.select("code", message.alias("message"), "source_id", F.lit(None).cast("string").alias("project_hint"))


def gated(prior: DataFrame, following: DataFrame, warnings: DataFrame) -> DataFrame:
    """The checkpoint that a run leaves: the following one, past sources that couldn't be read or built, so that one bad record
    doesn't hold a source back for ever; the prior one while a project's folder isn't resolved."""
    may = F.broadcast(may_advance(warnings))
    columns = [c for c in prior.columns if c in following.columns]
    return following.select(*columns).join(may.where("advance")).drop("advance").unionByName(prior.select(*columns).join(may.where("not advance")).drop("advance"))


def rolled_up(statuses: DataFrame, by: list[str]) -> DataFrame:
    """(by, status) of many statuses: broken or unavailable if all are, complete or ready if all are, else partial; of none unavailable."""
    good, bad = F.col("status").isin("complete", "ready"), F.col("status").isin("unavailable", "broken")
    status = F.when(F.coalesce(F.every(bad), F.lit(True)), "unavailable").when(F.every(good), "complete").otherwise("partial")
    return statuses.groupBy(*by).agg(status.alias("status"))


def counters(delta: DataFrame, excluded: DataFrame | None = None, refreshed: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """One row of a run's counters; those of tables that are given: sources of other projects, capsules relabelled, warnings."""
    rows = delta.agg(
        F.count_if(F.col("op").isin("new", "changed")).alias("indexed"),
        F.count_if(F.col("op") == "removed").alias("deleted"),
        F.count_if(F.col("op") == "unchanged").alias("unchanged"),
    )
    for name, df in (("excluded", excluded), ("refreshed", refreshed), ("warnings", warnings)):
        if df is not None:
            rows = rows.join(F.broadcast(df.agg(F.count("*").alias(name))))
    return rows


def told_warnings(warnings: DataFrame, scopes: DataFrame, hints: DataFrame) -> DataFrame:
    """Warnings with `foreign`: proven to be about a session of another project, which only informs.

    scopes: (source_id, scope) of sessions read; hints: (project_hint, scope) of known folders. A session's scope decides,
    else its hint's; without either, and for repeated ids, which may stand for files of two projects, nothing is proven.
    """
    of_source = scopes.select("source_id", F.col("scope").alias("by_source"))
    of_hint = hints.select("project_hint", F.col("scope").alias("by_hint")).where("project_hint is not null")
    rows = warnings.join(of_source, "source_id", "left").join(of_hint, "project_hint", "left")
    proven = (F.col("code") != "duplicate-session-id") & (F.coalesce("by_source", "by_hint") == "foreign")
    return rows.select(*warnings.columns, F.coalesce(proven, F.lit(False)).alias("foreign"))


#: Versions of a cursor that is kept by scope: before LEAST it is dropped, at LEAST its headers are emitted again, CURRENT stands.
CURSOR_LEAST, CURSOR_CURRENT = 2, 3


def scoped_cursors(cursors: DataFrame, adapter: str, namespace: str) -> tuple[DataFrame, DataFrame]:
    """((scope, source_id, fingerprint, revalidate), warnings) of cursors (adapter, namespace, cursor): JSON with a version and a map of scopes.

    A cursor of another adapter, of a version before scopes, or that isn't all well-formed is as good as none; why is a warning.
    """
    body = "schema_version int, scopes map<string,map<string,string>>"
    rows = cursors.withColumn("c", F.from_json("cursor", body))
    own = (F.col("adapter") == adapter) & (F.col("namespace") == namespace)
    prefix = F.lit(f"{adapter}:{namespace}:")
    good_id = lambda k: F.startswith(k, prefix) & (F.size(F.split(k, ":")) == 3) & ~F.endswith(k, F.lit(":"))
    scopes_ok = F.forall(F.map_keys("c.scopes"), lambda k: F.rlike(k, F.lit(r"\A[0-9a-f]{64}\z"))) & F.forall(F.map_values("c.scopes"), lambda m: F.coalesce(F.forall(F.map_keys(m), good_id) & F.forall(F.map_values(m), lambda v: v.isNotNull()), F.lit(False)))
    version = F.col("c.schema_version")
    code = (
        F.when(~own, "checkpoint-scope")
        .when(version == 1, "checkpoint-upgraded")
        .when(F.coalesce(version.between(CURSOR_LEAST, CURSOR_CURRENT) & scopes_ok, F.lit(False)), F.lit(None).cast("string"))
        .otherwise("checkpoint-invalid")
    )
    rows = rows.withColumn("code", code)
    kept = rows.where("code is null").select(F.explode("c.scopes").alias("scope", "prints"), (version == CURSOR_LEAST).alias("revalidate"))
    kept = kept.select("scope", "revalidate", F.explode("prints").alias("source_id", "fingerprint")).select("scope", "source_id", "fingerprint", "revalidate")
    none = F.lit(None).cast("string")
    return kept, rows.where("code is not null").select("code", F.lit("a full scan is due").alias("message"), none.alias("source_id"), none.alias("project_hint"))


def dedup_first(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key, with how many more there were."""
    from pyspark.sql import Window

    by = Window.partitionBy(key)
    return rows.withColumn("n", F.row_number().over(by.orderBy(*order))).withColumn("repeats", F.count("*").over(by) - 1).where("n = 1").drop("n")


def read_status(turns: Column, warnings: Column, strict: bool) -> Column:
    """A read's status: nothing readable is unavailable; a warning makes it partial where the source is strict."""
    return F.when(turns == 0, "unavailable").when((warnings > 0) & F.lit(strict), "partial").otherwise("complete")
