"""Browsing, paging, projections and filters over sessions and their capsules."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import guarded, redaction, text
from threadloom.schema import CAPABILITIES, CAPABILITY_FLAGS, HEALTH_LABELS

PAGE = 5


def filters(
    project_key: str, harness: str | None = None, health: str | None = None, since: datetime | str | None = None, until: datetime | str | None = None
) -> Column:
    """All of the given conditions; the project is always one of them, so it prunes partitions."""
    tests = [F.col("project_key") == project_key]
    if harness is not None:
        tests.append(F.col("adapter") == harness)
    if health is not None:
        tests.append(F.col("health") == health)
    if since is not None:
        tests.append(F.col("updated_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        tests.append(F.col("updated_at") <= F.lit(until).cast("timestamp"))
    return reduce(Column.__and__, tests)


def without(sessions: DataFrame, excluded: DataFrame) -> DataFrame:
    """Sessions whose source_id isn't among the excluded."""
    return sessions.join(excluded.select("source_id").distinct(), "source_id", "left_anti")


def first_user_excerpt(turns: DataFrame) -> DataFrame:
    """(source_id, excerpt): each session's first turn of a user that isn't a host's envelope."""
    own = turns.where((F.col("role") == "user") & ~text.is_envelope(F.col("text")))
    return own.groupBy("source_id").agg(F.min_by("text", "ordinal").alias("excerpt"))


def browse(sessions: DataFrame, turns: DataFrame, where: Column, excluded: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Newest first, ties by source_id. Top rows are chosen before the turns are joined, so a limit prunes the join."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    rows = sessions.where(where)
    if excluded is not None:
        rows = without(rows, excluded)
    # as a capsule needs a visible turn, sessions without one aren't shown
    rows = rows.join(turns.select("source_id").distinct(), "source_id", "left_semi")
    order = (F.desc("updated_at"), F.asc("source_id"))
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    return rows.join(first_user_excerpt(turns), "source_id", "left").orderBy(*order)


def browse_kept(capsules: DataFrame, sessions: DataFrame, where: Column, excluded: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """As browse(), from the capsules that a catalog keeps: sessions with a capsule, its label, header and first words of a user. No turn is read, and no
    capsule but those of the rows that are left."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    rows = sessions.where(where)
    if excluded is not None:
        rows = without(rows, excluded)
    rows = rows.join(capsules.select("source_id").distinct(), "source_id", "left_semi")
    order = (F.desc("updated_at"), F.asc("source_id"))
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    body = "display_name string, excerpts array<struct<role:string,text:string>>, session_header struct<effort:string,model_id:string,model_provider:string,visible_turn_count:bigint>"
    held = capsules.select("source_id", guarded.parsed(F.col("content_json"), body).alias("c"))
    asked = F.get(F.filter("c.excerpts", lambda e: (e["role"] == "user") & ~text.is_envelope(e["text"])), F.lit(0))["text"]
    return rows.join(held, "source_id").select(*rows.columns, "c.display_name", "c.session_header.*", asked.alias("excerpt")).orderBy(*order)


def items(rows: DataFrame, *also: str) -> DataFrame:
    """Rows as they are shown: redacted again, own and native ids masked, names and snippets bounded; `also`: columns kept as they are."""

    def shown(value: Column) -> Column:
        return text.conceal_ids(text.collapse(F.replace(redaction.redacted_text(value), F.col("source_id"), F.lit("[session]"))))

    fallback = F.concat(F.initcap("adapter"), F.lit(" session · "), text.rfc3339(F.col("updated_at")))
    name = F.coalesce(*(F.when(shown(F.col(c)) != "", shown(F.col(c))) for c in ("display_name", "title", "excerpt") if c in rows.columns), fallback)
    snippet = shown(F.col("snippet" if "snippet" in rows.columns else "excerpt"))
    return rows.select(
        "source_id",
        text.bounded(name, text.LABEL_LIMIT, "…").alias("display_name"),
        F.col("adapter").alias("harness"),
        "updated_at",
        "health",
        shown(F.col("title")).alias("title"),
        text.bounded(snippet, text.SNIPPET_LIMIT, "…").alias("snippet"),
        *also,
    )


def page(rows: DataFrame, number: int, order: list[Column], size: int = PAGE) -> DataFrame:
    """A page of rows with choice numbers that run over all pages; there is at least one page, even of nothing."""
    if number < 1:
        raise ValueError("page numbers begin at 1")
    # top rows of all pages up to this one come from the partitions' own tops; no row beyond them is moved
    top = rows.orderBy(*order).limit(number * size)
    numbered = top.withColumn("choice", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("choice") > (number - 1) * size)


def page_count(rows: DataFrame, size: int = PAGE) -> DataFrame:
    return rows.agg(F.count("*").alias("results")).select("results", F.greatest(F.lit(1), F.ceil(F.col("results") / size)).cast("bigint").alias("pages"))


def checked_page(rows: DataFrame, number: int, order: list[Column], size: int = PAGE) -> DataFrame:
    """As page(); a page beyond the last one is an error."""
    last = page_count(rows, size).first()["pages"]
    if not 1 <= number <= last:
        raise ValueError(f"pages are from 1 to {last}")
    return page(rows, number, order, size)


def item_documents(rows: DataFrame) -> DataFrame:
    """(source_id, document): items as JSON with a nested header; columns that a row lacks are null. choice_number only where rows are numbered."""
    have = set(rows.columns)
    col = lambda c, kind="string": (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    header = F.struct(col("effort"), col("model_id"), col("model_provider"), col("visible_turn_count", "int"))
    fields = [col("display_name"), col("harness"), col("health"), header.alias("session_header"), col("snippet"), col("title"), text.rfc3339(F.col("updated_at")).alias("updated_at")]
    if "choice" in have:
        fields.insert(0, F.col("choice").cast("int").alias("choice_number"))
    return rows.select("source_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def continuity(sessions: DataFrame, size: int = PAGE) -> DataFrame:
    """(project_key, recent_handles): each project's newest sessions' handles, newest first. What git knows is the host's to add."""
    rank = F.row_number().over(Window.partitionBy("project_key").orderBy(F.desc("updated_at"), "source_id"))
    rows = sessions.select("project_key", "handle", rank.alias("r")).where(F.col("r") <= size)
    return rows.groupBy("project_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "handle"))), lambda x: x["handle"]).alias("recent_handles"))


def chosen(numbered: DataFrame, numbers: list[int]) -> DataFrame:
    """Rows by choice number, in the order shown, each once."""
    return numbered.where(F.col("choice").isin(*dict.fromkeys(numbers))).orderBy("choice")


def health_labels(rows: DataFrame) -> DataFrame:
    pairs = F.create_map(*(F.lit(x) for kv in HEALTH_LABELS.items() for x in kv))
    return rows.withColumn("health_label", pairs[F.col("health")])


def with_capabilities(sessions: DataFrame) -> DataFrame:
    """Sessions with their source's flags: a dimension of one row a source, folded into the plan as a map."""
    flags = F.create_map(*(x for k, v in CAPABILITIES.items() for x in (F.lit(k), F.struct(*(F.lit(f).alias(n) for n, f in zip(CAPABILITY_FLAGS, v, strict=True))))))
    return sessions.withColumn("_c", flags[F.col("adapter")]).select(*sessions.columns, "_c.*")


def result_document(delta_counts: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: an index run's counts, its warnings in order, and whether it was whole, as a JSON document."""
    # the first of all come from the partitions' own first ones; no task gathers a run's warnings
    order = ("code", F.asc_nulls_first("source_id"), "message")
    first = warnings.orderBy(*order).limit(8).agg(F.array_sort(F.collect_list(F.struct("code", "source_id", "message"))).alias("first"))
    told = warnings.agg(F.count("*").alias("n")).join(F.broadcast(first))
    rows = delta_counts.crossJoin(told)
    body = F.struct("deleted", "indexed", F.when(F.col("n") > 0, "partial").otherwise("complete").alias("status"), "unchanged", F.col("n").alias("warning_count"), F.col("first").alias("warnings"))
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def current_exclusion(sessions: DataFrame, adapter: str, native_id: str) -> DataFrame:
    """One row: how many sessions the host's own id names (none, one, or several is a refusal) and which."""
    hit = sessions.where((F.col("adapter") == adapter) & (F.col("native_id") == native_id))
    return hit.agg(F.count("*").alias("matches"), F.when(F.count("*") == 1, F.min("source_id")).alias("source_id"))


def session_stats(turns: DataFrame) -> DataFrame:
    """Visible turns, their UTF-8 bytes and their ends, by session."""
    return turns.groupBy("source_id").agg(
        F.count("*").alias("visible_turn_count"),
        F.sum(F.octet_length("text")).cast("bigint").alias("visible_text_bytes"),
        F.min_by("text", "ordinal").alias("first_text"),
        F.max_by("text", "ordinal").alias("last_text"),
        F.max_by("role", "ordinal").alias("last_role"),
    )


def project_map(hints: DataFrame, root: str) -> DataFrame:
    """(project_hint, project_key, scope): what a session's folder says about the project it belongs to."""
    path = F.regexp_replace("project_hint", r"/+\z", "")
    key = F.concat(F.lit("directory:sha256:"), F.sha2(path.cast("binary"), 256))
    scope = F.when(F.col("project_hint").isNull() | (path == ""), "unresolved").when(path == root, "current").otherwise("foreign")
    return hints.select("project_hint", key.alias("project_key"), scope.alias("scope")).distinct()


def presence(sessions: DataFrame) -> DataFrame:
    """Which sources have sessions at all, by project."""
    return sessions.groupBy("project_key", "adapter").agg(F.count("*").alias("sessions"))


def readiness(sessions: DataFrame, capsules: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, rows, status) of each table, and what doesn't fit together."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("component"), "rows", F.when(F.col("rows") > 0, "ready").otherwise("empty").alias("status"))
        for name, df in (("sessions", sessions), ("capsules", capsules), ("edges", edges))
    ]
    loose = capsules.join(sessions, ["source_id", "project_key"], "left_anti").agg(F.count("*").alias("rows"))
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("source_id")).join(sessions, "source_id", "left_anti").agg(F.count("*").alias("rows"))
    for name, df in (("capsules_without_session", loose), ("edge_ends_without_session", ends)):
        counts.append(df.select(F.lit(name).alias("component"), "rows", F.when(F.col("rows") == 0, "ready").otherwise("broken").alias("status")))
    return reduce(DataFrame.unionByName, counts)
