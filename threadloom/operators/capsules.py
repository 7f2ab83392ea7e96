"""Capsules: each session condensed to a document of at most LIMIT bytes of canonical JSON, and its search text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heapreplace
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import guarded, redaction, text
from threadloom.plans.storage import stored

# The document's limit, and the versions of its label and header.
LIMIT, LABEL_VERSION, HEADER_VERSION, SCHEMA_VERSION = 8192, 3, 1, 1
RECENT = 4
CAPABILITIES = ("native-reread", "visible-user-agent-turns")
DDL = (
    "capabilities array<string>, display_name string, display_name_truncated boolean, display_name_version int, "
    "excerpts array<struct<citation:struct<timestamp:string,turn_locator:string,turn_locator_truncated:boolean>,ordinal:int,role:string,text:string,truncated:boolean>>, "
    "harness string, health string, native_session_id string, omitted_visible_turns int, project_key string, redaction_count int, schema_version int, "
    "session_header struct<effort:string,model_id:string,model_provider:string,title_origin:string,version:int,visible_text_bytes:bigint,visible_turn_count:int>, "
    "source_id string, source_title string, source_title_truncated boolean, updated_at string"
)
FITTED = "source_id string, project_key string, content_json string, search_text string, byte_count int, omitted_visible_turns int, n_excerpts int"


def choose_excerpts(turns: DataFrame, recent: int = RECENT) -> DataFrame:
    """Of each session the first turn of a user and the last `recent` turns, none of them a host's envelope.

    The last turns are counted before envelopes are dropped. One window by session in each direction, over one shuffle.
    """
    rows = turns.withColumn("envelope", text.is_envelope(F.col("text")))
    own = (F.col("role") == "user") & ~F.col("envelope")
    last = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("ordinal")))
    first = F.min(F.when(own, F.col("ordinal"))).over(Window.partitionBy("source_id"))
    rows = rows.withColumn("from_end", last).withColumn("first_user", first)
    return rows.where(~F.col("envelope") & ((F.col("from_end") <= recent) | (F.col("ordinal") == F.col("first_user")))).drop("envelope", "from_end", "first_user")


def excerpts(turns: DataFrame) -> DataFrame:
    """Chosen turns with redacted and bounded text and locator, and the redactions in both."""
    rows = choose_excerpts(turns).withColumn("r", redaction.redact(F.col("text"))).withColumn("l", redaction.redact(F.col("locator")))
    return rows.select(
        "source_id",
        "ordinal",
        "role",
        text.bounded(F.col("r.text"), text.EXCERPT_LIMIT).alias("text"),
        (F.length("r.text") > text.EXCERPT_LIMIT).alias("truncated"),
        text.bounded(F.col("l.text"), text.LOCATOR_LIMIT).alias("turn_locator"),
        (F.length("l.text") > text.LOCATOR_LIMIT).alias("turn_locator_truncated"),
        (F.col("r.count") + F.col("l.count")).alias("redactions"),
        text.cited_time(turns).alias("at"),
    )


def label(title: Column, first_excerpt: Column, harness: Column) -> Column:
    """struct(name, truncated, origin): the native title, else the task that the first excerpt states."""
    goal = F.when(F.trim(first_excerpt) != "", text.task_sentence(first_excerpt))
    native = F.when(title != "", title)
    candidate = F.coalesce(native, F.when(goal != "", goal))
    name = text.conceal_ids(candidate)
    none = F.struct(F.concat(F.initcap(harness), F.lit(" session · no user task captured")).alias("name"), F.lit(False).alias("truncated"), F.lit("no_user_task").alias("origin"))
    some = F.struct(
        text.bounded(name, text.LABEL_LIMIT).alias("name"),
        (F.length(name) > text.LABEL_LIMIT).alias("truncated"),
        F.when(native.isNotNull(), "native").otherwise("derived_goal").alias("origin"),
    )
    return F.when(candidate.isNull(), none).otherwise(some)


def labels(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(source_id, display_name, truncated, title_origin) of each session with a visible turn."""
    own = excerpts(turns).where((F.col("role") == "user") & ~text.is_envelope(F.col("text")))
    first = own.groupBy("source_id").agg(F.min_by("text", "ordinal").alias("first_excerpt"))
    rows = sessions.join(turns.select("source_id").distinct(), "source_id", "left_semi").join(first, "source_id", "left")
    title = text.bounded(F.coalesce(redaction.redacted_text(F.col("title")), F.lit("")), text.TITLE_LIMIT)
    rows = rows.withColumn("label", label(title, F.col("first_excerpt"), F.col("adapter")))
    return rows.select("source_id", F.col("label.name").alias("display_name"), F.col("label.truncated").alias("truncated"), F.col("label.origin").alias("title_origin"))


def documents(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Capsules before fitting: one row a session, the columns of DDL."""
    one = F.struct(
        F.struct(F.col("at").alias("timestamp"), "turn_locator", "turn_locator_truncated").alias("citation"),
        "ordinal",
        "role",
        "text",
        "truncated",
    )
    own = F.when((F.col("role") == "user") & ~text.is_envelope(F.col("text")), F.col("text"))
    chosen = excerpts(turns).groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", one.alias("e")))).alias("sorted"), F.sum("redactions").alias("redactions"), F.min_by(own, F.when(own.isNotNull(), F.col("ordinal"))).alias("first_excerpt")
    )
    sizes = turns.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    rows = sessions.join(sizes, "source_id").join(chosen, "source_id", "left")
    header = {c: redaction.redact(F.col(c)) if c in sessions.columns else None for c in ("model_provider", "model_id", "effort")}
    title = redaction.redact(F.coalesce("title", F.lit("")))
    rows = rows.withColumn("t", title).withColumns({f"h_{c}": v if v is not None else redaction.redact(F.lit(None).cast("string")) for c, v in header.items()})
    rows = rows.withColumn("source_title", text.bounded(F.col("t.text"), text.TITLE_LIMIT)).withColumn("label", label(F.col("source_title"), F.col("first_excerpt"), F.col("adapter")))
    blank_is_null = lambda c: F.when(F.col(c) != "", F.col(c))
    listed = F.coalesce(F.transform("sorted", lambda s: s["e"]), F.array())
    counts = sum((F.coalesce(F.col(f"h_{c}.count"), F.lit(0)) for c in header), F.col("t.count") + F.coalesce("redactions", F.lit(0)))
    return rows.select(
        F.array(*map(F.lit, CAPABILITIES)).alias("capabilities"),
        F.col("label.name").alias("display_name"),
        F.col("label.truncated").alias("display_name_truncated"),
        F.lit(LABEL_VERSION).alias("display_name_version"),
        listed.alias("excerpts"),
        F.col("adapter").alias("harness"),
        "health",
        F.col("native_id").alias("native_session_id"),
        (F.col("n") - F.size(listed)).cast("int").alias("omitted_visible_turns"),
        "project_key",
        counts.cast("int").alias("redaction_count"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            blank_is_null("h_effort.text").alias("effort"), blank_is_null("h_model_id.text").alias("model_id"), blank_is_null("h_model_provider.text").alias("model_provider"),
            F.col("label.origin").alias("title_origin"), F.lit(HEADER_VERSION).alias("version"), F.col("bytes").cast("bigint").alias("visible_text_bytes"), F.col("n").cast("int").alias("visible_turn_count"),
        ).alias("session_header"),
        "source_id",
        blank_is_null("source_title").alias("source_title"),
        (F.length("t.text") > text.TITLE_LIMIT).alias("source_title_truncated"),
        text.rfc3339(F.col("updated_at")).alias("updated_at"),
    )


def canonical(content: object) -> str:
    return json.dumps(content, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _encoded(value: object) -> int:
    return len(canonical(value).encode())


def fit(content: dict, limit: int = LIMIT) -> dict:
    """The document within the limit: without as many of the excerpts between the first user's and the last as it takes,
    and if that doesn't do, with its longest text halved, and halved again.

    Sizes are added up, not measured again: a document is encoded once.
    """
    parts, omitted = content["excerpts"], content["omitted_visible_turns"]
    over = _encoded(content) - limit
    asked = next((i for i, p in enumerate(parts) if p["role"] == "user"), len(parts))
    spare = [i for i in range(len(parts)) if i != asked][: max(0, len(parts) - 2)]
    # what is saved by leaving out the first k of them: the texts and their commas, less what the count grows by
    saved = accumulate((_encoded(parts[i]) + 1 for i in spare), initial=0)
    grown = (len(str(omitted + k)) - len(str(omitted)) for k in range(len(spare) + 1))
    left = [over - s + g for s, g in zip(saved, grown, strict=True)]
    k = next((k for k, x in enumerate(left) if x <= 0), len(spare))
    gone, over = set(spare[:k]), left[k]
    parts = [p for i, p in enumerate(parts) if i not in gone]
    longest = [(-len(p["text"]), i) for i, p in enumerate(parts)]
    heapify(longest)
    while over > 0:
        length, i = longest[0] if longest else (0, 0)
        if -length <= len(text.TRUNCATED) + 1:
            raise ValueError("what describes the session is longer than the limit")
        half = parts[i]["text"][: max(1, -length // 2 - len(text.TRUNCATED))].rstrip() + text.TRUNCATED
        cut = parts[i] | {"text": half, "truncated": True}
        over -= _encoded(parts[i]) - _encoded(cut)
        parts[i] = cut
        heapreplace(longest, (-len(half), i))
    return content | {"excerpts": parts, "omitted_visible_turns": omitted + k}


def build(sessions: DataFrame, turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source_id, project_key, content_json, search_text, byte_count, …): fitted capsules.

    A document whose JSON fits already, which is most, is encoded by Spark alone; the rest go through Arrow batches of
    their own. Fitting needs no shuffle: a row is a session.
    """
    docs = documents(sessions, turns)
    json_of = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    # written once: both kinds of rows read it, and the expressions behind it would be planned again for each
    rows = stored(docs.select("source_id", "project_key", json_of.alias("content_json"), "omitted_visible_turns", F.size("excerpts").alias("n_excerpts")), "capsules")
    fits = rows.where(F.octet_length("content_json") <= limit)
    large = rows.where(F.octet_length("content_json") > limit)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fit(json.loads(x), limit) for x in batch["content_json"]]
            yield batch.assign(content_json=[canonical(x) for x in found], omitted_visible_turns=[x["omitted_visible_turns"] for x in found], n_excerpts=[len(x["excerpts"]) for x in found])

    rows = fits.unionByName(large.mapInPandas(fitted, rows.schema))
    body = F.from_json("content_json", DDL)
    search = F.concat_ws("\n", body["source_title"], F.array_join(F.transform(body["excerpts"], lambda e: e["text"]), "\n"))
    return rows.select("source_id", "project_key", "content_json", search.alias("search_text"), F.octet_length("content_json").alias("byte_count"), "omitted_visible_turns", "n_excerpts")


def stale(capsules: DataFrame) -> DataFrame:
    """Capsules whose label or header is of an earlier version."""
    body = guarded.parsed(F.col("content_json"), "display_name_version int, session_header struct<version:int>")
    old = F.coalesce(body["display_name_version"] != LABEL_VERSION, F.lit(True)) | F.coalesce(body["session_header"]["version"] != HEADER_VERSION, F.lit(True))
    return capsules.where(old)


def refresh_labels(capsules: DataFrame) -> DataFrame:
    """Stale capsules with a label derived anew from what they hold; their search text stays."""
    rows = stale(capsules).withColumn("b", guarded.parsed(F.col("content_json"), DDL)).where(F.col("b.session_header").isNotNull() & F.col("b.excerpts").isNotNull() & F.col("b.harness").isNotNull())
    first = F.get(F.filter("b.excerpts", lambda e: (e["role"] == "user") & ~text.is_envelope(e["text"])), F.lit(0))["text"]
    new = label(F.coalesce("b.source_title", F.lit("")), first, F.col("b.harness"))
    rows = rows.withColumn("new", new)
    body = F.col("b").withField("display_name", F.col("new.name")).withField("display_name_truncated", F.col("new.truncated")).withField("display_name_version", F.lit(LABEL_VERSION))
    body = body.withField("session_header.title_origin", F.col("new.origin"))
    rows = rows.withColumn("content_json", F.to_json(body, {"ignoreNullFields": "false"})).drop("b", "new")
    return rows.withColumn("byte_count", F.octet_length("content_json")) if "byte_count" in rows.columns else rows
