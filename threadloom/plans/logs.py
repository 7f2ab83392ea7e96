"""Logs of the six sources made of the driver's conversations, loaded, and the same rows as SQL over the conversations.

A conversation is a session; its user and assistant turns are what the logs hold. Every third has a title, every fifth
log a broken last line. Tasks write a source's files into the shared folder, each those of some conversations, once for a session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.plans import model
from threadloom.plans.storage import folder, stored
from threadloom.sources import logs, sink

#: The first time of a conversation, in seconds; its turns follow a second apart.
BEGIN = 1704067200


def uuid(n: int) -> str:
    return f"019f6000-1234-7000-8000-{n:012d}"


def _time(seconds: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _codex(n: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, list]]:
    out: list = [{"type": "session_meta", "timestamp": _time(BEGIN + n), "payload": {"id": uuid(n), "cwd": f"/work/p{n % 4}", "timestamp": _time(BEGIN + n), "model_provider": "prov"}}]
    out.append({"type": "turn_context", "payload": {"model": f"m{n % 3}", "effort": "high"}})
    for i, (role, said) in enumerate(turns):
        out.append({"type": "response_item", "timestamp": _time(BEGIN + n + i), "payload": {"type": "message", "role": role, "content": [{"type": "input_text" if role == "user" else "output_text", "text": said}, {"type": "other", "text": "HIDDEN"}]}})
    out.append({"type": "event_msg", "timestamp": _time(BEGIN + n + len(turns)), "payload": {"type": "task_complete" if n % 3 == 0 else "task_started"}})
    yield f"2024/01/01/rollout-2024-01-01T00-00-00-{uuid(n)}.jsonl", out + (["{broken"] if n % 5 == 0 else [])


def _grok(n: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, list]]:
    folder = f"%2Fwork%2Fp{n % 4}/{uuid(n)}"
    yield f"{folder}/summary.json", [{"created_at": _time(BEGIN + n), "updated_at": _time(BEGIN + n + 9), "generated_title": f"Title {n}" if n % 3 == 0 else None, "current_model_id": f"m{n % 3}"}]
    kind = {"user": "user_message_chunk", "assistant": "agent_message_chunk"}
    out: list = [{"method": "session/update", "timestamp": BEGIN + n + i, "params": {"sessionId": uuid(n), "update": {"sessionUpdate": kind[role], "content": {"type": "text", "text": said}}}} for i, (role, said) in enumerate(turns)]
    out.insert(0, {"method": "session/update", "timestamp": BEGIN + n, "params": {"sessionId": uuid(n), "update": {"sessionUpdate": "agent_thought_chunk", "content": {"type": "text", "text": "HIDDEN"}}}})
    yield f"{folder}/updates.jsonl", out + (["{broken"] if n % 5 == 0 else [])


def _cursor(n: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, list]]:
    out = [{"role": role, "message": {"content": [{"type": "text", "text": said}, {"type": "tool_use", "name": "Task", "input": {"model": f"m{n % 3}"}}]}} for role, said in turns]
    yield f"projects/work-p{n % 4}/agent-transcripts/{uuid(n)}/{uuid(n)}.jsonl", out + (["{broken"] if n % 5 == 0 else [])
    if n % 3 == 0:
        import hashlib

        yield f"chats/{hashlib.md5(f'/work/p{n % 4}'.encode()).hexdigest()}/{uuid(n)}/meta.json", [{"title": f"Title {n}", "createdAtMs": (BEGIN + n) * 1000, "updatedAtMs": (BEGIN + n + 9) * 1000, "cwd": f"/work/p{n % 4}"}]


def _claude(n: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, list]]:
    out: list = [{"type": "ai-title", "aiTitle": f"Title {n}"}] if n % 3 == 0 else []
    for i, (role, said) in enumerate(turns):
        content = said if role == "user" else [{"type": "text", "text": said}, {"type": "thinking", "text": "HIDDEN"}]
        out.append({"type": role, "timestamp": _time(BEGIN + n + i), "sessionId": uuid(n), "cwd": f"/work/p{n % 4}", "message": {"role": role, "model": f"m{n % 3}" if role == "assistant" else None, "content": content}})
    yield f"-work-p{n % 4}/{uuid(n)}.jsonl", out + (["{broken"] if n % 5 == 0 else [])


def _antigravity(n: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, list]]:
    yield f"history/{n:06d}.jsonl", [{"display": f"Title {n}" if n % 3 == 0 else " ", "timestamp": (BEGIN + n) * 1000, "workspace": f"/work/p{n % 4}", "conversationId": uuid(n)}]
    out = [{"source": "USER_EXPLICIT", "type": "USER_INPUT", "content": f"<USER_REQUEST>\n{said}\n</USER_REQUEST> more", "created_at": _time(BEGIN + n + i)} if role == "user" else {"source": "MODEL", "type": "PLANNER_RESPONSE", "content": said, "created_at": _time(BEGIN + n + i)} for i, (role, said) in enumerate(turns)]
    yield f"brain/{uuid(n)}/transcript.jsonl", out + (["{broken"] if n % 5 == 0 else [])


def _opencode(n: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, list]]:
    messages = [{"info": {"id": f"msg_{i:04d}", "sessionID": f"ses_{n}", "role": role, "time": {"created": (BEGIN + n + i) * 1000}}, "parts": [{"type": "text", "text": said}, {"type": "text", "text": "HIDDEN", "ignored": True}, {"type": "tool"}]} for i, (role, said) in enumerate(turns)]
    messages += [{"info": {"id": "bad"}, "parts": []}] if n % 5 == 0 else []
    yield f"exports/ses_{n}.json", [{"info": {"id": f"ses_{n}", "directory": f"/work/p{n % 4}", "model": {"id": f"m{n % 3}", "providerID": "prov"}, "time": {"created": (BEGIN + n) * 1000, "updated": (BEGIN + n + 9) * 1000}}, "messages": messages}]


WRITERS: dict[str, Callable] = {"codex": _codex, "grok": _grok, "cursor": _cursor, "claude": _claude, "antigravity": _antigravity, "opencode": _opencode}
_written: dict[tuple[str, str, str], str] = {}


def _files(source: str, n: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(name, body) of a source's files of a conversation."""
    for name, lines in WRITERS[source](n, turns):
        body = "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines)
        yield name, body if n % 5 == 0 or name.endswith(".json") else body + "\n"


def _bodies(source: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                some = batch.iloc[start : start + 500]
                found = [f for n, turns in zip(some["conv_id"], some["turns"], strict=True) for f in _files(source, int(n), [(t["role"], t["text"]) for t in turns])]
                yield pd.DataFrame(found, columns=["name", "body"])

    return bodies


def written(spark: SparkSession, sf_dir: str, source: str) -> str:
    """The folder with a source's logs."""
    key = (spark.sparkContext.applicationId, sf_dir, source)
    if key not in _written:
        root = f"{folder(spark, 'logs')}/{source}"
        spoken = model.table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
        talks = spoken.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"], t["text"])).alias("turns"))
        sink.write_files(talks.mapInPandas(_bodies(source), "name string, body string"), root)
        if source == "opencode":
            sink.write_files(_catalogs(spoken.select("conv_id").distinct()), root)
        _written[key] = root
    return _written[key]


def _catalogs(named: DataFrame) -> DataFrame:
    """(name, body): a page of a catalog names as many sessions as a reader takes, and all pages all of them; one catalog alone names one more."""
    n = F.col("conv_id")
    entry = F.struct(
        F.concat(F.lit("ses_"), n).alias("id"), F.concat(F.lit("/work/p"), n % 4).alias("directory"), F.concat(F.lit("Title "), n).alias("title"), F.lit("1.18.0").alias("version"),
        F.struct(((BEGIN + n) * 1000).alias("created"), ((BEGIN + n + 9) * 1000).alias("updated")).alias("time"),
    )
    listed = F.array_sort(F.collect_list(F.struct("conv_id", entry.alias("e")))).alias("all")
    page = F.concat(F.lit("catalogs/page-"), F.floor(n / logs.CATALOG_LIMIT), F.lit(".json")).alias("name")
    alone = named.orderBy("conv_id").limit(logs.CATALOG_LIMIT + 1).agg(listed).select(F.lit("session-list.json").alias("name"), "all")
    return named.groupBy(page).agg(listed).unionByName(alone).select("name", F.to_json(F.col("all.e")).alias("body"))


def scan(spark: SparkSession, sf_dir: str, source: str) -> logs.Scan:
    root = written(spark, sf_dir, source)
    places = {"cursor": {"root": f"{root}/projects", "chats": f"{root}/chats"}, "antigravity": {"history": f"{root}/history", "brain": f"{root}/brain"}, "opencode": {"catalog": f"{root}/catalogs", "exports": f"{root}/exports", "version": "1.18.2"}}
    return logs.configured(spark, {source: places.get(source, {"root": root})})


def _turns(source: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scan(spark, sf_dir, source).turns
        native = F.element_at(F.split("source_id", ":"), -1)
        at = F.when(F.col("at").isNotNull(), text.rfc3339(F.col("at")))
        return rows.select(native.alias("native_id"), F.col("ordinal").cast("bigint").alias("ordinal"), "role", F.sha2(F.col("text").cast("binary"), 256).alias("text"), "locator", at.alias("at"))

    return query


def _sessions(source: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scan(spark, sf_dir, source)
        rows = found.sessions.join(found.status().select("source_id", "read_status"), "source_id")
        timed = [F.when(F.col("title").isNotNull() | F.lit(source != "cursor"), text.rfc3339(F.col(c))).alias(c) for c in ("started_at", "updated_at")]
        return rows.select("adapter", "native_id", "project_hint", "title", "health", "model_id", "effort", "read_status", *timed)

    return query


def log_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of all sources by code, one source after the other: a plan of all of them would hold all their broadcasts at once."""
    parts = [stored(scan(spark, sf_dir, s).warnings.groupBy("code").agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), "code", "n"), "warnings") for s in WRITERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def log_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct fingerprints by source: every session's content is its own."""
    parts = [stored(scan(spark, sf_dir, s).sessions.select(F.lit(s).alias("source"), "fingerprint"), "prints") for s in ("codex", "grok", "cursor", "claude", "antigravity", "opencode")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source").agg(F.count_distinct("fingerprint").alias("n"), F.count_if(F.col("fingerprint").isNull()).alias("without"))


def claude_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's fingerprint, which is that of its file's bytes."""
    return scan(spark, sf_dir, "claude").sessions.select("native_id", "fingerprint")


def reread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen records of one source read again from turn 1 on; some are of other sources, gone, elsewhere or changed."""
    now = scan(spark, sf_dir, "claude")
    n = F.substring("native_id", -12, 12).cast("bigint")
    records = now.sessions.select(
        F.when(n % 7 == 1, F.concat("source_id", F.lit("x"))).otherwise(F.col("source_id")).alias("source_id"), F.when(n % 7 == 2, "elsewhere").otherwise(F.col("adapter")).alias("adapter"),
        F.when(n % 7 == 3, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(n % 7 == 4, "/moved").otherwise(F.col("locator")).alias("locator"),
    )
    after = now.sessions.select("source_id", F.when(n % 7 == 5, "new").otherwise(F.col("fingerprint")).alias("fingerprint"))
    turns, status, warnings = logs.reread(now, records, 1, 3, after)
    code = warnings.where("message = 'the record wasn''t read'").select("source_id", "code")
    count = turns.groupBy("source_id").agg(F.count("*").alias("turns"))
    rows = status.join(code, "source_id", "left").join(count, "source_id", "left")
    return rows.select(F.element_at(F.split("source_id", ":"), -1).alias("native_id"), "read_status", "code", F.coalesce("turns", F.lit(0)).alias("turns"))


def reread_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one source read again by their exports, some of which are refused for each reason that there is."""
    root = written(spark, sf_dir, "opencode")
    n = F.substring("native_id", 5, 20).cast("bigint")
    records = scan(spark, sf_dir, "opencode").sessions.select(
        "source_id", F.when(n % 8 == 1, "codex").otherwise(F.col("adapter")).alias("adapter"), F.when(n % 8 == 2, F.concat("native_id", F.lit("x"))).otherwise(F.col("native_id")).alias("native_id"),
        F.when(n % 8 == 3, "sha").when(n % 8 == 4, "7").otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(n % 8 == 5, "session:other").when(n % 8 == 2, F.concat("locator", F.lit("x"))).otherwise(F.col("locator")).alias("locator"), F.when(n % 8 == 6, "/elsewhere").otherwise(F.concat("project_hint", F.lit("//"))).alias("project_hint"),
    )
    turns, heads, warnings = logs.reread_exports(spark, records, f"{root}/exports", 0, 2)
    told = warnings.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    count = turns.groupBy("source_id").agg(F.count("*").alias("turns"))
    rows = heads.join(told, "source_id", "left").join(count, "source_id", "left")
    return rows.select(F.element_at(F.split("source_id", ":"), -1).alias("native_id"), "read_status", "model_id", "codes", F.coalesce("turns", F.lit(0)).alias("turns"))


def antigravity_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of one workspace alone."""
    root = written(spark, sf_dir, "antigravity")
    found = logs.antigravity(spark, f"{root}/history", f"{root}/brain", "/work/p1/")
    return found.sessions.join(found.turns.groupBy("source_id").agg(F.count("*").alias("turns")), "source_id").select("native_id", "title", "project_hint", "turns")


def export_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of exports by the version of the program that wrote them."""
    root = written(spark, sf_dir, "opencode")
    out = None
    for version in ("1.17.17", "v1.17.18", "1.99.0", "2.0.0", "new"):
        found = logs.opencode(spark, f"{root}/session-list.json", f"{root}/exports", version=version)
        code = found.warnings.where("code = 'unsupported-version'").agg(F.count("*").alias("refused"))
        row = found.sessions.agg(F.count("*").alias("sessions")).join(F.broadcast(code)).select(F.lit(version).alias("version"), "sessions", "refused")
        out = row if out is None else out.unionByName(row)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"log_warnings": log_warnings, "log_fingerprints": log_fingerprints, "claude_fingerprints": claude_fingerprints, "reread_records": reread_records, "reread_exports": reread_exports, "antigravity_workspace": antigravity_workspace, "export_versions": export_versions}
    for s in WRITERS:
        out |= {f"{s}_turns": _turns(s), f"{s}_sessions": _sessions(s)}
    return out


# ---------------------------------------------------------------- the same as SQL

TALK = f"""
say AS (SELECT conv_id AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations WHERE role IN ('user', 'assistant')),
talk AS (SELECT DISTINCT n, '019f6000-1234-7000-8000-' || lpad(CAST(n AS VARCHAR), 12, '0') AS id FROM say)"""
_AT = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
#: native id, first ordinal, place, time and text of a turn, and which turns pass, by source.
_TURN = {
    "codex": ("id", 0, "'jsonl:' || (i + 3)", _AT.format(f"{BEGIN} + n + i"), "text", "true"),
    "grok": ("id", 0, "'updates.jsonl:' || (i + 2)", _AT.format(f"{BEGIN} + n + i"), "text", "true"),
    "cursor": ("id", 1, "'line:' || (i + 1)", "CAST(NULL AS VARCHAR)", "text", "true"),
    "claude": ("id", 1, "'line:' || (i + 1 + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END)", _AT.format(f"{BEGIN} + n + i"), "text", "true"),
    "antigravity": ("id", 1, "'line:' || (i + 1)", _AT.format(f"{BEGIN} + n + i"), "CASE role WHEN 'user' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE trim(text, ' ') END", "(role = 'user' OR length(text) <= 4096)"),
    "opencode": ("'ses_' || n", 0, "'message:msg_' || lpad(CAST(i AS VARCHAR), 4, '0')", _AT.format(f"{BEGIN} + n + i"), "text", "true"),
}
_PAST = _AT.format(f"{BEGIN} + n + k - 1")
#: title, health, model, effort, whether a broken line makes the read partial, first and last time, by source.
_SESSION = {
    "codex": ("CAST(NULL AS VARCHAR)", "CASE n % 3 WHEN 0 THEN 'complete' ELSE 'unknown' END", "'m' || (n % 3)", "'high'", True, _AT.format(f"{BEGIN} + n"), _AT.format(f"{BEGIN} + n + k")),
    "grok": ("CASE n % 3 WHEN 0 THEN 'Title ' || n END", "'unknown'", "'m' || (n % 3)", "CAST(NULL AS VARCHAR)", True, _AT.format(f"{BEGIN} + n"), _AT.format(f"{BEGIN} + n + 9")),
    "cursor": ("CASE n % 3 WHEN 0 THEN 'Title ' || n END", "'unknown'", "'m' || (n % 3)", "CAST(NULL AS VARCHAR)", False, f"CASE n % 3 WHEN 0 THEN {_AT.format(f'{BEGIN} + n')} END", f"CASE n % 3 WHEN 0 THEN {_AT.format(f'{BEGIN} + n + 9')} END"),
    "claude": ("CASE n % 3 WHEN 0 THEN 'Title ' || n END", "'unknown'", "CASE WHEN agents > 0 THEN 'm' || (n % 3) END", "CAST(NULL AS VARCHAR)", False, _AT.format(f"{BEGIN} + n"), _PAST),
    "antigravity": ("CASE n % 3 WHEN 0 THEN 'Title ' || n END", "'unknown'", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", False, _AT.format(f"{BEGIN} + n"), _AT.format(f"{BEGIN} + n")),
    "opencode": ("'Title ' || n", "'unknown'", "'m' || (n % 3)", "CAST(NULL AS VARCHAR)", True, _AT.format(f"{BEGIN} + n"), _AT.format(f"{BEGIN} + n + 9")),
}


def _turn_sql(source: str) -> str:
    native, first, place, at, body, passes = _TURN[source]
    return f"""WITH {TALK}, t AS (SELECT n, id, i, role, {body} AS body FROM say JOIN talk USING (n) WHERE {passes})
SELECT {native} AS native_id, row_number() OVER (PARTITION BY n ORDER BY i) - 1 + {first} AS ordinal, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS role, sha256(body) AS text, {place} AS locator, {at} AS "at"
FROM t WHERE body <> ''"""


def _session_sql(source: str) -> str:
    title, health, model_id, effort, strict, first, last = _SESSION[source]
    native = _TURN[source][0]
    hint = "CASE n % 3 WHEN 0 THEN '/work/p' || (n % 4) END" if source == "cursor" else "'/work/p' || (n % 4)"
    status = "CASE WHEN n % 5 = 0 THEN 'partial' ELSE 'complete' END" if strict else "'complete'"
    return f"""WITH {TALK}, s AS (SELECT n, id, count(*) AS k, count(*) FILTER (WHERE role = 'assistant') AS agents FROM say JOIN talk USING (n) GROUP BY 1, 2)
SELECT '{source}' AS adapter, {native} AS native_id, {hint} AS project_hint, {title} AS title, {health} AS health, {model_id} AS model_id, {effort} AS effort, {status} AS read_status, {first} AS started_at, {last} AS updated_at FROM s"""


def oracle_sql() -> dict[str, str]:
    out = {f"{s}_turns": _turn_sql(s) for s in WRITERS} | {f"{s}_sessions": _session_sql(s) for s in WRITERS}
    broken = "SELECT count(*) FILTER (WHERE n % 5 = 0) FROM talk"
    codes = {"codex": "truncated-jsonl", "grok": "truncated-update", "cursor": "truncated-turn", "claude": "truncated-turn", "antigravity": "truncated-turn", "opencode": "malformed-message"}
    out["log_warnings"] = f"WITH {TALK} " + " UNION ALL ".join(f"SELECT '{s}' AS source, '{c}' AS code, ({broken}) AS n" for s, c in codes.items())
    out["log_fingerprints"] = f"WITH {TALK} " + " UNION ALL ".join(f"SELECT '{s}' AS source, (SELECT count(*) FROM talk) AS n, 0 AS without" for s in WRITERS)
    quoted = "CAST(to_json(text) AS VARCHAR)"
    line = f"""'{{"type": "' || role || '", "timestamp": "' || {_AT.format(f"{BEGIN} + n + i")} || '", "sessionId": "' || id || '", "cwd": "/work/p' || (n % 4) || '", "message": {{"role": "' || role || '", "model": ' || CASE role WHEN 'assistant' THEN '"m' || (n % 3) || '"' ELSE 'null' END
|| ', "content": ' || CASE role WHEN 'user' THEN {quoted} ELSE '[{{"type": "text", "text": ' || {quoted} || '}}, {{"type": "thinking", "text": "HIDDEN"}}]' END || '}}}}'"""
    out["claude_fingerprints"] = f"""WITH {TALK}, b AS (SELECT n, id, string_agg({line}, chr(10) ORDER BY i) AS body FROM say JOIN talk USING (n) GROUP BY ALL)
SELECT id AS native_id, sha256(CASE WHEN n % 3 = 0 THEN '{{"type": "ai-title", "aiTitle": "Title ' || n || '"}}' || chr(10) ELSE '' END || body || chr(10) || CASE WHEN n % 5 = 0 THEN '{{broken' ELSE '' END) AS fingerprint FROM b"""
    out["reread_records"] = f"""WITH {TALK}, s AS (SELECT n, id, count(*) AS k FROM say JOIN talk USING (n) GROUP BY 1, 2),
c AS (SELECT *, CASE n % 7 WHEN 1 THEN 'missing-source' WHEN 2 THEN 'wrong-source' WHEN 3 THEN 'source-changed' WHEN 4 THEN 'identity-mismatch' WHEN 5 THEN 'source-changed-during-read' END AS code FROM s)
SELECT CASE n % 7 WHEN 1 THEN id || 'x' ELSE id END AS native_id, CASE WHEN code IS NOT NULL THEN 'unavailable' ELSE 'complete' END AS read_status, code, CASE WHEN code IS NULL THEN least(k, 2) ELSE 0 END AS turns FROM c"""
    out["reread_exports"] = f"""WITH {TALK}, s AS (SELECT n, count(*) AS k FROM say GROUP BY 1),
c AS (SELECT *, CASE n % 8 WHEN 1 THEN 'wrong-source' WHEN 2 THEN 'missing-source' WHEN 3 THEN 'unsupported-fingerprint' WHEN 5 THEN 'identity-mismatch' WHEN 6 THEN 'project-mismatch' END AS code FROM s)
SELECT 'ses_' || n AS native_id, CASE WHEN code IS NOT NULL THEN 'unavailable' WHEN n % 8 = 4 OR n % 5 = 0 THEN 'partial' ELSE 'complete' END AS read_status, CASE WHEN code IS NULL THEN 'm' || (n % 3) END AS model_id,
       coalesce(code, nullif(concat_ws(',', CASE WHEN n % 5 = 0 THEN 'malformed-message' END, CASE WHEN n % 8 = 4 THEN 'source-changed' END), '')) AS codes, CASE WHEN code IS NULL THEN least(k, 2) ELSE 0 END AS turns FROM c"""
    out["antigravity_workspace"] = f"""WITH {TALK} SELECT id AS native_id, CASE n % 3 WHEN 0 THEN 'Title ' || n END AS title, '/work/p1' AS project_hint, count(*) AS turns FROM say JOIN talk USING (n)
WHERE n % 4 = 1 AND (role = 'user' OR length(text) <= 4096) AND trim(text) <> '' GROUP BY n, id"""
    out["export_versions"] = f"""WITH {TALK}, v AS (SELECT version, version IN ('v1.17.18', '1.99.0') AS good FROM (VALUES ('1.17.17'), ('v1.17.18'), ('1.99.0'), ('2.0.0'), ('new')) q(version))
SELECT version, CASE WHEN good THEN (SELECT least(count(*), 500) FROM talk) ELSE 0 END AS sessions, CASE WHEN good THEN 0 ELSE 1 END AS refused FROM v"""
    return out
