"""Which session the work goes on in: found from evidence, never from recency alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import projects
from threadloom.schema import WARNINGS

#: Why a target is what it is, by code.
REASONS = {
    "host_id_match": "The host's own id names one eligible session.",
    "host_id_unknown": "The host's own id names no eligible session.",
    "unique_candidate": "One session of the project is eligible.",
    "ambiguous_target": "Several sessions of the project are eligible.",
    "no_eligible_target": "No session of the project is eligible.",
    "foreign_project": "The host works in another project.",
    "selected_source": "The session is one of the sources.",
    "unavailable_target": "The session isn't there any more.",
    "stale_index": "The session has changed since it was indexed.",
    "malformed-host-context": "What the host tells is incomplete or unusable.",
    "host-source-mismatch": "The host's id isn't that of the session observed.",
    "host-project-mismatch": "The host's folders and the session's are of different projects.",
    "missing-host-context": "The harness needs what its host tells.",
    "unsupported-harness": "Sessions of the harness can't be targets.",
}


def candidates(sessions: DataFrame, adapter: str = "codex", excluded: DataFrame | None = None) -> DataFrame:
    """Eligible sessions, ranked newest first by project."""
    rows = sessions.where((F.col("adapter") == adapter) & F.col("native_available"))
    if excluded is not None:
        rows = rows.join(excluded.select("source_id").distinct(), "source_id", "left_anti")
    order = Window.partitionBy("project_key").orderBy(F.desc("updated_at"), "source_id")
    return rows.select("project_key", "source_id", "native_id", "updated_at", F.row_number().over(order).alias("rank"))


def resolve_current(sessions: DataFrame, requests: DataFrame, adapter: str = "codex") -> DataFrame:
    """(project_key, kind, code, source_id, candidates) of requests (project_key, current_native_id or null)."""
    found = candidates(sessions, adapter)
    rows = requests.join(found, "project_key", "left").groupBy("project_key", "current_native_id").agg(
        F.count("source_id").alias("candidates"),
        F.count_if(F.col("native_id") == F.col("current_native_id")).alias("matches"),
        F.min(F.when(F.col("native_id") == F.col("current_native_id"), F.col("source_id"))).alias("matched"),
        F.min("source_id").alias("only"),
    )
    n = F.col("candidates")
    code, kind = _current(n, F.col("current_native_id").isNotNull(), F.col("matches") == 1)
    source = F.when(code == "host_id_match", F.col("matched")).when(code == "unique_candidate", F.col("only"))
    return rows.select("project_key", kind.alias("kind"), code.alias("code"), source.alias("source_id"), n.alias("candidates"))


def _current(n: Column, given: Column, matches: Column) -> tuple[Column, Column]:
    """(code, kind) of n candidates, whether the host has given an id, and whether one has it."""
    code = (
        F.when(n == 0, "no_eligible_target")
        .when(given & matches, "host_id_match")
        .when(given, "host_id_unknown")
        .when(n == 1, "unique_candidate")
        .otherwise("ambiguous_target")
    )
    return code, F.when(code == "no_eligible_target", "unavailable").when(code.isin("host_id_match", "unique_candidate"), "resolved").otherwise("confirmation_required")


def discovered(records: DataFrame, known: DataFrame, current: str, adapter: str = "codex") -> tuple[DataFrame, DataFrame]:
    """(the adapter's records (source_id, project_hint, ...) of the current folder's project, warnings of those whose hint leads nowhere).

    known: (root, common) of repositories.
    """
    own = records.where(F.col("adapter") == adapter)
    scope = projects.resolve(own.select("project_hint"), known, current)
    rows = own.join(scope.select(F.col("project_hint").alias("hint"), F.col("project_key").alias("resolved"), "scope"), F.col("project_hint").eqNullSafe(F.col("hint")))
    null = F.lit(None).cast("string")
    told = rows.where("scope = 'unresolved'").select(F.lit("project-hint-unavailable").alias("code"), F.lit("the project's folder can't be resolved").alias("message"), "source_id", null.alias("project_hint"))
    return rows.where("scope = 'current'").select(*records.columns, F.col("resolved").alias("project_of")), told.select(*WARNINGS.names)


def host_context(requests: DataFrame, known: DataFrame) -> DataFrame:
    """(request, project_key, native_id, fingerprint, refusal): what a host tells of the session that it runs, against that session as it is now.

    requests: request, session_id, directory, worktree, and the observed session's adapter, native_id, project_hint and
    fingerprint. The folder must be below the worktree or of its repository, and of the session's project.
    """
    paths = requests.select(F.explode(F.array("directory", "worktree", "project_hint")).alias("project_hint"))
    keys = projects.resolve(paths, known).select(F.col("project_hint").alias("path"), "project_key").where("path is not null")
    rows = requests
    for c, name in (("directory", "d"), ("worktree", "w"), ("project_hint", "s")):
        rows = rows.join(keys.select(F.col("path").alias(c), F.col("project_key").alias(name)), c, "left")
    within = F.startswith(F.concat(projects.absolute(F.col("directory")), F.lit("/")), F.concat(F.regexp_replace(projects.absolute(F.col("worktree")), r"/\z", ""), F.lit("/")))
    refusal = (
        F.when(~F.coalesce(F.rlike("session_id", F.lit(r"\Ases_[A-Za-z0-9_-]{1,128}\z")), F.lit(False)), "malformed-host-context")
        .when(~F.coalesce((F.col("adapter") == "opencode") & (F.col("native_id") == F.col("session_id")), F.lit(False)), "host-source-mismatch")
        .when(F.col("d").isNull() | F.col("w").isNull() | F.col("s").isNull(), "malformed-host-context")
        .when((F.col("s") != F.col("d")) | ~(within | (F.col("w") == F.col("d"))), "host-project-mismatch")
    )
    rows = rows.withColumn("refusal", refusal)
    only = lambda c: F.when(F.col("refusal").isNull(), F.col(c))
    return rows.select("request", only("d").alias("project_key"), only("session_id").alias("native_id"), only("fingerprint").alias("fingerprint"), "refusal")


def dispatch(requests: DataFrame, sessions: DataFrame, hosts: DataFrame, excluded: DataFrame) -> DataFrame:
    """(request, kind, code, candidates) of requests (request, harness, project_key, current_native_id), each by the rules of its harness.

    hosts: host_context() of the requests whose harness has one. What a host can't vouch for is unavailable.
    """
    free = candidates(sessions, excluded=excluded)
    asked = requests.where(F.col("harness") == "codex").select("request", "project_key", "current_native_id")
    own = asked.join(free.select("project_key", F.col("native_id").alias("current_native_id"), F.lit(True).alias("named")), ["project_key", "current_native_id"], "left")
    own = own.join(free.groupBy("project_key").agg(F.count("*").alias("candidates")), "project_key", "left").na.fill(0, ["candidates"])
    code, kind = _current(F.col("candidates"), F.col("current_native_id").isNotNull(), F.col("named").isNotNull())
    one = own.select("request", kind.alias("kind"), code.alias("code"), "candidates")
    told = requests.where(F.col("harness") == "opencode").select("request", F.col("project_key").alias("own")).join(hosts, "request", "left")
    exact = told.where(F.col("native_id").isNotNull()).select("request", F.col("own").alias("project_key"), F.col("project_key").alias("host_project"), "native_id", "fingerprint")
    two = resolve_exact(sessions, exact, excluded).withColumn("candidates", F.when(F.col("code") == "host_id_match", F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    none = told.where(F.col("native_id").isNull()).select("request", F.lit("unavailable").alias("kind"), F.coalesce("refusal", F.lit("missing-host-context")).alias("code"), F.lit(0).cast("bigint").alias("candidates"))
    other = requests.where(~F.col("harness").isin("codex", "opencode")).select("request", F.lit("unavailable").alias("kind"), F.lit("unsupported-harness").alias("code"), F.lit(0).cast("bigint").alias("candidates"))
    return one.unionByName(two).unionByName(none).unionByName(other)


def document(found: DataFrame) -> DataFrame:
    """found with `document`: what was resolved as JSON that names no session."""
    reason = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("code")]
    fields = F.struct(F.col("candidates").cast("bigint").alias("candidate_count"), "code", "kind", reason.alias("reason"), F.lit(1).alias("schema_version"))
    return found.withColumn("document", F.to_json(fields))


def confirm(offered: DataFrame, chosen: DataFrame) -> DataFrame:
    """Choices (project_key, source_id) that were offered; anything else isn't confirmed."""
    return chosen.join(offered.select("project_key", "source_id"), ["project_key", "source_id"], "left_semi")


def resolve_exact(sessions: DataFrame, requests: DataFrame, excluded: DataFrame, adapter: str = "opencode") -> DataFrame:
    """(request, kind, code) of requests (request, project_key, host_project, native_id, fingerprint): one exact, fresh session or why not."""
    own = sessions.where(F.col("adapter") == adapter).select("project_key", "native_id", "source_id", "native_available", F.col("fingerprint").alias("held"))
    taken = excluded.select("source_id", F.lit(True).alias("taken")).distinct()
    rows = requests.join(own, ["project_key", "native_id"], "left").join(taken, "source_id", "left")
    rows = rows.groupBy("request").agg(
        F.first("project_key").alias("project_key"),
        F.first("host_project").alias("host_project"),
        F.count("source_id").alias("n"),
        F.bool_or(F.col("taken").isNotNull()).alias("taken"),
        F.bool_and(F.col("native_available")).alias("there"),
        F.bool_and(F.col("held") == F.col("fingerprint")).alias("fresh"),
    )
    code = (
        F.when(F.col("host_project") != F.col("project_key"), "foreign_project")
        .when(F.col("n") == 0, "no_eligible_target")
        .when(F.col("n") > 1, "ambiguous_target")
        .when(F.col("taken"), "selected_source")
        .when(~F.col("there"), "unavailable_target")
        .when(~F.coalesce("fresh", F.lit(False)), "stale_index")
        .otherwise("host_id_match")
    )
    return rows.select("request", F.when(code == "host_id_match", "confirmation_required").otherwise("unavailable").alias("kind"), code.alias("code"))


def resumable(sessions: DataFrame) -> DataFrame:
    """Sessions that their source could take up again, with the shape of id that each source has."""
    uuid = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
    good = F.when(F.col("adapter") == "opencode", F.rlike("native_id", F.lit(r"\Ases_[A-Za-z0-9_-]{1,128}\z"))).otherwise(F.rlike(F.lower("native_id"), F.lit(uuid)))
    reason = F.when(~F.col("native_available"), "unavailable").when(~good, "unsafe-id")
    return sessions.select("source_id", reason.isNull().alias("resumable"), reason.alias("reason"))
