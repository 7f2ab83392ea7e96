"""Types of the engine's tables, and the fixed values that they draw on."""

from __future__ import annotations

from pyspark.sql import types as T

# The sources' keys in their stable order, and the letter of each one's handles.
HARNESSES = ("codex", "grok", "cursor", "claude", "antigravity", "opencode")
HANDLE_LETTERS = {"codex": "C", "grok": "G", "opencode": "O", "cursor": "R", "claude": "L", "antigravity": "A"}
OTHER_LETTER = "S"

# States of sessions and of reads, roles of visible turns, kinds of content that never pass.
HEALTH = ("complete", "possibly_interrupted", "unknown")
HEALTH_LABELS = {"complete": "complete", "possibly_interrupted": "possibly interrupted", "unknown": "unverified"}
READ_STATUS = ("complete", "partial", "unavailable")
ROLES = ("user", "agent")
FORBIDDEN_KINDS = ("system_prompt", "hidden_reasoning", "tool_payload", "tool_result", "file_body")

# Of each source, whether its sessions can be linked from, linked to and resumed, whether its host has a skill, and whether
# its support on Linux is released.
CAPABILITY_FLAGS = ("link_source", "link_destination", "native_resume", "host_skill", "release_claim_linux")
CAPABILITIES = {
    "codex": (True, True, True, True, True),
    "grok": (True, True, True, False, True),
    "opencode": (True, True, True, True, True),
    "cursor": (True, True, True, False, True),
    "claude": (True, True, True, True, False),
    "antigravity": (True, True, True, False, False),
}

SESSIONS = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("project_key", T.StringType()),
    T.StructField("adapter", T.StringType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("native_id", T.StringType()),
    T.StructField("locator", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("project_hint", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("title", T.StringType()),
    T.StructField("health", T.StringType()),
    T.StructField("model_provider", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("effort", T.StringType()),
])

TURNS = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("locator", T.StringType()),
    T.StructField("at", T.TimestampType()),
])

WARNINGS = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("project_hint", T.StringType()),
])

EDGES = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("project_key", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("confirmed_at", T.TimestampType()),
])
