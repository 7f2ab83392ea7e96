"""Scalar functions over text, times and tokens, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks cut text, and the limits of labels and excerpts in characters.
TRUNCATED = "…[Truncated]"
EXCERPT_MARKER = "\n\n[Excerpt truncated]"
LABEL_LIMIT, EXCERPT_LIMIT, SNIPPET_LIMIT, TITLE_LIMIT, LOCATOR_LIMIT = 96, 2048, 240, 256, 256
# Verbs that open a sentence which states a task.
TASK_VERBS = (
    "add", "analyze", "build", "check", "compare", "create", "debug", "design", "draft", "explain", "find", "fix", "give", "implement",
    "investigate", "list", "make", "plan", "prepare", "recommend", "recover", "resume", "review", "summarize", "test", "update", "write",
)
# Beginnings of what hosts put before a user's own words.
ENVELOPES = (
    "# agents.md instructions for ", "<environment_context>", "<permissions instructions>", "<skills_instructions>", "<apps_instructions>",
    "<plugins_instructions>", "<recommended_plugins>",
)
SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def bounded(text: Column, limit: int, marker: str = TRUNCATED) -> Column:
    """At most `limit` characters; what is longer is cut and ends in the marker."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(strip_end(F.substring(text, 1, max(1, limit - len(marker)))), F.lit(marker)))


def is_envelope(text: Column) -> Column:
    start = F.lower(F.regexp_replace(text, r"(?U)\A\s+", ""))
    return F.exists(F.array(*map(F.lit, ENVELOPES)), lambda p: F.startswith(start, p))


def task_sentence(text: Column) -> Column:
    """The first sentence that opens with a task verb, else all of the text, white space collapsed."""
    flat = collapse(text)
    sentences = F.split(flat, r"(?<=[.!?])\s+")
    word = lambda s: F.lower(F.regexp_extract(s, r"""\A["'(\[{ ]*(\S+)""", 1))
    return F.coalesce(F.get(F.filter(sentences, lambda s: word(s).isin(*TASK_VERBS)), F.lit(0)), flat)


def command_label(text: Column, command: str, labels: dict[str, str], other: str) -> Column:
    """The label of a text that calls `command` ($name or /name) with an action; null for other texts."""
    flat = F.lower(collapse(text))
    action = F.regexp_extract(flat, rf"\A[$/]{command}(?:\s+(\S+))?", 1)
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[action] if labels else F.lit(None).cast("string")
    return F.when(F.rlike(flat, F.lit(rf"\A[$/]{command}(\s|\z)")), F.coalesce(known, F.lit(other)))


# The shapes of native session ids, and the tags that hosts put around a goal.
NATIVE_UUID = r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"
NATIVE_SES = r"(?<![A-Za-z0-9_])ses_[A-Za-z0-9_-]+"
GOAL_TAGS = r"(?is)<timestamp>.*?</timestamp>\s*|<user_query>\s*|</user_query>"


def conceal_ids(text: Column) -> Column:
    """Native session ids (UUIDs, then ses_ ids) as [session]."""
    return F.regexp_replace(F.regexp_replace(text, NATIVE_UUID, "[session]"), NATIVE_SES, "[session]")


def compact_id(value: Column) -> Column:
    """The end of an id, as it is drawn."""
    return F.right(value, F.lit(12))


def merged_header(observed: Column, known: Column) -> Column:
    """A header's value: what was observed while reading, else what was known before; both sanitised."""
    return F.coalesce(header_value(observed), header_value(known))


def normal_goal(text: Column) -> Column:
    """A goal without the tags that hosts put around it, white space collapsed, in lower case."""
    return F.lower(collapse(F.regexp_replace(text, GOAL_TAGS, "")))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("bigint")


def rfc3339(at: Column) -> Column:
    """UTC, with microseconds only where there are any."""
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    return F.when(micros == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def cited_time(turns: DataFrame) -> Column:
    """The time of a turn as a citation has it; null where the source, or the table, has none."""
    return rfc3339(F.col("at")) if "at" in turns.columns else F.lit(None).cast("string")


def parse_time(text: Column, naive_is_utc: bool = False) -> Column:
    """A timestamp with an offset; one without is null, or UTC where the source says so. Anything else is null."""
    has_offset = F.rlike(text, F.lit(r"(Z|[+-]\d\d:?\d\d)\z"))
    at = F.try_to_timestamp(text)
    return at if naive_is_utc else F.when(has_offset, at)


def epoch_time(value: Column, unit: str) -> Column:
    """Seconds or milliseconds since 1970; negative ones are null."""
    number = value.cast("double")
    return F.when(number >= 0, F.timestamp_micros((number * (1_000_000 if unit == "s" else 1_000)).cast("bigint")))


def header_value(text: Column) -> Column:
    """A trimmed value of at most 128 characters without white space or control characters, else null."""
    value = F.trim(text)
    return F.when(F.rlike(value, F.lit(r"(?U)\A[^\s\p{C}]{1,128}\z")), value)


def indented(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^", "    ")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def without_controls(text: Column, limit: int = 80) -> Column:
    return F.substring(F.regexp_replace(text, r"\p{C}", "?"), 1, limit)


def percent_decoded(text: Column) -> Column:
    """Percent escapes as characters; a plus stays a plus."""
    return F.url_decode(F.regexp_replace(text, r"\+", "%2B"))


def path_slug(path: Column) -> Column:
    return F.translate(path, "/", "-")


def workspace_folder(path: Column) -> Column:
    """The name of a workspace's folder among the chats."""
    return F.md5(path.cast("binary"))


def first_non_blank(*values: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def header_label(provider: Column, model: Column, effort: Column, turns: Column, size: Column, origin: Column) -> Column:
    """A session's facts in one line; what is null is left out. Sizes halfway between two tenths become the even one."""
    kib = F.format_string("~%.1f KiB", F.bround(size / 1024, 1))
    return F.concat_ws(" · ", F.concat_ws("/", provider, model), effort, F.format_string("%d turns", turns), kib, origin)
