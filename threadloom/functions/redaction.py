"""Redaction: an ordered set of patterns, each of which sees what the one before it left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.schema import FORBIDDEN_KINDS

# Label, pattern and replacement of each rule, in their order.
RULES = (
    ("private-key", r"(?s)-----BEGIN [^-\r\n]*PRIVATE KEY-----.*?-----END [^-\r\n]*PRIVATE KEY-----", "[REDACTED:private-key]"),
    ("bearer-token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED:token]"),
    (
        "known-token",
        r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})\b",
        "[REDACTED:token]",
    ),
    (
        "credential-assignment",
        r"""(?i)\b((?:API_KEY|ACCESS_KEY|SECRET_KEY|CLIENT_SECRET|AUTH_TOKEN|TOKEN|PASSWORD|PASSWD|[A-Z][A-Z0-9_]+_(?:KEY|TOKEN|SECRET|PASSWORD)))\s*[:=]\s*(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\s,;}]+)""",
        "$1=[REDACTED:credential]",
    ),
    ("uri-password", r"(?i)(https?://)([^:/\s]+):[^@/\s]+@", "$1$2:[REDACTED:password]@"),
    ("home-path", r"(?i)(?<![A-Za-z0-9])(?:/(?:home|Users)/[^/\s]+|/root\b|[A-Za-z]:[\\/]Users[\\/][^\\/\s]+)", "~"),
)


# What each rule's matches hold at least, in lower case; a text without any of these needs no pattern.
NEEDS = {
    "private-key": ("private key-----",), "bearer-token": ("bearer",), "known-token": ("akia", "gh", "sk-", "eyj"),
    "credential-assignment": ("key", "token", "secret", "passw"), "uri-password": ("://",), "home-path": ("/home/", "users", "/root"),
}


def _may_hold(lower: Column, label: str) -> Column:
    found = F.lit(False)
    for part in NEEDS.get(label, ("",)):
        found = found | F.contains(lower, F.lit(part))
    return found


def redact(text: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(text, count, labels): the text redacted, how many matches, and the rules that matched, in order.

    A rule's pattern runs only on what the rules before it left, if that holds what the rule's matches must hold.
    """
    state = F.struct(text.alias("text"), F.lit(0).alias("count"), F.array().cast("array<string>").alias("labels"))
    for rule in rules:
        # through a lambda, which names the state once: used directly, expressions would double with each rule
        state = F.transform(F.array(state), _step(*rule))[0]
    return state


def _step(label: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        return F.when(_may_hold(F.lower(s["text"]), label), _replaced(s, label, pattern, replacement)).otherwise(s)

    return step


def _replaced(s: Column, label: str, pattern: str, replacement: str) -> Column:
    found = F.coalesce(F.regexp_count(s["text"], F.lit(pattern)), F.lit(0))
    labels = F.when(found > 0, F.concat(s["labels"], F.array(F.lit(label)))).otherwise(s["labels"])
    return F.struct(F.when(found > 0, F.regexp_replace(s["text"], pattern, replacement)).otherwise(s["text"]).alias("text"), (s["count"] + found).alias("count"), labels.alias("labels"))


def redacted_text(text: Column) -> Column:
    """The text of redact() alone."""
    return redact(text)["text"]


def redact_content(text: Column, kind: Column) -> Column:
    """As redact(); null where the kind of content is one that never passes."""
    return F.when(~kind.isin(*FORBIDDEN_KINDS), redact(text))


def required_redaction(text: Column, kind: Column) -> Column:
    """As redact_content(); a kind that never passes is a programming error."""
    return F.when(kind.isin(*FORBIDDEN_KINDS), F.raise_error(F.concat(F.lit("content was excluded: "), kind)).cast("struct<text:string,count:int,labels:array<string>>")).otherwise(redact(text))


def kept_title(title: Column, limit: int = 256) -> Column:
    """A title as it is stored: redacted, cut, and null if nothing is left."""
    text = F.substring(redacted_text(title), 1, limit)
    return F.when(F.trim(text) != "", text)
