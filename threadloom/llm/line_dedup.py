"""Operator 10: removal of boilerplate lines, judged by how many distinct sites hold a line.

Each line's key gathers a HyperLogLog sketch of the sites that hold it; sketches merge in partial aggregations, so a line
that stands everywhere reaches the last aggregation as one row a task. Estimates far from the threshold decide by
themselves; lines whose estimate lies within BAND of it get an exact distinct count. Documents lose the lines that at
least `min_sites` sites hold. Only DataFrame functions run. Texts are cut into lines once, and once more where they lose
some; a line that stands in a large part of the documents is dealt over many tasks.

Cases: lines are compared without spaces at their ends; blank lines are never boilerplate and stay; a null or empty text
has no line; null sites are one site; a line that a document repeats is removed each time; repeated rows stay repeated;
an empty table gives none; other columns are not read. Texts of any length are cut natively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import spread_join, stored

#: Sites that make a line boilerplate.
MIN_SITES = 5
#: Estimates within this share of the threshold are counted exactly; the sketch's standard error is about 1.6 %.
BAND = 0.25
LOG_REGISTERS = 12
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """128 bits of a line."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def lines(docs: DataFrame) -> DataFrame:
    """(k, th, site, line) of each line that isn't blank, once for each document."""
    keys = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), line_key)
    return docs.select("k", "th", "site", F.explode(F.array_distinct(keys)).alias("line")).select("k", "th", "site", F.col("line.a").alias("a"), F.col("line.b").alias("b"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, n) keys of lines that at least min_sites distinct sites hold, and how many documents hold them."""
    site = F.xxhash64(F.coalesce("site", F.lit("\0")))
    spread = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.hll_sketch_agg(site, F.lit(LOG_REGISTERS)).alias("sketch"))
    # fewer documents than sites are needed can't do
    spread = stored(spread.where(F.col("n") >= min_sites).select("a", "b", "n", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND)).select("a", "b", "n")
    near = spread.where(F.col("sites").between(int(min_sites * (1 - BAND)), min_sites * (1 + BAND))).select("a", "b", "n")
    total = near.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = spread_join(rows, near, ["a", "b"], total).select("a", "b", F.coalesce("site", F.lit("\0")).alias("site")).distinct()
    exact = pairs.groupBy("a", "b").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("a", "b")
    return sure.unionByName(exact.join(near, ["a", "b"]).select("a", "b", "n"))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """A row per document: doc_id, n_lines (not blank), n_removed, kept_text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(site).cast("string").alias("site"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("th", F.xxhash64("text"))
    held = stored(lines(rows), "lines")
    bad = stored(boilerplate(held, min_sites), "boilerplate")
    found = spread_join(held, bad, ["a", "b"], bad.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    marked = found.groupBy("k", "th").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    out = rows.select("doc_id", "text", "k", "th").join(marked, ["k", "th"], "left")
    gone = lambda x: F.coalesce(F.array_contains("gone", line_key(x)), F.lit(False)) & (F.trim(x) != "")
    cut = F.split("text", "\n")
    return out.select(
        "doc_id",
        F.size(F.filter(cut, lambda x: F.trim(x) != "")).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.filter(cut, gone))).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(cut, lambda x: ~gone(x)), "\n")).alias("kept_text"),
    )


ORACLE = f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), held AS (
  SELECT r, doc_id, site, unnest(parts) AS line, unnest(range(len(parts))) AS at FROM cut
), bad AS (
  SELECT trim(line, ' ') AS line FROM held WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}
)
SELECT any_value(h.doc_id) AS doc_id,
       count(*) FILTER (WHERE trim(h.line, ' ') <> '') AS n_lines,
       count(b.line) AS n_removed,
       coalesce(string_agg(h.line, chr(10) ORDER BY h.at) FILTER (WHERE b.line IS NULL), '') AS kept_text
FROM held h LEFT JOIN bad b ON trim(h.line, ' ') = b.line GROUP BY h.r
"""
