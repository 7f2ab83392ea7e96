"""Operator 13: a Merkle manifest of a dataset: leaves, a subroot for each language, one root, and each row's proof.

Leaves get their row numbers from a range sort: the place inside a sorted partition plus the rows of the partitions before
it, so no language is ever numbered by one task. A level is an aggregation by the row number divided by FANOUT: at most
FANOUT children meet, sorted, and are hashed into their parent. Levels are written as they come, each an eighth of the one
below. Proofs come from the top: a level's rows are joined with those of the level above, whose siblings they append, so a
level moves its own rows only, and leaves meet the whole of their path in one join. DataFrame functions only.

Cases: a null value is `-`, which no text can be, and an empty one `0:`; equal rows are leaves each, side by side; equal or
null ids (which come first) are ordered by leaf; a row without an id is never tampered with; a null language is a language
of its own and the first; a lone leaf is its subroot and a lone subroot the root, with no siblings; an empty table gives no
row; other columns are neither hashed nor read. Ids of any type are sorted as that type sorts. Texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import numbered, stored

#: Consecutive nodes that one parent holds.
FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex of the sha256 of texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A value's bytes behind their number, so that no two rows are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(*(encoded(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))


def levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The parents of nodes (k, i, n, h), level by level as (k, i, n, h, kids), and (k, h) of each k's last node."""
    found: list[DataFrame] = []
    tops = nodes.where("n = 1").select("k", "h")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = nodes.where("n > 1").groupBy("k", F.expr(f"i div {FANOUT}").alias("i"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"))
        kids = up.agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("kids")).withColumn("kids", F.col("kids.h"))
        nodes = stored(kids.withColumn("h", F.sha2(F.array_join("kids", ""), 256)), f"{name}-{len(found) + 1}")
        found.append(nodes)
        tops = tops.unionByName(nodes.where("n = 1").select("k", "h"))
        most = -(-most // FANOUT)
    return found, tops


def _step(kids: Column, at: Column) -> Column:
    """What stands before and after a node among its parent's children."""
    return F.struct(F.array_join(F.slice(kids, 1, at), "").alias("before"), F.array_join(F.slice(kids, at + 2, FANOUT), "").alias("after"))


def below(rows: DataFrame, parents: DataFrame | None, tops: DataFrame, carried: list[str]) -> DataFrame:
    """rows (k, i, n, ...) with `path`, the siblings from their own level up, and what the tops (k, path, ...) carry."""
    lone = (rows if parents is None else rows.where("n = 1")).join(tops.select("k", "path", *carried), "k")
    if parents is None:
        return lone
    over = parents.select("k", F.col("i").alias("up"), F.col("kids").alias("around"), F.col("path").alias("rest"), *carried)
    under = rows.where("n > 1").withColumn("up", F.expr(f"i div {FANOUT}")).join(over, ["k", "up"])
    own = F.array(_step(F.col("around"), (F.col("i") % FANOUT).cast("int")))
    return under.withColumn("path", F.concat(own, "rest")).drop("up", "around", "rest").unionByName(lone)


def proofs(leaves: DataFrame, found: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """leaves with their whole path: levels are joined from the highest down."""
    over = None
    for level in reversed(found):
        over = below(level, over, tops, carried)
    return below(leaves, over, tops, carried)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, step: digest(step["before"], node, step["after"]))


def manifest(docs: DataFrame) -> DataFrame:
    """(k, i, n, doc_id, leaf, other, subroot, root, path): each row's leaf, proof and the leaf of its tampered text, null if it isn't.

    k is the language as a text that null comes first of.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(F.translate("text", UPPER, LOWER)))
    k = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    leaves = docs.select(k.alias("k"), "doc_id", leaf(F.col("text")).alias("h"), tampered.alias("other"))
    leaves = numbered(leaves, "k", ["doc_id", "h"], "merkle-leaves")
    found, tops = levels(leaves.select("k", "i", "n", "h"), "merkle-level")
    langs = numbered(tops.select(F.lit("").alias("all"), F.col("k").alias("lang"), "h"), "all", ["lang"], "merkle-subroots")
    langs = langs.select(F.col("all").alias("k"), "lang", "i", "n", "h")
    over, root = levels(langs.select("k", "i", "n", "h"), "merkle-over")
    none = F.array().cast("array<struct<before:string,after:string>>")
    subroots = proofs(langs, over, root.select("k", none.alias("path"), F.col("h").alias("root")), ["root"])
    subroots = stored(subroots.select(F.col("lang").alias("k"), F.col("h").alias("subroot"), "root", "path"), "merkle-tops")
    return proofs(leaves, found, subroots, ["subroot", "root"]).withColumnRenamed("h", "leaf")


def merkle(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row."""
    rows = manifest(docs)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format
_UP = "SELECT {0}l + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {1} WHERE n > 1 GROUP BY {0}l, i // 8".format
_FOLD = (
    "SELECT w.r, w.k, w.l + 1, w.i // 8, (w.n + 7) // 8, sha256(string_agg(CASE WHEN x.i = w.i THEN w.cur ELSE x.h END, '' ORDER BY x.i)), w.sibs || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i <> w.i), '') "
    "FROM {0} w JOIN {1} x ON {2} x.l = w.l AND x.i // 8 = w.i // 8 WHERE w.n > 1 GROUP BY w.r, w.k, w.l, w.i, w.n, w.cur, w.sibs"
).format
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))
), fields AS (
  SELECT row_number() OVER () AS r, coalesce('+' || lang, '') AS k, doc_id, text, translate(text, '{UPPER}', '{LOWER}') AS low, {_FIELD("doc_id")} || {_FIELD("source")} || {_FIELD("lang")} || {_FIELD("n_chars")} AS head,
         list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) AS c
  FROM documents, crc
), hashed AS (
  SELECT r, k, doc_id, sha256(head || {_FIELD("text")}) AS leaf, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN sha256(head || {_FIELD("low")}) END AS other FROM fields
), leaves AS (
  SELECT r, k, doc_id, leaf, other, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM hashed
), node AS (
  SELECT k, 0 AS l, i, n, leaf AS h FROM leaves UNION ALL {_UP("k, ", "node")}
), sub AS (
  SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
), over_sub AS (
  SELECT 0 AS l, i, n, h FROM sub UNION ALL {_UP("", "over_sub")}
), way AS (
  SELECT r, k, 0 AS l, i, n, coalesce(other, leaf) AS cur, '' AS sibs FROM leaves UNION ALL {_FOLD("way", "node", "x.k = w.k AND")}
), last AS (
  SELECT r, k, 0 AS l, sub.i AS i, sub.n AS n, cur, sibs FROM way JOIN sub USING (k) WHERE way.n = 1 UNION ALL {_FOLD("last", "over_sub", "")}
)
SELECT a.doc_id, a.leaf, sub.h AS subroot, top.h AS root, sha256(w.sibs) AS proof_sha256, w.cur AS folded_root, w.cur = top.h AS verified
FROM leaves a JOIN sub USING (k) JOIN last w USING (r) JOIN over_sub top ON top.n = 1 WHERE w.n = 1
"""
