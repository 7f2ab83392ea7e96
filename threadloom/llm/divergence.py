"""Operator 12: how far the sources of a language diverge, as the exact L1 distance of smoothed shares over all kept terms.

A distance is taken apart by the two supports (inclusion and exclusion): terms that one source has cost what its count has
against the other's empty share, so a histogram of its counts prices them for every other source, in one sorted pass over
histogram and empty shares; terms that neither has cost one constant each; and terms that both have were priced twice, which
a join of sparse postings corrects. That join goes by blocks of SOURCES sources: a task reads the postings of two blocks by
term and adds to one small matrix, so no pair leaves it for a term, only sums for a pair of sources.

Terms are counted in Python over whole texts, cut in pieces, into tables that are handed on when they are large; a term is
split over as many tasks as there are, and sums meet by partial aggregation. All numbers are integers; shares are divided
as decimals of 38 digits.

Cases: null text, lang and source are ''; groups without terms have rows, and zero counts of every kept term; a language
without kept terms has distances of 0 and no terms; a language with one source has no pairs; equal values are ranked by
item; repeated rows are documents each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import RELEASE, chunks, group_numbers, numbered, small_batches, stored

#: Documents that a kept term stands in at least, what is added to each count, shares' unit, and ranks of terms that are told.
MIN_DOCS, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of a text that are cut into terms at once; entries and bytes of a task's table at most.
PIECE, ENTRIES, HELD_BYTES = 1 << 22, 1 << 19, 1 << 26
#: Sources of a block, and places over which a pair of blocks is dealt by term.
SOURCES, SALTS = 256, 1024

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
COUNTS = "lang string, source string, term string, n long, docs long"


def pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].lower()  # of bytes, only A-Z
        at = end


def count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS for what a task has read, and a row without a term for each group."""
    for free in RELEASE:
        free()
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    entries = held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *n]
            columns = [[lang] * len(terms), [source] * len(terms), pa.array(terms, pa.binary()).cast(pa.string()), [0, *n.values()], [0, *(docs[t] for t in n)]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns], ["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
            n, docs = groups[lang, source]
            before, seen = len(n), set()
            for piece in pieces(text.as_buffer().to_pybytes()):
                terms = _TERM.findall(piece)
                n.update(terms)
                once = set(terms) - seen
                docs.update(once)
                seen |= once
                held += sum(map(len, once))
            entries += len(n) - before
            if entries > ENTRIES or held > HELD_BYTES:
                yield from told()
                entries = held = 0
    yield from told()


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (count + ADDED) / (total + ADDED terms)), exactly."""
    return F.expr(f"1 + (cast({UNIT} as decimal(38, 0)) * ({count} + {ADDED})) div ({total} + {ADDED} * {terms})")


def overlaps(batches: Iterable[pa.RecordBatch], sources: int) -> Iterator[pa.RecordBatch]:
    """(lang, i, j, value, both): for two sources of the blocks what the terms of both add, and their number. Rows: lang, a, b, term, i, p, z, sorted."""
    for free in RELEASE:
        free()
    key, value, both = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(both)
        if key and len(at):
            i, j = at // sources + key[1] * sources, at % sources + key[2] * sources
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.string()), *map(pa.array, (i, j, value[at], both[at]))], ["lang", "i", "j", "value", "both"])

    for table in chunks(batches, ["lang", "a", "b", "term"], 1 << 14):
        place = group_numbers(table, ["lang", "a", "b"])
        for k in range(int(place[-1]) + 1):
            at = np.flatnonzero(place == k)
            part = table.slice(int(at[0]), len(at))
            now = (part["lang"][0].as_py(), part["a"][0].as_py(), part["b"][0].as_py())
            if now != key:
                yield from told()
                key, value, both = now, np.zeros(sources * sources, np.int64), np.zeros(sources * sources, np.int64)
            term = group_numbers(part, ["term"])
            i, p, z = (part[c].to_numpy() for c in ("i", "p", "z"))
            _, a, b = now
            block = i // sources
            for d in range(1, int(np.bincount(term).max())):
                x = np.flatnonzero(term[d:] == term[:-d])
                y = x + d
                if a != b:
                    meet = (block[x] == a) & (block[y] == b)
                    x, y = x[meet], y[meet]
                cell = (i[x] - a * sources) * sources + i[y] - b * sources
                np.add.at(value, cell, np.abs(p[x] - p[y]) - np.abs(p[x] - z[y]) - np.abs(z[x] - p[y]))
                np.add.at(both, cell, 1)
    yield from told()


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, sources: int = SOURCES) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: distances to the language's other sources, and the terms that a source has too often."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = small_batches(texts).mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counted, "audit-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    terms = stored(terms.where(F.col("docs") >= min_docs).drop("docs"), "audit-terms")
    langs = stored(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_size")), "audit-langs")
    postings = stored(counts.where("term is not null").drop("docs").join(terms, ["lang", "term"]), "audit-postings")

    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    groups = numbered(counts.where("term is null").select("lang", "source"), "lang", ["source"], "audit-groups").drop("n")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "own", "kept", "all_size"])
    groups = stored(groups.withColumn("z", F.when(F.col("kept") > 0, share("0", "size", "kept")).otherwise(F.lit(0))), "audit-sources")
    priced = postings.join(groups, ["lang", "source"]).withColumn("p", share("n", "size", "kept")).withColumn("q", share("all_n", "all_size", "kept"))
    priced = stored(priced.select("lang", "source", "i", "term", "p", "q", "z"), "audit-shares")

    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    pairs = distances(groups, priced, stored(priced.groupBy("lang", "i", "p").agg(F.count("*").alias("m")), "audit-histograms"), sources)
    names = groups.select("lang", "i", "source")
    told = pairs.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x"), "value").select("lang", "x.*", "value")
    told = told.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    told = told.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return told.unionByName(over)


def distances(groups: DataFrame, priced: DataFrame, histograms: DataFrame, sources: int) -> DataFrame:
    """(lang, i, j, value) for any two sources of a language, i < j."""
    one, two = groups.alias("g"), groups.alias("h")
    meet = one.join(two, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.i") != F.col("h.i")))
    none = F.col("g.kept") - F.col("g.own") - F.col("h.own")
    asked = meet.select(F.col("g.lang").alias("lang"), F.col("g.i").alias("i"), F.col("h.i").alias("j"), F.col("h.z").alias("at"), F.lit(0).cast("bigint").alias("m"), none.alias("none"), F.abs(F.col("g.z") - F.col("h.z")).alias("apart"))
    null = F.lit(None).cast("bigint")
    points = histograms.select("lang", "i", null.alias("j"), F.col("p").alias("at"), "m", null.alias("none"), null.alias("apart"))
    # what a source's own terms cost against an empty share: sums below it and above it
    whole = Window.partitionBy("lang", "i")
    upto = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m, s = F.col("m"), F.col("m") * F.col("at")
    cost = F.col("at") * (2 * F.sum(m).over(upto) - F.sum(m).over(whole)) + F.sum(s).over(whole) - 2 * F.sum(s).over(upto)
    sided = asked.unionByName(points).withColumn("cost", cost).where("j is not null")
    low, high = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    sided = sided.select("lang", low, high, F.col("cost").alias("value"), F.lit(0).cast("bigint").alias("both"), "none", "apart")

    block = F.expr(f"i div {sources}")
    blocks = groups.groupBy("lang").agg(F.expr(f"max(i) div {sources}").alias("last"))
    rows = priced.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    rows = rows.select("lang", F.least(block, "other").alias("a"), F.greatest(block, "other").alias("b"), "term", "i", "p", "z")
    deal = ["lang", "a", "b", F.pmod(F.xxhash64("term"), F.lit(SALTS))]
    rows = rows.repartition(*deal).sortWithinPartitions("lang", "a", "b", "term", "i")
    shared = rows.mapInArrow(lambda batches: overlaps(batches, sources), "lang string, i long, j long, value long, both long")
    shared = shared.select("*", null.alias("none"), null.alias("apart"))
    sums = sided.unionByName(shared).groupBy("lang", "i", "j").agg(*(F.sum(c).alias(c) for c in ("value", "both")), *(F.max(c).alias(c) for c in ("none", "apart")))
    return sums.select("lang", "i", "j", (F.col("value") + (F.col("none") + F.col("both")) * F.col("apart")).alias("value"))


ORACLE = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
lang AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM doc),
cell AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, (SELECT count(*) FROM word w WHERE w.lang = g.lang AND w.source = g.source AND w.term = k.term) AS n FROM grp g JOIN kept k USING (lang)),
share AS (SELECT lang, source, term, n, 1 + (CAST({UNIT} AS HUGEINT) * (n + {ADDED})) // (sum(n) OVER (PARTITION BY lang, source) + {ADDED} * v) AS p, 1 + (CAST({UNIT} AS HUGEINT) * (lang_n + {ADDED})) // (size + {ADDED} * v) AS q FROM cell JOIN lang USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM over))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
