"""Full-text search: positional postings, a small query language, Okapi BM25, phrases, prefixes and snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from unicodedata import normalize

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.porter import stem, stemmed
from threadloom.operators import discovery

K1, B = 1.2, 0.75
SNIPPET_TOKENS = 18
#: What a search that finds nothing suggests.
HINTS = ("Try fewer or more general words.", "Quote words that must stand together.", "End a word with * to match its beginnings.", "Remove filters.")
#: Lower-case Latin letters with marks, and the letters below the marks.
_MARKED = [c for c in map(chr, range(0xE0, 0x180)) if c.islower() and len(normalize("NFD", c)) > 1 and normalize("NFD", c)[0].isascii()]
_FOLD_FROM, _FOLD_TO = "".join(_MARKED), "".join(normalize("NFD", c)[0] for c in _MARKED)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(documents: DataFrame, stems: bool = True) -> DataFrame:
    """(project_key, source_id, term, positions, length): the inverted index. documents: source_id, project_key, search_text.

    Stems are taken of the distinct words of all documents, once each, and joined; nothing else of it runs in Python. Kept
    in files that are sorted by term, a search reads its terms only, and stems nothing but the query.
    """
    rows = documents.select("project_key", "source_id", words(F.col("search_text")).alias("words"))
    rows = rows.select("project_key", "source_id", F.size("words").alias("length"), F.posexplode("words").alias("position", "word"))
    if not stems:
        return rows.groupBy("project_key", "source_id", "length", F.col("word").alias("term")).agg(F.array_sort(F.collect_list("position")).alias("positions"))
    by_word = rows.groupBy("project_key", "source_id", "length", "word").agg(F.collect_list("position").alias("positions"))
    stems_of = rows.select("word").distinct().withColumn("term", stemmed(F.col("word")))
    return by_word.join(stems_of, "word").groupBy("project_key", "source_id", "length", "term").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


#: Documents of about one length that one block of an index holds, more or less; lengths of a block differ by this power of 2.
BLOCK, BANDS = 1024, 4
#: Blocks of the highest bounds from which a search takes its first results.
SEED = 32


def with_blocks(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Postings with `block`: the project's documents of about one length, dealt into groups of some BLOCK of them."""
    band = F.when(F.col("length") > 0, F.floor(BANDS * F.log2("length"))).otherwise(0).cast("bigint")
    counts = documents.withColumn("band", band).groupBy("project_key", "band").agg(F.ceil(F.count("*") / BLOCK).alias("slots"))
    rows = index.withColumn("band", band).join(counts, ["project_key", "band"])
    return rows.withColumn("block", F.shiftleft("band", 40) + F.pmod(F.xxhash64("source_id"), F.col("slots"))).drop("band", "slots")


def maxima(index: DataFrame) -> DataFrame:
    """(project_key, source_id, term, block, documents, top, shortest, of): for each term and block what bounds its scores.

    source_id is null; `of` is only told by withdrawn().
    """
    null = F.lit(None)
    best = index.groupBy("project_key", "term", "block").agg(F.count("*").alias("documents"), F.max(F.size("positions")).alias("top"), F.min("length").alias("shortest"))
    return best.select("project_key", null.cast("string").alias("source_id"), "term", "block", "documents", "top", "shortest", null.cast("bigint").alias("of"))


def withdrawn(documents: DataFrame, stems: bool = True) -> DataFrame:
    """As maxima(), what documents that are replaced take from the numbers of their terms. documents: with `_at`, the segment that they came in."""
    null = F.lit(None)
    terms = postings(documents, stems).select("project_key", "source_id", "term").join(documents.select("project_key", "source_id", "_at"), ["project_key", "source_id"])
    rows = terms.groupBy("project_key", "term", "_at").agg((-F.count("*")).alias("documents"))
    return rows.select("project_key", null.cast("string").alias("source_id"), "term", null.cast("bigint").alias("block"), "documents", null.cast("int").alias("top"), null.cast("int").alias("shortest"), F.col("_at").alias("of"))


def joined_maxima(made: dict[str, DataFrame], own: DataFrame, starts: DataFrame, part) -> DataFrame:
    """maxima of joined segments: made anew, and what is withdrawn from segments before them."""
    older = own.where("of is not null").withColumn("_part", part(F.col("project_key"))).join(starts, "_part").where("of < _from")
    return maxima(made["postings"]).unionByName(older.drop("_part", "_from"))


# ---------------------------------------------------------------- queries


@dataclass(frozen=True)
class Phrase:
    """Terms that stand one after the other; one term is a phrase, too. prefix: the last one is a beginning."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    left: Phrase | Node
    right: Phrase | Node


class QueryError(ValueError):
    pass


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*)?|([()])|(\+)|([^\s()"*+]+)(\*)?)')


def parse(query: str, stems: bool = True) -> Phrase | Node:
    """Words (all must occur), "phrases", a + b (a phrase), word*, AND, OR, NOT and parentheses."""
    if not query.strip():
        raise QueryError("blank query")
    tokens: list[tuple[str, object]] = []
    at = 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError("malformed query")
        at = m.end()
        if m[1] is not None:
            tokens.append(("phrase", Phrase(_terms(m[1].replace('""', '"'), stems, bool(m[2])), bool(m[2]))))
        elif m[3] or m[4]:
            tokens.append((m[3] or m[4], None))
        elif m[5] in ("AND", "OR", "NOT"):
            tokens.append((m[5], None))
        elif not re.fullmatch(r"[\w\u0080-\U0010ffff]+", m[5]):
            raise QueryError("malformed query")
        else:
            tokens.append(("phrase", Phrase(_terms(m[5], stems, bool(m[6])), bool(m[6]))))
    tree, rest = _or(tokens)
    if rest:
        raise QueryError("malformed query")
    return tree


def _terms(text: str, stems: bool, prefix: bool) -> tuple[str, ...]:
    found = re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(_FOLD_FROM, _FOLD_TO)))
    return tuple(stem(w) if stems and not (prefix and i == len(found) - 1) else w for i, w in enumerate(found))


def _or(t: list) -> tuple:
    left, t = _and(t)
    while t and t[0][0] == "OR":
        right, t = _and(t[1:])
        left = Node("or", left, right)
    return left, t


def _and(t: list) -> tuple:
    left, t = _not(t)
    while t and (t[0][0] in ("AND", "phrase", "(")):
        right, t = _not(t[1:] if t[0][0] == "AND" else t)
        left = Node("and", left, right)
    return left, t


def _not(t: list) -> tuple:
    left, t = _one(t)
    while t and t[0][0] == "NOT":
        right, t = _one(t[1:])
        left = Node("not", left, right)
    return left, t


def _one(t: list) -> tuple:
    if not t:
        raise QueryError("malformed query")
    kind, value = t[0]
    if kind == "(":
        inner, t = _or(t[1:])
        if not t or t[0][0] != ")":
            raise QueryError("malformed query")
        return inner, t[1:]
    if kind != "phrase":
        raise QueryError("malformed query")
    t = t[1:]
    while t and t[0][0] == "+":
        if len(t) < 2 or t[1][0] != "phrase":
            raise QueryError("malformed query")
        value, t = Phrase(value.terms + t[1][1].terms, t[1][1].prefix), t[2:]
    return value, t


def phrases(tree: Phrase | Node) -> list[Phrase]:
    """The phrases that count for relevance: all but those that must not occur."""
    if isinstance(tree, Phrase):
        return [tree]
    return phrases(tree.left) + ([] if tree.kind == "not" else phrases(tree.right))


def all_phrases(tree: Phrase | Node) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else all_phrases(tree.left) + all_phrases(tree.right)


# ---------------------------------------------------------------- scoring


def _holds(tree: Phrase | Node, number: dict[Phrase, int]) -> Column:
    if isinstance(tree, Phrase):
        return F.size(F.col(f"at{number[tree]}")) > 0
    left, right = _holds(tree.left, number), _holds(tree.right, number)
    return left & right if tree.kind == "and" else left | right if tree.kind == "or" else left & ~right


def _minus(i: int):
    return lambda p: p - i


def _span(n: int):
    return lambda p: F.struct(p.alias("start"), F.lit(n).alias("n"))


def _starts(phrase: Phrase) -> Column:
    """Where the phrase begins, from the map of a document's positions by query term."""
    empty = F.array().cast("array<int>")
    keys = [("p:" if phrase.prefix and i == len(phrase.terms) - 1 else "t:") + t for i, t in enumerate(phrase.terms)]
    if not keys:
        return empty
    found = F.coalesce(F.col("terms")[keys[0]], empty)
    for i, k in enumerate(keys[1:], 1):
        found = F.array_intersect(found, F.transform(F.coalesce(F.col("terms")[k], empty), _minus(i)))
    return found


def matches(index: DataFrame, tree: Phrase | Node) -> DataFrame:
    """(project_key, source_id, length, at0, at1, …): documents that the query holds for, with each phrase's places."""
    every = list(dict.fromkeys(all_phrases(tree)))
    exact = sorted({t for p in every for i, t in enumerate(p.terms) if not (p.prefix and i == len(p.terms) - 1)})
    starts = sorted({p.terms[-1] for p in every if p.prefix and p.terms})
    hit = F.array_compact(F.array(F.when(F.col("term").isin(*exact), F.concat(F.lit("t:"), "term")), *(F.when(F.startswith("term", F.lit(s)), F.lit("p:" + s)) for s in starts)))
    wanted = F.col("term").isin(*exact)
    for s in starts:
        wanted = wanted | F.startswith("term", F.lit(s))
    # only the query's terms leave the scan; a document's few rows meet in one shuffle
    rows = index.where(wanted).select("project_key", "source_id", "length", F.explode(hit).alias("key"), "positions")
    by_key = rows.groupBy("project_key", "source_id", "length", "key").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    docs = by_key.groupBy("project_key", "source_id", "length").agg(F.map_from_entries(F.collect_list(F.struct("key", "positions"))).alias("terms"))
    number = {p: i for i, p in enumerate(every)}
    docs = docs.withColumns({f"at{i}": _starts(p) for p, i in number.items()})
    return docs.where(_holds(tree, number)).drop("terms")


def score(index: DataFrame, tree: Phrase | Node, statistics: DataFrame | None = None) -> DataFrame:
    """(project_key, source_id, score, hits): Okapi BM25 of the query's phrases, over documents of all projects.

    Numbers of documents and their mean length come from one pass over (source_id, length); document frequencies of the
    query's phrases from its matches. Both are one row, and are broadcast.
    """
    every = list(dict.fromkeys(all_phrases(tree)))
    counted = [every.index(p) for p in dict.fromkeys(phrases(tree))]
    # frequencies are over all documents that hold a phrase, not only those that hold the query
    any_of = every[0]
    for p in every[1:]:
        any_of = Node("or", any_of, p)
    found = matches(index, any_of)
    number = {p: i for i, p in enumerate(every)}
    totals = statistics if statistics is not None else index.select("project_key", "source_id", "length").distinct().agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    frequencies = found.agg(*(F.count_if(F.size(f"at{i}") > 0).alias(f"df{i}") for i in counted))
    rows = found.where(_holds(tree, number)).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(frequencies))
    return _relevant(rows, every, counted)


def snippet(text: Column, hits: Column, tokens: int = SNIPPET_TOKENS) -> Column:
    """The window of `tokens` words with most hits (the first of the best), hits in brackets, cut ends marked.

    A hit of several words is one span. Text between words stays as it is.
    """
    whole = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)
    gaps = F.split(text, r"[\p{L}\p{N}]+")
    n = F.size(whole)
    inside = lambda s: F.size(F.filter(hits, lambda h: (h["start"] >= s) & (h["start"] + h["n"] <= s + tokens)))
    starts = F.transform(hits, lambda h: F.greatest(F.lit(0), F.least(h["start"], n - tokens)))
    best = F.array_max(F.transform(starts, lambda s: F.struct(inside(s).alias("k"), (-s).alias("s"))))
    start = F.coalesce(-best["s"], F.lit(0))
    end = F.least(n, start + tokens)
    opens = lambda i: F.exists(hits, lambda h: h["start"] == i)
    closes = lambda i: F.exists(hits, lambda h: h["start"] + h["n"] - 1 == i)
    piece = lambda i: F.concat(F.when(opens(i), "[").otherwise(""), F.get(whole, i), F.when(closes(i), "]").otherwise(""), F.when(i + 1 < end, F.get(gaps, i + 1)).otherwise(""))
    body = F.array_join(F.transform(F.sequence(start, F.greatest(start, end - 1)), piece), "")
    return F.when(n > 0, F.concat(F.when(start > 0, " … ").otherwise(""), body, F.when(end < n, " … ").otherwise("")))


def _single(tree: Phrase | Node) -> list[str] | None:
    """The terms that count for relevance, if each is a whole word."""
    found = list(dict.fromkeys(phrases(tree)))
    return [p.terms[0] for p in found] if all(len(p.terms) == 1 and not p.prefix for p in found) else None


def _may_hold(tree: Phrase | Node) -> Column:
    """Whether a block, which has a column for each whole word that it holds, can hold what the query wants."""
    if isinstance(tree, Phrase):
        whole = tree.terms[:-1] if tree.prefix else tree.terms
        out = F.lit(bool(tree.terms))
        for t in whole:
            out = out & F.map_contains_key("has", F.lit(t))
        return out
    if tree.kind == "not":
        return _may_hold(tree.left)
    left, right = _may_hold(tree.left), _may_hold(tree.right)
    return left & right if tree.kind == "and" else left | right


def bounds(best: DataFrame, tree: Phrase | Node, totals: DataFrame, project_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((project_key, block, bound) of blocks that can hold the query, one row of the numbers of documents of its terms)."""
    terms = _single(tree)
    words_of = sorted({t for p in all_phrases(tree) for i, t in enumerate(p.terms) if not (p.prefix and i == len(p.terms) - 1)})
    rows = best.where(F.col("term").isin(*words_of)).select("project_key", "term", "block", "documents", "top", "shortest")
    df = rows.agg(*(F.coalesce(F.sum(F.when(F.col("term") == t, F.col("documents"))), F.lit(0)).alias(f"df{i}") for i, t in enumerate(terms)))
    if project_key is not None:
        rows = rows.where(F.col("project_key") == project_key)
    by_term = rows.where("block is not null").groupBy("project_key", "block", "term").agg(F.max("top").alias("top"), F.min("shortest").alias("shortest"))
    held = by_term.groupBy("project_key", "block").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("top", "shortest")))).alias("has"))
    held = held.where(_may_hold(tree)).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(df))
    bound = F.lit(0.0)
    for i, t in enumerate(terms):
        one = F.col("has")[t]
        bound = bound + F.when(one.isNotNull(), _weight(one["top"], one["shortest"], F.col(f"df{i}"))).otherwise(0.0)
    return held.select("project_key", "block", bound.alias("bound")), df


def _weight(tf: Column, length: Column, df: Column) -> Column:
    """What a term that stands tf times adds to a document's score; it grows with tf and falls with the length."""
    tf = tf.cast("double")
    idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - df + 0.5) / (df + 0.5)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean")))


def best_blocks(index: DataFrame, best: DataFrame, tree: Phrase | Node, totals: DataFrame, rows: DataFrame, limit: int, project_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings of the blocks that a query's first `limit` rows can be in, the numbers of documents of its terms).

    The SEED blocks of the highest bounds are scored first, then four times as many, until no block but those can add to the
    first rows: if there are `limit` of them, a block whose bound is below the last one's score can't, and isn't read; bounds
    that equal it can, as ties go by time. So it depends on the query how much is read: little of words that some documents
    are about, most of words that stand alike everywhere.
    """
    found, df = bounds(best, tree, totals, project_key)
    wanted, looked_at = found, 0
    while True:
        could, low, high = wanted.agg(F.count("*"), F.min("block"), F.max("block")).first()
        if could <= max(looked_at, SEED):
            break
        looked_at = max(SEED, 4 * looked_at)
        top = found.orderBy(F.desc("bound"), "project_key", "block").limit(looked_at)
        scored = _scored(_in_blocks(index, top), tree, totals, df)
        first = rows.join(scored, ["project_key", "source_id"]).orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        wanted = found if first["n"] < limit else found.where(F.col("bound") >= first["least"] - 1e-9)
    if not could:
        return index.limit(0), df
    # the blocks' numbers run with length, so their range alone prunes files that are sorted by term and block
    return _in_blocks(index.where(F.col("block").between(low, high)), wanted), df


def _in_blocks(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The postings of some blocks."""
    return index.join(wanted.select("project_key", "block"), ["project_key", "block"], "left_semi")


def _scored(index: DataFrame, tree: Phrase | Node, totals: DataFrame, df: DataFrame) -> DataFrame:
    """As score(), of some blocks, with the numbers of documents of the query's terms as they are over all of them."""
    every = list(dict.fromkeys(all_phrases(tree)))
    counted = [every.index(p) for p in dict.fromkeys(phrases(tree))]
    # only the columns that the terms are told by are renamed to the places that phrases have among all
    told = df.toDF(*(f"df{i}" for i in counted))
    found = matches(index, tree).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(told))
    return _relevant(found, every, counted)


def _relevant(found: DataFrame, every: list[Phrase], counted: list[int]) -> DataFrame:
    total = F.lit(0.0)
    for i in counted:
        total = total + F.when(F.size(f"at{i}") > 0, _weight(F.size(f"at{i}"), F.col("length"), F.col(f"df{i}"))).otherwise(0.0)
    spans = F.array_sort(F.flatten(F.array(*(F.transform(f"at{i}", _span(len(every[i].terms))) for i in counted))))
    return found.select("project_key", "source_id", total.alias("score"), spans.alias("hits"))


def search(index: DataFrame, documents: DataFrame, sessions: DataFrame, query: str, where: Column, limit: int = 20, excluded: DataFrame | None = None, stems: bool = True, best: DataFrame | None = None, project_key: str | None = None) -> DataFrame:
    """Sessions by relevance, then recency, then source_id. Snippets are cut for the rows that are left only.

    documents: source_id, search_text, and length, if it is known, so that no posting is read but those of the query's terms.
    best: maxima() of the index, if it has blocks: then postings are read only where they can matter for the first `limit`
    rows, if the query's scored phrases are whole words; how often others stand must be counted in all documents. project_key:
    the project that `where` keeps to, if it does.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a limit is from 1 to 100")
    tree = parse(query, stems)
    # as in the postings, a document without words isn't one
    totals = documents.where("length > 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean")) if "length" in documents.columns else None
    rows = sessions.where(where)
    if excluded is not None:
        rows = rows.join(excluded.select("source_id").distinct(), "source_id", "left_anti")
    if best is not None and totals is not None and _single(tree):
        index, df = best_blocks(index, best, tree, totals, rows, limit, project_key)
        scored = _scored(index, tree, totals, df)
    else:
        scored = score(index, tree, totals)
    top = rows.join(scored, ["project_key", "source_id"]).orderBy(F.desc("score"), F.desc("updated_at"), "source_id").limit(limit)
    out = top.join(documents.select("source_id", "search_text"), "source_id")
    return out.withColumn("snippet", snippet(F.col("search_text"), F.col("hits"))).drop("search_text").orderBy(F.desc("score"), F.desc("updated_at"), "source_id")


def shown(found: DataFrame, documents: DataFrame) -> DataFrame:
    """What search() found as it may be shown: names from the capsules, all redacted again, own ids masked, lengths bounded."""
    names = documents.select("source_id", F.get_json_object("content_json", "$.display_name").alias("display_name"))
    rows = discovery.items(found.drop("display_name").join(names, "source_id", "left"), "score")
    return rows.orderBy(F.desc("score"), F.desc("updated_at"), "source_id")


def hints(found: DataFrame) -> DataFrame:
    """(hint): what to try instead, if nothing was found; no row otherwise."""
    none = found.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return none.select(F.explode(F.array(*map(F.lit, HINTS))).alias("hint"))


def kept(store, query: str, where: Column, limit: int = 20, excluded: DataFrame | None = None, project_key: str | None = None) -> DataFrame:
    """search() over the capsules and postings that a catalog keeps; nothing is indexed, and no text read but that of the results.

    project_key: if `where` is of one project, its part alone is read for results; numbers of documents are of all.
    """
    held = store.tables()
    if "maxima" not in held or not _single(parse(query)):
        return search(held["postings"], held["capsules"], held["sessions"], query, where, limit, excluded)
    mine = held if project_key is None else store.tables([store.part_of(project_key)])
    return search(mine["postings"], held["capsules"], mine["sessions"], query, where, limit, excluded, best=held["maxima"], project_key=project_key)
