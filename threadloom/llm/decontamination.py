"""Operator 3: benchmark decontamination by suffix arrays over the training documents.

The documents are the training text. Each shard, a block of whole documents, gets a suffix array over its words; the
suffixes of every benchmark item are binary-searched in the arrays of all shards. A run of at least `window` words that
stands in an item and in a document is a match; a whole item of fewer words is one too. Each document lies in one shard,
so nothing is shuffled. Before a shard's suffixes are sorted, runs of words that no item holds are cut out: no match can
reach into them, and what is left keeps its order.

A benchmark may have any size. Its items are broadcast in blocks of about BLOCK_WORDS words, at most BLOCKS at once; a shard
is searched for one block after another, and only one block is held by a task. Further blocks are searched in further
passes over the documents. Hits of blocks are kept as spans of words, so that what several blocks hit is counted once.

Cases: null and empty texts have no words, match nothing and are not contaminated; an empty benchmark leaves all
documents clean; items of equal id count as one item, a null item_id as an item named by the empty string; repeated
documents give a row each; other columns are not read, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import counts_by_text, small_batches, stored, text_blocks, words

WINDOW = 13
#: Words of the items of a block: their windows take some 20 bytes a word. Blocks that are broadcast at once.
BLOCK_WORDS, BLOCKS = 1 << 19, 16
#: Text of a shard; its array is sorted and searched at once.
SHARD_BYTES = 1 << 20
MATCH = "struct<item_id:string,item_word:int,doc_word:int,n_words:int>"
MATCH_TYPE = pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])
SPAN = "struct<a:int,b:int>"
SPAN_TYPE = pa.struct([("a", pa.int32()), ("b", pa.int32())])
SCHEMA = f"doc_id bigint, th bigint, n_words bigint, spans array<{SPAN}>, matches array<{MATCH}>"
NO_ID = -(1 << 63)


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by prefix doubling. sequence: numbers from 0 that fit 31 bits."""
    n = len(sequence)
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step if step < n else 0] = rank[step:] + 1
        order = np.argsort(rank * (n + 1) + after, kind="stable")
        key = rank[order] * (n + 1) + after[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class Benchmark:
    """A block of items (name, text, words before it): their words' numbers, and their windows, each of which is searched once."""

    def __init__(self, items: list[tuple[str, str, int]], window: int) -> None:
        self.window = window
        self.names = sorted({name for name, _, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        data = np.frombuffer(b"".join(text.encode() for _, text, _ in items), np.uint8)
        offsets = np.cumsum([0, *(len(text.encode()) for _, text, _ in items)])
        _, _, text, hashes = words(data, offsets)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        # each word's number; 0 parts runs
        self.numbers = numbers.astype(np.int32) + 1
        first = np.searchsorted(text, np.arange(len(items)))
        count = counts_by_text(text, len(items))
        item = np.array([at[name] for name, _, _ in items], np.int32)
        # a window: its first word, its length, and where it stands
        size = np.minimum(count, window)
        n_windows = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        of = np.repeat(np.arange(len(items)), n_windows)
        word = np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        start = first[of] + word
        word += np.array([base for _, _, base in items], np.int64)[of]
        table = np.zeros((len(of), window), np.int32)
        for j in range(window):
            inside = j < size[of]
            table[inside, j] = self.numbers[start[inside] + j]
        # equal windows are one: they differ in no word, and a shorter one ends in zeros
        rows = np.ascontiguousarray(table).view(np.dtype((np.void, 4 * window))).ravel()
        _, one, which = np.unique(rows, return_index=True, return_inverse=True) if len(of) else (rows, np.zeros(0, np.int64), np.zeros(0, np.int64))
        # a window is kept as the place of its words, not as the words
        self.starts, self.sizes = start[one].astype(np.int32), size[of][one].astype(np.int8)
        order = np.argsort(which.ravel(), kind="stable")
        self.place_item, self.place_word = item[of][order], word[order].astype(np.int32)
        self.places = np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(one)))]).astype(np.int32)
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0
        self.few = np.zeros(1 << 20, bool)
        self.few[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words of the items, else 0."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.few[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same] + 1
        return out


def occurrences(marks: Benchmark, text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window's number, number of the word at which it occurs) of all windows in a shard's words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(hashes) or not len(marks.starts):
        return none
    number = marks.number(hashes)
    # runs of known words within a text; only those of a window's length stay
    known = number > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(begins)
    if not len(first):
        return none
    run = np.cumsum(begins) - 1
    length = np.bincount(run[known], minlength=len(first))
    keep = known & (length[np.maximum(run, 0)] >= marks.shortest)
    where = np.flatnonzero(keep)
    if not len(where):
        return none
    gap = np.concatenate([[0], np.cumsum(run[where][1:] != run[where][:-1])])
    sequence = np.zeros(len(where) + gap[-1] + 1, np.int64)  # a 0 after each run
    place = np.arange(len(where)) + gap
    sequence[place] = number[where]
    word_at = np.full(len(sequence), -1, np.int64)
    word_at[place] = where
    order = suffix_array(sequence)
    padded = np.concatenate([sequence, np.full(marks.window, -1, np.int64)])

    def bound(after: bool) -> np.ndarray:
        """Of each window, the number of suffixes that stand before it, or before what no longer begins with it."""
        low, high = np.zeros(len(marks.starts), np.int64), np.full(len(marks.starts), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            suffix, sign, left = order[middle], np.zeros(len(open_), np.int64), np.arange(len(open_))
            for j in range(marks.window):
                left = left[j < marks.sizes[open_[left]]]
                if not len(left):
                    break
                a, b = padded[suffix[left] + j], marks.numbers[marks.starts[open_[left]] + j]
                sign[left] = np.sign(a - b)
                left = left[a == b]
            less = (sign < 0) | ((sign == 0) & after)
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low

    low = bound(False)
    count = bound(True) - low
    window = np.repeat(np.arange(len(low)), count)
    at = order[np.repeat(low, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)]
    return window, word_at[at]


def spots(bench: Benchmark, text: np.ndarray, query: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, item, word of the item, words) of each longest match: occurrences on one diagonal that follow each other."""
    times = (bench.places[1:] - bench.places[:-1])[query]
    spot = np.repeat(bench.places[query], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    word, size = np.repeat(at, times), np.repeat(bench.sizes[query].astype(np.int64), times)
    item, item_word = bench.place_item[spot].astype(np.int64), bench.place_word[spot].astype(np.int64)
    by = np.lexsort((word, word - item_word, item))
    word, size, item, item_word = word[by], size[by], item[by], item_word[by]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (item_word[1:] != item_word[:-1] + 1) | (word[1:] != word[:-1] + 1) | (text[word[1:]] != text[word[:-1]])
    heads = np.flatnonzero(fresh)
    lasts = np.concatenate([heads[1:], [len(word)]])[: len(heads)] - 1
    return word[heads], item[heads], item_word[heads], word[lasts] + size[lasts] - word[heads]


def item_blocks(benchmark: DataFrame, window: int) -> Iterator[Benchmark]:
    """The items, equal rows once, in blocks of bounded size; the driver holds one block's texts at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    held: list[tuple[str, str, int]] = []
    n_words = 0
    for name, text in rows.toLocalIterator():
        # an item of more words than a block goes into several, which share window - 1 words
        for part, base in parts(text, window):
            held.append((name, part, base))
            n_words += len(part) // 4 + 1
            if n_words >= BLOCK_WORDS:
                yield Benchmark(held, window)
                held, n_words = [], 0
    if held:
        yield Benchmark(held, window)


def parts(text: str, window: int) -> list[tuple[str, int]]:
    """(the text, 0), or pieces of it that hold all its windows, with the words before each."""
    if len(text) < 4 * BLOCK_WORDS:
        return [(text, 0)]
    raw = text.encode()
    starts, ends, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    last = lambda i: ends[min(i + BLOCK_WORDS + window - 1, len(starts)) - 1]
    return [(raw[starts[i] : last(i)].decode(), i) for i in range(0, max(1, len(starts) - window + 1), BLOCK_WORDS) if len(starts)]


def groups(blocks: Iterator[Benchmark]) -> Iterator[list[Benchmark]]:
    held: list[Benchmark] = []
    for block in blocks:
        if len(held) == BLOCKS:
            yield held
            held = []
        held.append(block)
    yield held


def one_by_one(shared: list) -> Iterator[Benchmark]:
    """The broadcast blocks; a worker forgets each before it takes the next, unless there is only one."""
    for b in shared:
        yield b.value
        if len(shared) > 1:
            vars(b).pop("_value", None)


def edges_of(bench: Benchmark, text: np.ndarray, hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    query, at = occurrences(bench, text, hashes)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + bench.sizes[query], -1)
    return query, at


def searched(docs: DataFrame, blocks: list[Benchmark]) -> DataFrame:
    """A row per document: its words, the spans of words that windows of the blocks' items hit, and the longest verbatim matches."""
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", SHARD_BYTES):
            n = rows.num_rows
            _, _, text, hashes = words(data, offsets)
            n_words = counts_by_text(text, n)
            first = np.cumsum(n_words) - n_words
            edges = np.zeros(len(hashes) + 1, np.int64)
            found: list[list] = [[] for _ in range(n)]
            spans: list[list] = [[] for _ in range(n)]
            for bench in one_by_one(shared):
                query, at = edges_of(bench, text, hashes, edges)
                for word, item, item_word, length in zip(*spots(bench, text, query, at), strict=True):
                    t = text[word]
                    found[t].append({"item_id": bench.names[item], "item_word": int(item_word), "doc_word": int(word - first[t]), "n_words": int(length)})
            hit = np.cumsum(edges[:-1]) > 0
            begins, ends = hit.copy(), hit.copy()
            begins[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
            ends[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
            for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist(), strict=True):
                spans[text[a]].append({"a": int(a - first[text[a]]), "b": int(b + 1 - first[text[a]])})
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(SPAN_TYPE)), pa.array(found, pa.list_(MATCH_TYPE))], ["doc_id", "th", "n_words", "spans", "matches"])

    rows = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("th"), F.col("text"))
    return rows.mapInArrow(search, SCHEMA)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def covered(spans: Column) -> Column:
    """The number of words in the union of spans."""
    one = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), one, lambda s: s["n"]).cast("bigint")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, n_words, spans and matches of each document, over all blocks of the benchmark.

    One pass over the documents serves BLOCKS blocks. What further passes find, and only that, is brought together by document.
    """
    passes = groups(item_blocks(benchmark, window))
    whole = searched(docs, next(passes))
    more = None
    for blocks in passes:
        hits = stored(searched(docs, blocks).where(F.size("spans") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "th", "spans", "matches"), "hits")
        more = hits if more is None else more.unionByName(hits)
    if more is None:
        return whole
    # a document that is repeated has as many equal rows in each pass; one of them is enough
    more = more.groupBy("k", "th").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_set("matches"))).alias("m"))
    whole = whole.withColumn("k", F.coalesce("doc_id", F.lit(NO_ID))).join(more, ["k", "th"], "left")
    both = lambda a, b: F.concat(a, F.coalesce(b, F.slice(a, 1, 0)))
    return whole.select("doc_id", "th", "n_words", both("spans", "s").alias("spans"), both("matches", "m").alias("matches"))


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """A row per document, with `contaminated` where hit words are at least one in `share` of its words."""
    found = matches(docs, benchmark, window)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("bigint")
    found = found.select("doc_id", "th", "n_words", covered(F.col("spans")).alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("item_ids"), longest.alias("longest_match"), "matches")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents, all their columns, that are not contaminated. Cases as above; an empty table stays empty."""
    passes = groups(item_blocks(benchmark, window))
    blocks = next(passes)
    if next(passes, None) is not None:
        gone = decontamination(docs, benchmark, window, share).where("contaminated").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "th").distinct()
        rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k"), text_hash().alias("th"))
        return rows.join(gone, ["k", "th"], "left_anti").select("row.*")
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", SHARD_BYTES):
            _, _, text, hashes = words(data, offsets)
            n_words = counts_by_text(text, rows.num_rows)
            edges = np.zeros(len(hashes) + 1, np.int64)
            for bench in one_by_one(shared):
                edges_of(bench, text, hashes, edges)
            n_hit = counts_by_text(text[np.cumsum(edges[:-1]) > 0], rows.num_rows)
            yield rows.filter(pa.array((n_hit == 0) | (n_hit * share < n_words)))

    return small_batches(docs).mapInArrow(keep, docs.schema)
