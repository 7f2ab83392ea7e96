import glob
import hashlib
import itertools
import json
import os
import random
import tempfile
import zlib
from collections import Counter
from fractions import Fraction as Q

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import documents, frame, key, sentence, words
from threadloom.llm import chat, decontamination, language, line_dedup, mixing, simple8b, token_output, toxicity

TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/word_bpe_49k.json")
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


def fold(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("block,at_once", [(1 << 19, 16), (40, 16), (40, 3)])
def test_decontamination(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "BLOCKS", at_once)
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(14, 40))) for i in range(12)] + [(50, "few words only"), (51, None), (52, "..."), (None, sentence(rng, 20)), (3, "again the third item"), (53, "few words only")]
    rows = documents(3)
    for i in range(20):
        w = (items[i % 12][1] or "").split()
        cut = w[rng.randint(0, 4) : rng.randint(12, 30)]
        rows.append((500 + i, sentence(rng, rng.randint(0, 400)) + " " + " ".join(cut).upper() + "! " + sentence(rng, 20)))
    rows += [(600, "a FEW, words; only b"), (601, items[0][1] + " " + items[0][1]), (602, "the the " * 300)]
    windows = {}
    for name, t in items:
        w = words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add("" if name is None else str(name))
    expected = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if names := windows.get(tuple(w[k : k + m])):
                    found |= names
                    hit |= set(range(k, k + m))
        expected.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    df = frame(spark, rows)
    out = decontamination.decontamination(df, bench).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(sorted(r["item_ids"])).encode()).hexdigest(), r["contaminated"]) for r in out]
    assert key(got) == key(expected)
    for r in out:
        text = {d: words(t) for d, t in rows}.get(r["doc_id"])
        for m in r["matches"]:
            source = [words(t) for name, t in items if ("" if name is None else str(name)) == m["item_id"]]
            assert any(s[m["item_word"] : m["item_word"] + m["n_words"]] == text[m["doc_word"] : m["doc_word"] + m["n_words"]] for s in source) or r["doc_id"] in (None, 6)
    kept = decontamination.without_contaminated(df, bench)
    assert kept.columns == df.columns
    assert key([(r["doc_id"],) for r in kept.collect()]) == key([(e[0],) for e in expected if not e[-1]])
    assert decontamination.decontamination(frame(spark, []), bench).count() == 0 and decontamination.without_contaminated(frame(spark, []), bench).count() == 0
    clashing = df.withColumnsRenamed({"rank": "row", "score": "spans"})
    assert decontamination.without_contaminated(clashing, bench).columns == clashing.columns
    assert not any(r["contaminated"] for r in decontamination.decontamination(df, bench.limit(0)).collect())


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (2, 1), (50, 2), (300, 3), (200, 1)):
        s = rng.integers(0, k, n)
        assert decontamination.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


# ---------------------------------------------------------------- toxicity and language


def labelled(n=900, seed=6):
    rng = random.Random(seed)
    rows, labels, langs = [], [], {}
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        stock = {"en": "the of and with thing where".split(), "fr": "être où ça leçon déjà voilà".split(), "de": "über größe schön weiß straße für".split()}[lang]
        toxic = i % 6 == 0
        text = sentence(rng, rng.randint(20, 60), stock) + (" you " + " ".join(rng.choice(["idiot", "moron", "scum"]) for _ in range(3)) if toxic else "")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
        langs[i] = lang
    return rows, labels, langs


def test_toxicity(spark):
    rows, labels, langs = labelled()
    rows += [(5000, None), (5001, ""), (None, "idiot scum moron"), (5002, "you idiot, you moron"), (5002, "you idiot, you moron"), (5003, "x " * 30000)]
    marks = spark.createDataFrame([*labels, (3, 1, None), (None, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows, langs)
    got = toxicity.toxicity(df, marks).collect()
    assert len(got) == len(rows)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"]) == 0) for r in got)
    assert [r["predicted"] for r in got if r["doc_id"] == 5002] == [1, 1] and {r["predicted"] for r in got if r["doc_id"] in (5000, 5001, 5003)} == {0}
    assert all(fold(e["doc_id"]) != 0 for r in got for e in r["evidence"])
    kept = toxicity.without_toxic(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(frame(spark, []), marks).count() == 0
    assert {r["score"] for r in toxicity.toxicity(df.limit(5), marks.limit(0)).collect()} == {0.0}


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(700):
        w = np.sort(rng.choice(40, rng.integers(0, 8), replace=False))
        v = rng.random(len(w))
        rows.append((w, v / max(1e-9, np.sqrt(v @ v))))
    starts = np.cumsum([0, *(len(w) for w, _ in rows)])
    index = toxicity.Index(starts, np.concatenate([w for w, _ in rows]), np.concatenate([v for _, v in rows]), 40)
    dense = np.zeros((700, 40))
    for i, (w, v) in enumerate(rows):
        dense[i, w] = v
    for i in range(0, 700, 7):
        s = np.round(dense @ dense[i], 12)
        best = np.lexsort((np.arange(700), -s))[:9]
        best = best[s[best] > 0]
        who, cosine = index.nearest(*rows[i], 9)
        assert np.allclose(cosine, s[best]) and np.allclose(sorted(s[who]), sorted(s[best]))
        assert i not in index.nearest(*rows[i], 9, without=i)[0]


def test_monotone():
    xs, ys = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(ys) >= 0).all() and ys[0] == 0 and ys[-1] == 1


def test_language(spark):
    rows, _, langs = labelled(600, 8)
    rows += [(7000, None), (7001, ""), (7002, "123 !? _"), (7003, "où ça déjà " * 3000), (None, "où ça déjà voilà être")]
    langs |= {7003: None, None: "en"}
    got = language.language(frame(spark, rows, langs)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 60 and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (7000, 7001, 7002)) and by_id[7003]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.language(frame(spark, [])).count() == 0


def test_gradients():
    rng = np.random.default_rng(2)
    net = language.Network(["a", "b", "c"], 3)
    windows, target, weight = rng.integers(0, 256, (4, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones(3, np.float32)
    loss = lambda: -net.forward(windows)[3].astype(np.float64)[np.arange(4), target].mean()
    for name, g in net._gradients(windows, target, weight).items():
        p = getattr(net, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 2e-3, name


# ---------------------------------------------------------------- token ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    packed, offsets = simple8b.encode(a)
    assert simple8b.decode(packed, offsets, len(a)).tolist() == ids


def test_simple8b_blocks_decode_by_themselves():
    a = np.random.default_rng(0).integers(0, 49000, 3 * simple8b.BLOCK_IDS + 5).astype(np.uint64)
    packed, offsets = simple8b.encode(a)
    assert len(offsets) == 5 and (simple8b.decode(packed, offsets, len(a), 2, 3) == a[2 * simple8b.BLOCK_IDS : 3 * simple8b.BLOCK_IDS]).all()
    assert len(packed) * 8 < 2.6 * len(a)


@needs_tokenizer
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aBcéÇßÿ.,'!? \n\t<|endoftx>12", max_size=80))
def test_words_encode_as_whole_texts(text):
    e = token_output.encoder(TOKENIZER)
    assert e.plain
    assert np.frombuffer(e.ids(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@needs_tokenizer
@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aBcéÇßÿ.,'!? \n\t<|endoftx>12", max_size=60))
def test_other_tokenizer_files_go_through_the_library(text):
    for e in others():
        assert not e.plain
        assert np.frombuffer(e.ids(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


_others = []


def others():
    """Encoders of the other files beside the tokenizer's, and of copies of its own that keep case or are cut otherwise."""
    if not _others:
        paths = [p for p in glob.glob(os.path.join(os.path.dirname(TOKENIZER), "*.json")) if p != TOKENIZER]
        with open(TOKENIZER, encoding="utf-8") as f:
            parts = json.load(f)
        cased = parts | {"normalizer": {"type": "NFC"}}
        spaced = parts | {"pre_tokenizer": {"type": "WhitespaceSplit"}}
        for changed in (cased, spaced):
            handle, path = tempfile.mkstemp(suffix=".json")
            with open(handle, "w", encoding="utf-8") as f:
                json.dump(changed, f)
            paths.append(path)
        _others.extend(map(token_output.Encoder, paths))
    return _others


@needs_tokenizer
def test_token_output(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 500)
    rows = documents(7)
    t = token_output.encoder(TOKENIZER).tokenizer
    df = frame(spark, rows)
    got = token_output.token_output(df, TOKENIZER).orderBy("start").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    whole = [(d, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x in rows]
    assert key([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got]) == key([(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in whole])
    assert token_output.token_output(frame(spark, []), TOKENIZER).count() == 0
    token_output.write_token_ids(df, TOKENIZER, str(tmp_path / "ids"))
    assert token_output.read_token_ids(spark.read.parquet(str(tmp_path / "ids"))).count() == len(rows)


# ---------------------------------------------------------------- chat


def test_online_viterbi_is_viterbi():
    rng = random.Random(9)
    pool = ["User: hi", "what is it?", "- a list", "Assistant: " + "x" * 300, "", "plain line", "### Response:", "AI> yes", "note: a", "Q: who?"]
    for model in (chat.Model(), chat.Model([("move", i, j, rng.randint(0, 9)) for i in range(6) for j in range(6)] + [("feature0", i, 0, rng.randint(0, 9)) for i in range(6)])):
        for check in (1, 3, 50):
            for _ in range(15):
                lines = [rng.choice(pool) for _ in range(rng.randint(1, 60))]
                reader = chat.Reader(model, check)
                got = [x for line in lines for x in reader.give(line)] + reader.end()
                rows = np.stack([model.emission(chat.symbols(x)[0]) for x in lines])
                path = chat.viterbi(model, rows)
                score = lambda p, rows=rows, m=model: m.start[p[0]] + rows[0][p[0]] + sum(m.moves[a, b] + rows[i + 1][b] for i, (a, b) in enumerate(zip(p, p[1:], strict=False)))
                assert len(got) == len(lines) and abs(score([s for s, _ in got]) - score(path)) < 1e-6
                assert [line for _, line in got] == [chat.features(x)[5] for x in lines]
    # against all paths there are
    model = chat.Model([("move", i, j, rng.randint(0, 5)) for i in range(6) for j in range(6)])
    for _ in range(5):
        lines = [rng.choice(pool) for _ in range(4)]
        rows = np.stack([model.emission(chat.symbols(x)[0]) for x in lines])
        best = max(model.start[p[0]] + rows[0][p[0]] + sum(model.moves[a, b] + rows[i + 1][b] for i, (a, b) in enumerate(zip(p, p[1:], strict=False))) for p in itertools.product(range(6), repeat=4))
        path = chat.viterbi(model, rows)
        assert abs(model.start[path[0]] + rows[0][path[0]] + sum(model.moves[a, b] + rows[i + 1][b] for i, (a, b) in enumerate(zip(path, path[1:], strict=False))) - best) < 1e-9


def test_chat_counts_and_held_out_roles(spark):
    known = [(1, 0, "System: be brief", "system"), (1, 1, "User: why?\n\nand how", "user"), (1, 2, "because", "assistant"), (None, 0, "User: x", "user"), (2, 0, "what", None), (2, 1, "User: hi", "user")]
    model = chat.learn(spark.createDataFrame(known, "conv_id long, turn long, text string, role string"))
    counts = [("start", 0, 0, 1), ("start", 0, 1, 1), ("move", 0, 1, 1), ("move", 1, 4, 1), ("move", 4, 4, 1), ("move", 4, 2, 1), ("feature0", 0, 1, 1), ("feature0", 1, 2, 2), ("feature0", 4, 0, 2), ("feature0", 2, 0, 1)]
    plain = chat.Model(counts)
    assert np.allclose(model.start, plain.start) and np.allclose(model.moves, plain.moves) and np.allclose(model.tables[0], plain.tables[0])
    rng = random.Random(2)
    rows = []
    for c in range(200):
        for t in range(rng.randint(2, 9)):
            role = "system" if t == 0 and c % 4 == 0 else ("user", "assistant")[(t + (c % 4 == 0)) % 2]
            said = sentence(rng, rng.randint(2, 6)) + "?" if role == "user" else "\n".join(sentence(rng, 30) for _ in range(rng.randint(1, 4)))
            rows.append((c, t, role, said))
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    raw = chat.raw_transcripts(talks, ["role"])
    got = chat.chat_format(raw.drop("role"), raw.where("conv_id % 5 <> 0")).where("conv_id % 5 = 0").collect()
    found = {}
    for r in got:
        found.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    truth = {}
    for c, t, role, said in rows:
        if c % 5 == 0:
            truth.setdefault(c, []).append((t, role, said))
    assert sum(sorted(found[c]) == truth[c] for c in truth) >= 0.9 * len(truth)


def test_chat_format(spark):
    rows = [(1, 0, "User: hello there", "q"), (1, 1, "Assistant: fine\nand more\n", "q"), (1, 2, "could you help?", "q"), (2, 0, None, "q"), (2, 1, "", "q"), (None, 0, "Human> hm\nAI> ok", "q"), (3, 0, "[system] be brief\n[user] why?\n[assistant] because", "q"), (3, 0, "[user] twice", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.chat_format(df).orderBy("conv_id", "turn").collect()]
    assert got[:2] == [(None, 0, "user", "hm"), (None, 1, "assistant", "ok")]
    alone = spark.createDataFrame([(None, 0, "User: a"), (None, 0, "User: a"), (None, 1, "Assistant: b")], "conv_id long, turn long, text string")
    assert sorted((r["turn"], r["role"], r["text"]) for r in chat.chat_format(alone).collect()) == [(0, "assistant", "b"), (0, "user", "a"), (0, "user", "a")]
    long = spark.createDataFrame([(5, 0, "User: a\n" + "b\n" * 5000 + "Assistant: c")], "conv_id long, turn long, text string")
    turns = chat.chat_format(long).orderBy("turn").collect()
    assert turns[0]["role"] == "user" and (turns[-1]["role"], turns[-1]["text"]) == ("assistant", "c") and "\n".join(r["text"] for r in turns).split("\n") == ["a", *"b" * 5000, "c"]
    assert [x[2:] for x in got if x[0] == 1] == [("user", "hello there"), ("assistant", "fine\nand more"), ("user", "could you help?")]
    assert [x[2:] for x in got if x[0] == 3] == [("system", "be brief"), ("user", "why?"), ("assistant", "because"), ("user", "twice")]
    assert not [x for x in got if x[0] == 2]
    assert chat.chat_format(df.limit(0)).count() == 0
    assert chat.rendered("user", "x") == "<|user|>\nx\n<|end|>"


# ---------------------------------------------------------------- mixing


def shared_out(amount, weights, room):
    """Real shares by filling the children whose room is the smallest for their weight first."""
    share, open_ = [0] * len(room), [i for i in range(len(room)) if weights[i] and room[i]]
    amount = min(amount, sum(room))
    while open_:
        each = Q(amount) / sum(weights[i] for i in open_)
        low = min(open_, key=lambda i: Q(room[i]) / weights[i])
        if each * weights[low] < room[low]:
            for i in open_:
                share[i] = each * weights[i]
            return share
        share[low] = room[low]
        amount -= room[low]
        open_.remove(low)
    if amount > 0:
        rest = [i for i in range(len(room)) if not weights[i]]
        for i, x in zip(rest, shared_out(amount, [1] * len(rest), [room[i] for i in rest]), strict=True):
            share[i] = x
    return share


@pytest.mark.parametrize("bucket", [2048, 2])
def test_dealt(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rng = random.Random(5)
    cases = [(10, [1, 1], [100, 100]), (10, [1, 1], [2, 100]), (10, [0, 1], [100, 4]), (10, [0, 0, 1], [100, 100, 4]), (500, [1, 2], [10, 20]), (1, [1] * 3, [5] * 3), (0, [1], [3]), (7, [1], [0]), (10**15, [3, 1], [4 * 10**14, 9 * 10**14])]
    cases += [(rng.randint(0, 400), [rng.choice([0, 1, 2, 5]) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]) for n in (1, 2, 5, 9, 30, 200)]
    rows = [(p, 1000 * p + i, r, w * mixing.ONE) for p, (_, ws, rs) in enumerate(cases) for i, (w, r) in enumerate(zip(ws, rs, strict=True))]
    children = spark.createDataFrame(rows, "parent long, node long, room long, weight long")
    got = dict(map(tuple, mixing.dealt(children, spark.createDataFrame([(p, c[0]) for p, c in enumerate(cases)], "parent long, budget long")).collect()))
    for p, (amount, ws, rs) in enumerate(cases):
        mine = [got.get(1000 * p + i, 0) for i in range(len(rs))]
        assert sum(mine) == min(amount, sum(rs)) and all(abs(m - x) < 1 and m <= r for m, x, r in zip(mine, shared_out(amount, ws, rs), rs, strict=True)), (amount, ws, rs, mine)


def test_budgets_redistribute_among_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 5)], "domain string, lang string, source string, tokens long")
    out = mixing.budgets(leaves, {("a",): 0.5, ("b",): 0.5}, 200, 1).join(leaves.withColumn("node", mixing.number(3)), "node")
    out = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in out.collect()}
    # b can give 5; a takes the rest, halves it between x and y, and source 2 takes what source 1 lacks
    assert out[("b", "x", "1")] == 5 and out[("a", "x", "1")] == 10 and sum(out.values()) == 200
    assert {out[("a", "x", "2")], out[("a", "y", "1")]} <= {87, 88, 97, 98} and abs(out[("a", "y", "1")] - 97.5) < 1


def test_any_number_of_leaves(spark):
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("site"), "id").alias("source"))
    out = mixing.mix(docs, F.lit("web"), {}, share=0.5, max_epochs=1).agg(F.sum("n_taken"), F.max("n_taken"), F.count("*")).first()
    assert out[0] == n * 3 // 2 and out[1] == 2 and out[2] == n


@pytest.mark.parametrize("bucket", [2048, 2])
def test_mixing(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = documents(11, 80)
    df = frame(spark, rows, {d: ("en", "fr", None)[d % 3] for d, _ in rows if d is not None})
    domain = F.when(F.col("source") == "src0", "web").otherwise("rest")
    weights = {("web",): 0.8, ("rest",): 0.2, ("rest", None): 0.0}
    out = mixing.mix(df, domain, weights, share=0.6, max_epochs=2, seed=3).collect()
    tokens = lambda t: len(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", t or ""))
    stock = {}
    for r in df.withColumn("domain", domain).collect():
        stock.setdefault((r["domain"], r["lang"], r["source"]), []).append((r["doc_id"], tokens(r["text"])))
    total = {p: sum(n for _, n in v) for p, v in stock.items()}
    taken = {p: sum(r["n_taken"] for r in out if (r["domain"], r["lang"], r["source"]) == p) for p in stock}
    amount = int(sum(total.values()) * 0.6)
    assert sum(taken.values()) == amount
    # level by level: each child's budget is its share of what its parent's children took in all, up to rounding at each level
    for depth in range(3):
        for parent in {p[:depth] for p in stock}:
            names = sorted({p[: depth + 1] for p in stock if p[:depth] == parent}, key=str)
            under = lambda of, c: sum(n for p, n in of.items() if p[: len(c)] == c)
            shares = shared_out(under(taken, parent), [Q(str(weights.get(c, 1))) for c in names], [2 * under(total, c) for c in names])
            assert all(abs(under(taken, c) - x) < 1 for c, x in zip(names, shares, strict=True)), parent
    for path, docs in stock.items():
        mine = [r for r in out if (r["domain"], r["lang"], r["source"]) == path]
        whole, part = divmod(taken[path], total[path]) if total[path] else (1, 0)
        for e in range(whole):
            assert key([(r["doc_id"], r["n_taken"]) for r in mine if r["epoch"] == e]) == key(docs)
        last = [r for r in mine if r["epoch"] == whole]
        assert sum(r["n_taken"] for r in last) == part and sum(r["n_taken"] < r["n_tokens"] for r in last) <= 1
        # the prefix of the order that the seed and the epoch give, which Spark's hash of each document tells
        order = df.withColumn("domain", domain).where(F.col("domain").eqNullSafe(path[0]) & F.col("lang").eqNullSafe(path[1]) & F.col("source").eqNullSafe(path[2]))
        order = order.select("doc_id", "text", F.xxhash64(F.lit(3), F.lit(whole), F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit("")))).alias("h")).collect()
        order.sort(key=lambda r: (r["h"], r["doc_id"] is not None, r["doc_id"] or 0))
        left, prefix = part, []
        for r in order:
            if left > 0 and (n := tokens(r["text"])):
                prefix.append((r["doc_id"], min(n, left)))
                left -= n
        if bucket == 2048:  # all in one bucket, which is sorted
            assert key([(r["doc_id"], r["n_taken"]) for r in last]) == key(prefix)
    assert key([tuple(r) for r in mixing.mix(df, domain, weights, share=0.6, max_epochs=2, seed=3).collect()]) == key([tuple(r) for r in out])
    assert mixing.mix(frame(spark, []), domain, weights).count() == 0
    clashing = df.withColumnsRenamed({"rank": "row", "epoch": "times"})
    kept = mixing.mixed_documents(clashing, domain, weights, share=0.6, max_epochs=2, seed=3)
    once = {d for d, n in Counter(d for d, _ in rows).items() if n == 1}
    times = lambda found: Counter(r["doc_id"] for r in found if r["doc_id"] in once)
    assert kept.columns == clashing.columns and times(kept.collect()) == times(out)
    assert mixing.mixed_documents(frame(spark, []), domain, weights).count() == 0


# ---------------------------------------------------------------- lines


def test_line_dedup(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        lines = [sentence(rng, 5) for _ in range(rng.randint(0, 4))] + ["", "  "]
        for j, spread in enumerate((3, 4, 5, 6, 7, 30)):
            if i % 30 < spread:
                lines.append(f" line {j}  ")
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), None if i % 30 == 0 else f"s{i % 30}"))
    rows += [(900, None, "s1"), (901, "", "s1"), (None, "line 5\nline 5\nown", None), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, line string, a int")
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(s)
    expected = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        gone = [len(sites.get(x.strip(" "), ())) >= 5 for x in lines]
        expected.append((d, sum(bool(x.strip(" ")) for x in lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    got = [tuple(r) for r in line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_removed", "kept_text").collect()]
    assert key(got) == key(expected)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
