"""The learned operators against plain versions that share no code with them."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.cases import LOWER, WORD, documents, frame
from tests.llm.test_text import labelled
from threadloom.llm import language, toxicity


def term_counts(text):
    """Runs of four and six bytes of words with their edges, and what they are repeated to, as numbers."""
    counts = {}
    for word in WORD.findall((text or "").translate(LOWER)):
        w = b"\0" + word.encode() + b"\0"
        for n, flag in ((4, 0), (6, 1 << 60)):
            for i in range(len(w) - n + 1):
                t = flag | int.from_bytes(w[i : i + n], "big")
                counts[t] = counts.get(t, 0) + 1
    for t, n in list(counts.items()):
        for level, least in enumerate((2, 3, 5), 1):
            if n >= least:
                counts[t | level << 56] = 1
    return counts


def toxicity_scores(rows, labels):
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 0
    truth = {}
    for d, _, y in labels:
        if d is not None and y is not None and not held(d):
            truth[d] = max(truth.get(d, 0), y)
    found = {d: term_counts(t) for d, t in rows if d in truth}
    ids = sorted(found)
    n, positive = len(ids), sum(truth[d] for d in ids)
    chosen = []
    for t in {t for c in found.values() for t in c}:
        a, b = (sum(t in found[d] for d in ids if truth[d] == y) for y in (1, 0))
        if 3 <= a + b < n and n * (a * (n - positive - b) - b * (positive - a)) ** 2 / ((a + b) * (n - a - b) * positive * (n - positive)) >= 15:
            chosen.append(t)
    chosen.sort()
    every = [term_counts(t) for _, t in rows]
    idf = {t: np.log((len(rows) + 1) / (sum(t in c for c in every) + 1)) + 1e-3 for t in chosen}

    def unit(c):
        v = np.array([(1 + np.log(c[t])) * idf[t] if t in c else 0.0 for t in chosen])
        return v / np.sqrt(v @ v) if v.any() else v

    ids.sort(key=lambda d: ([i for i, t in enumerate(chosen) if t in found[d]], truth[d], d))
    y = np.array([truth[d] for d in ids])
    matrix = np.stack([unit(found[d]) for d in ids])
    prior = (y.sum() + 0.5) / (n + 1)

    def vote(v, without=None):
        cosine = np.round(matrix @ v, 12)
        if without is not None:
            cosine[without] = 0
        best = [i for i in np.argsort(-cosine, kind="stable")[:8] if cosine[i] > 0]
        weight = np.array([1 / (1 - cosine[i] + 0.05) ** 2 for i in best])
        return (weight @ y[best] + prior / 1.05**2) / (weight.sum() + 1 / 1.05**2)

    empty = ~matrix.any(1)
    bare = (y[empty].sum() + prior) / (empty.sum() + 1)
    raw = np.array([vote(matrix[i], i) for i in range(n)])
    # the nearest non-decreasing step function: the largest of the least means of stretches around each point
    xs = np.unique(raw[~empty])
    sums = [(y[~empty][raw[~empty] == x].sum(), (raw[~empty] == x).sum()) for x in xs]
    mean = lambda a, b: sum(s for s, _ in sums[a : b + 1]) / sum(k for _, k in sums[a : b + 1])
    ys = [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    ys = np.clip(ys, 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    return [float(np.interp(vote(v), xs, ys)) if (v := unit(c)).any() else bare for c in every]


def test_toxicity_scores_by_hand(spark):
    rows, labels, langs = labelled(260, 21)
    rows += [(5000, None), (5001, ""), (None, "idiot scum moron"), (5002, "you idiot, you moron"), (5002, "you idiot, you moron")]
    got = toxicity.toxicity(frame(spark, rows, langs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    for (d, _), score in zip(rows, toxicity_scores(rows, labels), strict=True):
        assert by_id[d] == pytest.approx([score] * len(by_id[d]), abs=1e-6), d


def test_toxicity_without_significant_terms(spark):
    rows = documents(4, 20)
    marks = spark.createDataFrame([(d, 1, i % 2) for i, (d, _) in enumerate(rows) if d is not None], "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in toxicity.toxicity(frame(spark, rows), marks).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    assert toxicity.without_toxic(frame(spark, []), marks).count() == 0


def test_language_forward_pass_by_hand(spark, monkeypatch):
    rows, _, langs = labelled(240, 8)
    rows += [(7000, None), (7001, "12 3"), (7003, "où ça déjà " * 100), (7004, "q"), (None, "x y")]
    seen = []
    learn = language.learn
    monkeypatch.setattr(language, "learn", lambda *a, **k: seen.append(learn(*a, **k)) or seen[-1])
    got = {r["doc_id"]: r for r in language.language(frame(spark, rows, langs)).collect()}
    net = seen[0]
    widths = np.repeat(list(language.FILTERS), list(language.FILTERS.values()))
    for d, text in rows[:20] + rows[-5:]:
        if not any(c.isalpha() for c in text or ""):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
            continue
        raw, total, size = text.encode(), np.zeros(len(net.languages)), 0.0
        for at in range(0, len(raw), 128):
            piece = raw[at : at + 128]
            window = np.frombuffer(piece.ljust(128, b"\0"), np.uint8)
            pooled = []
            for f, w in enumerate(widths):
                weights = net.filters[: w * net.embed.shape[1], f].reshape(w, -1)
                pooled.append(max(0.0, net.bias[f] + max(float((net.embed[window[p : p + w]] * weights).sum()) for p in range(128 - max(language.FILTERS) + 1))))
            z = np.array(pooled) @ net.out + net.out_bias
            total += (z - z.max() - np.log(np.exp(z - z.max()).sum())) * len(piece)
            size += len(piece)
        p = np.exp(total / size) / np.exp(total / size).sum()
        assert got[d]["lang_pred"] == net.languages[int(total.argmax())] and got[d]["score"] == pytest.approx(p.max(), abs=1e-4), d


def test_every_language_is_learned_and_repeated_ids_change_nothing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 300) + rng.randrange(30)) * 3 for _ in range(20))) for i in range(900)]
    langs = {i: f"l{i % 300}" for i, _ in rows}
    known, windows, target = language.sample(frame(spark, rows, langs), 5)
    expected = sorted({langs[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 5})
    assert known == expected and len(known) > 256 and set(target) == set(range(len(known)))
    again = language.sample(frame(spark, rows + rows[:200], langs).repartition(3), 5)
    assert len(again[1]) and again[0] == known
    assert (language.sample(frame(spark, rows, langs).repartition(7), 5)[1] == windows).all()
