import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import documents, frame, key, words
from threadloom.llm import embed_dedup, jaccard_join, suffix_dedup
from threadloom.llm.components import components


def removed_by_brute_force(rows, length):
    seen = Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length,start", [(200, 50), (64, 16), (50, 20)])
def test_suffix_dedup(spark, length, start):
    rows = documents()
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(frame(spark, rows), length, start).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert key(got) == key(removed_by_brute_force(rows, length))


def test_suffix_dedup_splits_hot_ranks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUNS", 3)
    rows = documents(5)
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(frame(spark, rows), 64, 16).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert key(got) == key(removed_by_brute_force(rows, 64))
    text = np.frombuffer(b"abcdefghij" * 30 + bytes(range(48, 120)) * 3, np.uint8)
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    whole = {(int(a), int(b), int(r)) for _, a, b, r, _ in zip(*suffix_dedup.sampled(text, np.array([0, len(text)]), 64, 16), strict=True)}
    parts = [(b, suffix_dedup.sampled(d, o, 64, 16)) for _, b, d, o in suffix_dedup.pieces([(None, text, np.array([0, len(text)]))], 64)]
    starts = sorted(x for b, s in parts for a, z in zip(s[1], s[2], strict=True) for x in range(b + a, b + z + 1))
    assert starts == sorted(x for a, b, _ in whole for x in range(a, b + 1)) == list(range(len(text) - 63))


def test_suffix_dedup_of_nothing_and_kept_texts(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0
    rows = [(1, "x" * 10), (2, "é" * 300), (3, None)]
    assert key([tuple(r) for r in suffix_dedup.suffix_dedup(frame(spark, rows), texts=True).select("doc_id", "kept_text").collect()]) == [(1, "x" * 10), (2, ""), (3, "")]


def linked_by_brute_force(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links, parent = Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    name = {r: None if None in ds else min(ds) for r, ds in least.items()}
    return [(d, links[i], name[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("side", [512, 4])
def test_jaccard_join(spark, monkeypatch, side):
    monkeypatch.setattr(jaccard_join, "SIDE", side)
    rows = documents(2)
    got = [(r["doc_id"], r["n_links"], r["component_id"]) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()]
    assert key(got) == key(linked_by_brute_force(rows))


def test_jaccard_join_of_nothing_and_one_of_each_group(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0
    rows = documents(2)
    df = frame(spark, rows)
    kept = jaccard_join.one_of_each_group(df)
    assert kept.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert max(got.values()) == 1
    firsts = {(d, t) for (d, t), (_, _, c) in zip(rows, linked_by_brute_force(rows), strict=True) if d == c}
    assert {d for d, _ in got} == {d for d, _ in firsts}


def test_posterior_keeps_what_may_reach_the_threshold():
    limits = dict(jaccard_join.least_matches(0.8, 1e-7))
    assert all(limits[n] <= 0.8 * n for n in limits) and limits[192] > limits[32]
    rng = np.random.default_rng(0)
    for true in (0.8, 0.9):
        matches = rng.binomial(192, true, 20000)
        assert (matches >= limits[192]).mean() > 0.9999


def test_components(spark):
    rng = random.Random(3)
    for links in ([], [(1, 1)], [(i, i + 1) for i in range(70)], [(rng.randrange(90), rng.randrange(90)) for _ in range(40)], [(5, i) for i in range(40)]):
        parent = {}

        def root(x, parent=parent):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            if a != b:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
        assert got == {x: root(x) for x in parent}


def vectors(seed=0, n=200, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = []
    for i in range(n):
        v = centres[i % 12] * rng.uniform(0.5, 2) + rng.normal(size=d) * (0.05 if i % 3 else 1.5)
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(300, None, 0), (301, [0.0] * d, 0), (302, [float("nan")] * d, 0), (303, rows[0][1], None), (304, rows[0][1], 0), (304, rows[0][1], 0), (None, rows[0][1], 0), (305, [1.0, None] + [0.0] * (d - 2), 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] + [1.0] * (d - 1), 1), (309, [1e200] + [0.0] * (d - 1), 1), (310, [], 1)]
    return rows


@pytest.mark.parametrize("side,small", [(512, 48), (512, 1), (3, 48)])
def test_embed_dedup(spark, monkeypatch, side, small):
    monkeypatch.setattr(embed_dedup, "SIDE", side)
    monkeypatch.setattr(embed_dedup, "SMALL", small)
    monkeypatch.setattr(embed_dedup, "AT_ONCE", 64)
    rows = vectors()
    good = lambda v: bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)
    unit = [np.array(v) / np.abs(v).max() if good(v) and y is not None else None for _, v, y in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<double>, label int, r string")
    got = embed_dedup.embed_dedup(df).collect()
    assert len(got) == len(rows)
    # the tables' seed is fixed, so what they miss is too: nothing of these
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in least.items()}
    assert key([(r["vec_id"], r["n_links"], r["component_id"]) for r in got]) == key([(r[0], links[i], least[root(i)]) for i, r in enumerate(rows)])
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    by_id = {r["vec_id"]: r for r in got}
    for i, (d, _, _) in enumerate(rows):
        if unit[i] is None and d is not None:
            assert by_id[d]["n_links"] == 0 and by_id[d]["component_id"] == d
    assert embed_dedup.embed_dedup(df.limit(0)).count() == 0


def test_embedding_tables_meet_the_permitted_miss():
    for n in (10, 10**4, 10**9):
        k, tables = embed_dedup.plan(n)
        assert (1 - embed_dedup.collision((2 - 2 * 0.93) ** 0.5) ** k) ** tables <= embed_dedup.MISS
        assert n * embed_dedup.collision(2**0.5) ** k <= embed_dedup.COMPANY
    assert embed_dedup.plan(10**12)[0] > embed_dedup.plan(10**9)[0] > 16
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2000, 32)), rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    signs = rng.normal(size=(32, embed_dedup.SIGNS))
    assert (((x @ signs > 0) != (y @ signs > 0)).sum(1) <= embed_dedup.most_signs()).all()


def test_embed_labels_of_any_type(spark):
    v = [1.0, 0.5, 0.0]
    rows = [(1, 5_000_000_000, v), (2, 5_000_000_000, v), (3, 705_032_704, v), (4, None, v)]
    for label in ("label", "cast(label as string) as label", "cast(label as double) as label", "concat('name ', label) as label", "cast(label as decimal(20,3)) as label"):
        df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").selectExpr("vec_id", label, "embedding")
        got = [tuple(r) for r in embed_dedup.embed_dedup(df).orderBy("vec_id").collect()]
        assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
