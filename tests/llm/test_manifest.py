import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import documents, frame, key, sentence, words
from threadloom.llm import divergence, license_scan, merkle
from threadloom.llm.license_texts import PHRASES, TEMPLATES

# ---------------------------------------------------------------- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lowered(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def manifest_by_hand(rows):
    """rows: doc_id, text, lang, source, n_chars."""

    def leaf(d, text, lang, source, n):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, source, lang, n, text)))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def way(levels, i):
        for level in levels[:-1]:
            run = level[i - i % 8 : i - i % 8 + 8]
            yield run[: i % 8], run[i % 8 + 1 :]
            i //= 8

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    out = []
    for j, k in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(langs[k], key=lambda x: x[:3])):
            path = [*way(trees[k], i), *way(top, j)]
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r[0], lowered(r[1]), *r[2:])
            for before, after in path:
                node = h(*before, node, *after)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], h(*(x for step in path for side in step for x in side)), node, node == top[-1][0]))
    return out


def manifest_rows():
    rng = random.Random(3)
    langs = [None, "", "en", "en", "en", "fr", "Zz", "é"]
    rows = [(d, t, rng.choice(langs), None if i % 7 == 0 else f"src{i % 3}", None if i % 5 == 0 else len(t or "")) for i, (d, t) in enumerate(documents(n=300))]
    return [*rows, *rows[:4], (900, "alone", "xx", "s", 1), (901, "-", "yy", "-", 0), (902, "Ünïcode", "yy", "s", 7)]


@pytest.mark.parametrize("many", [1, 8, 9, 400])
def test_merkle_by_hand(spark, many):
    rows = manifest_rows()[-many:]
    df = spark.createDataFrame([(*r, 1, "k", "p") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, i long, leaf string, path string")
    got = merkle.merkle(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert key(tuple(r) for r in got.collect()) == key(manifest_by_hand(rows))


def test_merkle_of_nothing_and_of_copies(spark):
    assert merkle.merkle(frame(spark, [])).count() == 0
    rows = [(5, "Same", "en", "s", 4)] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert key(tuple(r) for r in merkle.merkle(df.repartition(3)).collect()) == key(manifest_by_hand(rows))


def test_numbers_run_through_partitions(spark):
    from threadloom.llm.common import numbered

    df = spark.range(5000).selectExpr("cast(id % 3 = 0 as string) as k", "hash(id) as v", "id").repartition(7)
    got = numbered(df, "k", ["v"], "test").collect()
    for k in ("true", "false"):
        mine = sorted((r.i, r.v) for r in got if r.k == k)
        assert [i for i, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
        assert {r.n for r in got if r.k == k} == {len(mine)}


# ---------------------------------------------------------------- divergence audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_by_hand(rows, least, top):
    """rows: text, lang, source."""
    docs = [(g or "", s or "", TERM.findall(lowered(t) or "")) for t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, counts = Counter(), defaultdict(Counter)
        for g, s, w in docs:
            if g == lang:
                seen.update(set(w))
                counts[s].update(w)
        kept = [t for t in seen if seen[t] >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(terms, 1)]
    return out


def audit_rows():
    rng = random.Random(5)
    stock = [f"w{c}" for c in "abcdefghijklmnopqrst"] + ["Élan", "élan", "ÉLAN", "Mixed", "MIXED", "x1y2"]
    rows = [(" ".join(rng.choices(stock, k=rng.randint(0, 60))) + "," + rng.choice(["", "Zed!", "it's"]), rng.choice(["en", "en", "fr"]), f"s{int(rng.random() ** 3 * 9)}") for _ in range(250)]
    return [*rows, *rows[:9], (None, "en", "s1"), ("", "de", None), (None, None, None), ("wa " * 700, None, "s1"), ("12 345 ...", "en", "only digits"), ("wa wb", "xx", "a"), ("wa", "xx", "b")]


@pytest.mark.parametrize("least,block", [(30, 256), (3, 2), (1, 3)])
def test_divergence_by_hand(spark, least, block):
    rows = audit_rows()
    df = spark.createDataFrame([(i, *r, 1, 2, "c") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, i long, n long, term string")
    got = divergence.divergence(df.repartition(5), least, 7, block)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert key(tuple(r) for r in got.collect()) == key(audit_by_hand(rows, least, 7))


def test_overlaps_of_blocks_by_hand():
    """Sums of any two sources of two blocks, where a block is smaller than a term's postings."""
    import pyarrow as pa

    rng = random.Random(2)
    z = [rng.randrange(5) for _ in range(8)]
    rows = [(t, i, rng.randrange(5, 90)) for t in "abcdefgh" for i in range(8) if rng.random() < 0.7]
    for a, b in ((0, 0), (0, 1), (1, 1)):
        mine = [(t, i, p) for t, i, p in rows if i // 4 in (a, b)]
        batch = pa.RecordBatch.from_pylist([{"lang": "en", "a": a, "b": b, "term": t, "i": i, "p": p, "z": z[i]} for t, i, p in mine])
        want = Counter()
        for t, i, p in mine:
            for u, j, q in mine:
                if t == u and i < j and (i // 4, j // 4) == (a, b):
                    want[i, j] += abs(p - q) - abs(p - z[j]) - abs(z[i] - q)
        got = {(r["i"], r["j"]): r["value"] for out in divergence.overlaps([batch.slice(0, 5), batch.slice(5)], 4) for r in out.to_pylist()}
        assert got == {k: v for k, v in want.items()}


def test_divergence_of_nothing_and_long_texts(spark, monkeypatch):
    assert divergence.divergence(frame(spark, [])).count() == 0
    monkeypatch.setattr(divergence, "PIECE", 20)
    text = "One two, " * 50 + "x" * 70 + " onE"
    parts = [w for p in divergence.pieces(text.encode()) for w in divergence._TERM.findall(p)]
    assert [w.decode() for w in parts] == TERM.findall(lowered(text))


# ---------------------------------------------------------------- licence scans


def base_by_hand(text):
    w = words(text)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    first, last = (min(i for i, _ in at), max(i for i, _ in at)) if at else (None, None)
    return len(w), len(at), first, last, ",".join(sorted({x for _, x in at}))


def scanned(spark, rows):
    return [tuple(r)[:9] for r in license_scan.license_scan(frame(spark, rows)).collect()]


def license_rows():
    rng = random.Random(8)
    mit, apache = TEMPLATES["mit"][0], TEMPLATES["apache"][0]
    rows = [*documents(n=20), (500, "The MIT License, mit license MIT LICENSE!"), (501, "mitlicense mit-license"), (502, "MIT\nLicense"), (503, "License MIT general public, license; GENERAL public License")]
    rows += [(510, mit), (511, sentence(rng, 200) + " " + mit.upper() + sentence(rng, 90)), (512, "x\n// " + apache.replace("\n", "\n// ")), (513, " ".join(mit.split()[:30])), (514, mit + apache)]
    for i in range(40):
        w = " ".join(rng.choice(list(PHRASES) + ["public", "the", "license", "mit general", "software is provided as is"]) for _ in range(30))
        rows.append((600 + i, w))
    return rows


def test_license_base_by_hand(spark):
    rows = license_rows()
    got = [(r[0], *r[1:6]) for r in scanned(spark, rows)]
    assert key(got) == key((d, *base_by_hand(t)) for d, t in rows)


def test_license_spans(spark):
    rows = license_rows()
    got = {r[0]: r for r in scanned(spark, rows)}
    assert got[510][6] == "mit" and got[510][7] == 1.0 and got[511][6] == "mit" and got[512][6] == "apache"
    assert got[514][6] == "apache,mit" and [(s.label, s.first_word) for s in got[514][8]] == [("mit", 0), ("apache", len(words(TEMPLATES["mit"][0])))]
    assert got[513][6] == "" and 0 < got[513][7] < license_scan.COVERED
    assert got[500][6] == "mit" and got[9][6] == "" and got[9][7] == 0.0
    for label, texts in TEMPLATES.items():
        for i, t in enumerate(texts):
            (row,) = scanned(spark, [(1, sentence(random.Random(1), 40) + "\n" + t)])
            assert label in row[6].split(",") and any(s.label == label and s.covered == 1.0 for s in row[8]), (label, i)


def test_license_of_edited_text(spark):
    w = TEMPLATES["bsd"][1].split()
    rng = random.Random(4)
    for _ in range(12):
        w[rng.randrange(len(w))] = "edited"
    (row,) = scanned(spark, [(1, "start " * 9 + " ".join(w))])
    assert row[6] == "bsd" and license_scan.COVERED <= row[7] < 1


def test_license_of_nothing_repeated_rows_and_long_texts(spark, monkeypatch):
    assert scanned(spark, []) == []
    assert scanned(spark, [(1, None), (1, None), (2, "")]) == [(1, 0, 0, None, None, "", "", 0.0, [])] * 2 + [(2, 0, 0, None, None, "", "", 0.0, [])]
    rng = random.Random(6)
    texts = [t for group in TEMPLATES.values() for t in group]
    long = "\n".join(rng.choice([*texts, sentence(rng, 30), "mit license", "general public license", "z" * 900]) for _ in range(120))
    data = np.frombuffer(long.encode(), np.uint8)
    machine = license_scan.scanner(tuple((label, t) for label, group in TEMPLATES.items() for t in group), tuple(PHRASES.items()))
    monkeypatch.setattr(license_scan, "PIECE", 300)
    monkeypatch.setattr(license_scan, "SEGMENT", 16)
    (cut,) = license_scan._block(machine, data, np.array([0, len(data)]))
    monkeypatch.undo()
    (whole,) = license_scan._block(machine, data, np.array([0, len(data)]))
    assert (cut.words, cut.base, cut.first, cut.last, ",".join(sorted(cut.phrases))) == (whole.words, whole.base, whole.first, whole.last, ",".join(sorted(whole.phrases))) == base_by_hand(long)
    assert all(np.array_equal(a, b) for a, b in zip(cut.matches, whole.matches, strict=True)) and len(whole.matches[0])


def test_matching_statistics_by_hand():
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(3, 25))) for _ in range(6)]
    machine = license_scan.scanner(tuple((str(i), t) for i, t in enumerate(texts)), (("a b", "x"), ("b", "y")))
    number = {int(x): i for i, x in enumerate(machine.hashes)}
    text = rng.choices("abcde", k=400)
    data = np.frombuffer(" ".join(text).encode(), np.uint8)
    found = license_scan.words(data, np.array([0, len(data)]))[3]
    ids = np.array([number.get(int(x), -1) for x in found])
    cut = np.zeros(len(ids), bool)
    cut[[0, 150]] = True
    _, length = machine.steps(ids, cut)
    known = [f" {t} " for t in [*texts, "a b", "b"]]
    for e in range(len(text)):
        begin = 150 if e >= 150 else 0
        want = max(n for n in range(e - begin + 2) if n == 0 or any(" " + " ".join(text[e - n + 1 : e + 1]) + " " in t for t in known))
        assert length[e] == want
