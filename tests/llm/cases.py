"""Documents with nulls, empty and long texts, ties, repeated rows and clashing columns, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k string, th string, rank int, n_words int, label string, epoch int, runs string"
BASE = 13


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sentence(rng, n, stock="the of and in to wher edsh tion née über ßen ción".split()):
    return " ".join(rng.choice(stock) + rng.choice("abcdefgh") for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    base = sentence(rng, 150)
    passage = sentence(rng, 70)
    rows = [(0, None), (1, ""), (2, "   \n "), (3, "..."), (None, "no id " + passage), (4, "one"), (5, "Two words"), (6, base), (7, base), (7, base), (8, base.upper())]
    rows += [(None, None), (None, "no id " + passage), (9, sentence(rng, 6000)), (10, "ab" * 700), (11, passage), (12, passage + " tail of it"), (6, "another text of a known id " + passage)]
    for i in range(n):
        parts = sentence(rng, rng.randint(3, 120))
        if i % 4 == 0:
            w = base.split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = "edit" + str(i)
            parts = " ".join(w)
        elif i % 5 == 0:
            parts += "\n" + passage + "\n" + sentence(rng, 30)
        rows.append((100 + i, parts))
    return rows


def frame(spark, rows, langs=None):
    full = [(d, t, (langs or {}).get(d, "en"), None if i % 7 == 0 else f"src{i % 3}", len(t or ""), 0.5, "k", "th", 1, 2, "x", 3, "r") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
