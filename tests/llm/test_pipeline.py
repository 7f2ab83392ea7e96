"""The pipeline, stage by stage, each held against a plain version on the stage's own input."""

import json
import os
import random
import zlib
from collections import Counter

import pytest
import regex

from tests.llm.cases import documents, frame, key, sentence, words
from tests.llm.test_dedup import linked_by_brute_force
from tests.llm.test_models import toxicity_scores
from tests.llm.test_text import TOKENIZER, labelled, needs_tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def contaminated_by_brute_force(rows, items):
    windows = {tuple(w[i : i + 13]) for w in map(words, items) for i in range(len(w) - 12)} | {tuple(w) for w in map(words, items) if 0 < len(w) < 13}
    out = []
    for _, text in rows:
        w, hit = words(text), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
        out.append(bool(hit) and 20 * len(hit) >= len(w))
    return out


def written(spark, path, rows, labels, langs, items):
    df = frame(spark, rows, langs)
    # names that operators use for themselves
    df = df.withColumnsRenamed({"rank": "row", "label": "times", "runs": "matches"})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


@needs_tokenizer
def test_stages_by_hand(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(14)
    rows, labels, langs = labelled(300, 13)
    item = sentence(rng, 30)
    near = rows[7][1].split()
    near[3] = "changed"
    rows += [(800 + i, rows[1][1]) for i in range(3)] + [(810, " ".join(near)), (900, item + " ok"), (901, "you idiot moron scum"), (902, None), (903, ""), (None, "no id here"), (None, "no id here"), (4, rows[4][1])]
    docs = written(spark, tmp_path, rows, labels, langs, [item, "short item"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "mixing", "tokens"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "toxicity":
            assert key(after) == key([r for r, s in zip(before, toxicity_scores(before, labels), strict=True) if s < 0.5])
            assert 901 not in {d for d, _ in after} and {1, 800, 900, 902, 903} <= {d for d, _ in after}
        elif name == "jaccard":
            kept = {r for r, (d, _, c) in zip(before, linked_by_brute_force(before), strict=True) if d == c}
            assert key(after) == key(kept) and not {800, 801, 802, 810} & {d for d, _ in after}
        elif name == "decontamination":
            assert key(after) == key([r for r, bad in zip(before, contaminated_by_brute_force(before, [item, "short item"]), strict=True) if not bad])
            assert 900 not in {d for d, _ in after}
        else:
            tokens = lambda t: len(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", t or ""))
            times, stock = Counter(after), Counter(before)
            assert set(times) <= set(stock) and max(times.values()) <= 2 and {902, 903} <= {d for d, _ in after}
            whole, wanted = sum(n * tokens(t) for (_, t), n in times.items()), int(0.8 * sum(tokens(t) for _, t in before))
            # documents at the ends of leaves' prefixes stay whole
            leaves = docs.select("lang", "source").distinct().count()
            assert wanted <= whole <= wanted + leaves * max(tokens(t) for _, t in before)
        seen.append(after)
    final = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    library, at = Tokenizer.from_file(TOKENIZER), 0
    expected = [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in seen[-1]]
    assert key([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in final]) == key([(d, len(i), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in i))) for d, i in expected])
    for r in final:
        assert r["start"] == at
        at += r["n_tokens"]
    assert json.dumps(at) and corpus_pipeline.ORACLE_SQL is None and os.path.exists(TOKENIZER)


@needs_tokenizer
def test_nothing_and_no_labels(spark, tmp_path):
    written(spark, tmp_path / "none", [], [], {}, ["an item"])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = documents(3, 15)
    docs = written(spark, tmp_path / "some", rows, [], {}, [])
    for name, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[2]):
        assert stage(spark, docs, str(tmp_path / "some")).count() == len(rows), name
