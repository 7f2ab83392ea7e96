"""Lines of split files, fingerprints of large ones, and the sink of named files."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources import files, logs, sink, taken


@pytest.fixture()
def small_ranges(spark):
    """Files are read in ranges of some 64 KB."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def lines_by_hand(data):
    data = data.removeprefix(b"\xef\xbb\xbf")
    parts = data.split(b"\n")
    closed = data.endswith(b"\n")
    return [(i + 1, p.decode(), closed or i + 1 < len(parts)) for i, p in enumerate(parts) if p.decode().strip(" ")]


def test_lines_of_split_files(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(["é", "x" * rng.randint(0, 300), "", "\r", " ", "line\t"]) + "\n" for _ in range(n))
    bodies = {
        "long.jsonl": text(9000), "open.jsonl": text(3000) + "no break", "empty.jsonl": "", "one.jsonl": "one", "break.jsonl": "\n", "breaks.jsonl": "\n\n\n\nx\n\n",
        "wide.jsonl": "w" * 200_000 + "\n" + "z" * 100_000, "mark.jsonl": "﻿marked\nline", "marked.jsonl": "﻿a\n" + text(2000),
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    rows = logs.lines(spark, str(tmp_path))
    got = {}
    for r in rows.collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["line"], r["value"], r["complete"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: x for k, b in bodies.items() if (x := lines_by_hand(b.encode()))}


def test_a_large_log_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    """A log of 20 MB: the places of its turns are those of the file, and no task has read more than a range of it."""
    name = tmp_path / "rollout-019f6000-5678-7000-8000-000000000001.jsonl"
    with name.open("w") as f:
        f.write(json.dumps({"type": "session_meta", "payload": {"cwd": "/w"}}) + "\n")
        for i in range(60_000):
            f.write(json.dumps({"type": "response_item", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": f"turn {i} " + "x" * (i % 400)}]}}) + "\n")
            if i % 1000 == 7:
                f.write("{broken\n\n")
    found = logs.lines(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().agg(F.count("*"), F.max("count")).first()
    assert found[0] > 50 and found[1] < 3000
    turns = logs.codex(spark, str(tmp_path)).turns
    number, want = 1, {}
    for i in range(60_000):
        number += 1
        if i % 20_000 in (0, 7, 8, 19_999):
            want[i] = f"jsonl:{number}"
        number += 2 * (i % 1000 == 7)
    got = turns.where(F.col("ordinal").isin(*want)).collect()
    assert {r["ordinal"]: r["locator"] for r in got} == want and turns.count() == 60_000
    assert all(r["text"].startswith(f"turn {r['ordinal']} ") for r in got)


def test_fingerprints_of_large_files(spark, tmp_path, monkeypatch, small_ranges):
    monkeypatch.setattr(logs, "WHOLE", 1000)
    write = lambda name, body: (tmp_path / name).write_text(body)
    long = "".join(f"line {i}\n" for i in range(20_000))
    for name, body in {"a.jsonl": "short\n", "b.jsonl": long, "c.jsonl": long[:-1], "d.jsonl": long.replace("line 7\nline 8\n", "line 8\nline 7\n"), "e.jsonl": long}.items():
        write(name, body)
    prints = {r["path"][-7]: r["fingerprint"] for r in logs.fingerprints(spark, str(tmp_path)).collect()}
    assert prints["a"] == hashlib.sha256(b"short\n").hexdigest() and prints["b"] == prints["e"]
    assert len({prints[k] for k in "bcd"}) == 3 and all(len(v) == 64 for v in prints.values())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    assert prints == {r["path"][-7]: r["fingerprint"] for r in logs.fingerprints(spark, str(tmp_path)).collect()}


def test_many_files_are_read_batch_by_batch(spark, tmp_path, monkeypatch):
    """More files than a plan reads give the rows of one plan, whatever their names; no plan has more than BATCH of them."""
    names = [f"d{i % 3}/%2Fx {i}" + ["", "[a]", "{b}", "*", "é?"][i % 5] + ".jsonl" for i in range(23)] + [".h/a.jsonl", "_h/a.jsonl", "d0/_a.jsonl", "d0/a.txt"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(f"{i} {k}\n" for k in range(i)) + "open")
    rows = lambda: sorted(map(tuple, logs.lines(spark, str(tmp_path)).collect()))
    prints = lambda: sorted(map(tuple, logs.fingerprints(spark, str(tmp_path)).collect()))
    whole, digests = rows(), prints()
    monkeypatch.setattr(files, "BATCH", 7)
    read, seen = files.read_files, []
    monkeypatch.setattr(logs, "read_files", lambda s, root, p, load: read(s, root, p, lambda r, at: (seen.append(at), load(r, at))[1]))
    assert rows() == whole and prints() == digests and len(digests) == 23
    assert {len(x) for x in seen} == {7, 2} and len(seen) == 12


def test_many_files_are_read_once_by_tasks(spark, tmp_path, monkeypatch):
    """What tasks read of many files is what Spark's readers read, whatever their names and bytes; a long one is read in ranges."""
    bodies = [b"", b"\n", b"one", b"a\n\n  \nb\r\n", b"\xef\xbb\xbfmark\nx", b"\xff\xfe \xc3\n\xe9", b"x" * 90 + b"\nlast", b"line\n" * 40, "é\u2028é\n".encode() * 3]
    for i in range(27):
        at = tmp_path / f"d{i % 3}/%2Fx {i}{['', '[a]', '{b}', '*', 'é?', '#;^', '\u00a0\u2028'][i % 7]}.jsonl"
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(bodies[i % 9])
    (tmp_path / "d0" / "_a.jsonl").write_text("hidden")
    (tmp_path / "d0" / "link.jsonl").symlink_to(tmp_path / "d0" / "_a.jsonl")
    monkeypatch.setattr(logs, "WHOLE", 150)
    as_bytes = lambda rows: sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows.withColumn("value", F.col("value").cast("binary")).collect())
    whole, prints = as_bytes(logs.lines(spark, str(tmp_path))), sorted(map(tuple, logs.fingerprints(spark, str(tmp_path)).collect()))
    assert taken.taken(spark, str(tmp_path), "*.jsonl") is None
    monkeypatch.setattr(taken, "MANY", 5)
    monkeypatch.setattr(taken, "PIECE", 80)
    monkeypatch.setattr(taken, "READ", 100)
    monkeypatch.setattr(sink, "LISTED", 7)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        read = taken.taken(spark, root, "*.jsonl", limit=150)
        assert read.rows.count() == 24 and {r["long"] for r in read.rows.where("size > 80").collect()} == {True}
        assert as_bytes(logs.lines(spark, root, read=read)) == whole
        assert sorted(map(tuple, logs.fingerprints(spark, root, read=read).collect())) == prints and len(prints) == 24


def test_sources_of_many_files_are_read_alike(spark, tmp_path, monkeypatch):
    """The loaders' rows don't depend on who reads the files, and none of many files is opened by Spark's readers."""
    from threadloom.plans import logs as plans

    said = [(n, t, r, f"{r} {t} of {n}") for n in range(8) for t, r in enumerate(("user", "assistant", "user"))]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for source in ("grok", "cursor", "antigravity"):
        rows = lambda: [sorted(map(repr, d.collect())) for s in [plans.scan(spark, str(tmp_path), source)] for d in (s.sessions, s.turns, s.warnings)]  # noqa: B023, E731
        few = rows()
        with monkeypatch.context() as m:
            m.setattr(taken, "MANY", 1)
            m.setattr(logs, "read_files", None)
            assert rows() == few and len(few[0]) == 8 and len(few[1]) == 24 and len(few[2]) == 2


def test_exports_are_parsed_once(spark, tmp_path):
    """What is told of sessions, turns and warnings comes from exports that were parsed and written; no plan reads their files again."""
    from threadloom.plans import logs as plans

    spark.createDataFrame([(n, t, r, f"{r} {t}") for n in range(6) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = plans.scan(spark, str(tmp_path), "opencode")
    assert not any("/exports/" in f for d in (found.sessions, found.turns, found.warnings) for f in d.inputFiles())
    assert (found.sessions.count(), found.turns.count(), found.warnings.count()) == (6, 12, 2)


def test_sink_writes_all_or_nothing(spark, tmp_path):
    root = tmp_path / "out"
    rows = spark.range(200).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), "id", F.lit(".md")).alias("name"), F.concat(F.lit("body é "), "id").alias("body")).repartition(9)
    sink.write_files(rows, str(root))
    read = lambda: {str(f.relative_to(root)): f.read_text() for f in root.rglob("*") if f.is_file()}
    want = {f"d{i % 7}/f{i}.md": f"body é {i}" for i in range(200)}
    assert read() == want
    # a task that fails takes what others have done with it
    bad = rows.select(F.concat(F.lit("new/"), "name").alias("name"), F.when(F.col("body") == "body é 77", F.raise_error(F.lit("no"))).otherwise(F.col("body")).alias("body"))
    with pytest.raises(Exception, match="no"):
        sink.write_files(bad, str(root))
    assert read() == want and not list(root.glob("_staged*"))
    for name in ("../out", "/etc/x", "a/../../b", "", "a//b"):
        with pytest.raises(Exception, match="below a folder"):
            sink.write_files(rows.limit(3).select(F.lit(name).alias("name"), "body"), str(root))
    with pytest.raises(Exception, match="same name"):
        sink.write_files(rows.limit(3).select(F.lit("same").alias("name"), "body"), str(root))
    assert read() == want and not list(root.glob("_staged*"))
    sink.write_files(rows.limit(1).select(F.lit("d0/f0.md").alias("name"), F.lit(None).cast("string").alias("body")), str(root))
    assert read() == want | {"d0/f0.md": ""}


def test_documents(spark, tmp_path):
    rows = spark.createDataFrame([(1, "T token=abc", "say password: hunter22;"), (2, None, None)], "id long, title string, body string")
    name = F.concat(F.lit("x-"), F.col("id"))
    got = {r["name"]: r["body"] for r in sink.documents(rows, name, F.col("title"), F.col("body")).collect()}
    assert got == {"x-1": "# T token=[REDACTED:credential]\n\nsay password=[REDACTED:credential];\n", "x-2": "# \n\n\n"}
    sink.write_files(sink.documents(rows, F.concat(name, F.lit(".json")), F.col("title"), F.col("body"), "json"), str(tmp_path))
    read = {r["name"]: json.loads(r["body"]) for r in sink.read_documents(spark, str(tmp_path), "*.json").collect()}
    assert read["x-2.json"] == {"body": None, "schema_version": 1, "title": None} and "hunter" not in read["x-1.json"]["body"]
    with pytest.raises(ValueError):
        sink.documents(rows, name, F.col("title"), F.col("body"), "other")


def test_a_commit_holds_no_list_of_all_names(spark, tmp_path):
    """What tasks tell the driver doesn't grow with the number of files."""
    import pickle
    from types import SimpleNamespace
    from unittest import mock

    sizes = []
    for n in (10, 2500):
        writer = sink.FileWriter(str(tmp_path / str(n)))
        with mock.patch("pyspark.TaskContext.get", return_value=SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)):
            message = writer.write(iter([{"name": f"a\n{i:05}/b", "body": "x"} for i in range(n)]))
        sizes.append(len(pickle.dumps(message)))
        writer.commit([message, None])
        assert len(list((tmp_path / str(n)).glob("*/b"))) == n and not list((tmp_path / str(n)).glob("_staged*"))
    assert max(sizes) < min(sizes) + 50


def test_what_is_known_of_files_goes_with_their_batch(spark, tmp_path, monkeypatch):
    """Neither a job's tasks nor the session's cache nor plans that are done with grow with the number of files; nothing of it stays set."""
    import gc
    import weakref

    for i in range(90):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.jsonl").write_text(f"{i}\n")
    keys = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize")
    before, seen, plans = {k: spark.conf.get(k) for k in keys}, [], []

    def load(reader, at):
        rows = reader.text(at)
        seen.append((int(spark.conf.get(keys[0])), spark.conf.get(keys[1]), sum(p() is not None for p in plans)))
        plans.append(weakref.ref(rows))
        rows.cycle = [rows]  # a handle that only the collector of cycles would drop
        return rows

    gc.disable()
    try:
        monkeypatch.setattr(files, "BATCH", 40)
        assert files.read_files(spark, str(tmp_path), "*.jsonl", load).count() == 90
    finally:
        gc.enable()
    few = 2 * spark.sparkContext.defaultParallelism
    assert seen == [(few, "0", 0)] * 3 and {k: spark.conf.get(k) for k in keys} == before


def test_a_plan_that_is_not_written_reads_few_files(spark, tmp_path, monkeypatch):
    """A query holds many plans at once: from LAZY files on they are written, and from WIDE on never broadcast."""
    for i in range(9):
        (tmp_path / f"{i}.jsonl").write_text(f"{i}\n")
    monkeypatch.setattr(files, "LAZY", 8)
    monkeypatch.setattr(files, "WIDE", 8)
    rows = files.read_files(spark, str(tmp_path), "*.jsonl", lambda r, at: r.text(at))
    assert len(rows.inputFiles()) > 0 and not any(f.endswith(".jsonl") for f in rows.inputFiles()) and sorted(r["value"] for r in rows.collect()) == [str(i) for i in range(9)]
    keys = spark.range(9).select(F.col("id").cast("string").alias("value"))
    assert "BroadcastHashJoin" not in (plan := keys.join(rows, "value")._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" in plan


def test_a_query_writes_the_logs_of_its_source_alone(spark, tmp_path):
    from pathlib import Path

    from threadloom.plans import logs as plans

    spark.createDataFrame([(n, t, r, f"{r} {t}") for n in range(4) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for source, each in (("grok", 2), ("opencode", 1)):
        root = Path(plans.written(spark, str(tmp_path), source).removeprefix("file://"))
        names = [str(f.relative_to(root)) for f in root.rglob("*.json*") if not f.name.startswith(".")]
        assert [d.name for d in root.parent.iterdir()] == [source] and len(names) == 4 * each + 2 * (source == "opencode")
        assert plans.written(spark, str(tmp_path), source) == str(root) and plans.scan(spark, str(tmp_path), source).sessions.count() == 4


def test_documents_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """A plan knows of lists of names and of no document; names are taken to the letter, bytes as they are."""
    monkeypatch.setattr(sink, "LISTED", 7)
    monkeypatch.setattr(sink, "READ", 40)
    made = {f"d{i % 3}/doc-%2Fx {i}" + ["", "[a]", "{b}", "*", "é?\n"][i % 5] + ".md": ("é\r\n" * i).encode() + b"\xff" for i in range(23)} | {"d1/e/doc-none.md": b""}
    for name, body in (made | dict.fromkeys([".h/doc-a.md", "_h/doc-a.md", "d0/_doc-a.md", "d0/doc-a.txt"], b"no")).items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    for path in (f"{tmp_path}/in", f"file://{tmp_path}/in/"):
        rows = sink.read_documents(spark, path, "doc-*.md")
        assert len(rows.inputFiles()) == 4 and all(f.endswith(".json") for f in rows.inputFiles())
        got = rows.select("name", F.col("body").cast("binary").alias("body")).collect()
        assert {r["name"]: bytes(r["body"]) for r in got} == {n.rpartition("/")[2]: b for n, b in made.items()} and len(got) == 24
    assert sink.read_documents(spark, f"{tmp_path}/in", "none*").count() == 0
    with pytest.raises(FileNotFoundError):
        sink.read_documents(spark, f"{tmp_path}/out", "doc-*.md")


def test_documents_are_written_from_one_scan(spark, monkeypatch):
    """What is written of documents is not joined with documents, a side of which Spark may gather on the driver."""
    from threadloom.plans import queries

    plans, write = [], sink.write_files
    monkeypatch.setattr(sink, "write_files", lambda rows, at: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, at)))
    rows = queries.written_documents(spark, "/root/testdata/sf0.001").collect()
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len(plans) == 1 and "Join" not in plans[0] and plans[0].count("Relation") == 1 and len({r["name"] for r in rows}) == len(rows) == want
