"""Change detection as keyed state equals the batch functions, over batches in any order and after restarts."""

import random

from pyspark.sql import functions as F

from threadloom.operators import delta
from threadloom.streaming import changes


def test_state_equals_the_batch_functions(spark, tmp_path):
    rng = random.Random(5)
    keys = [f"k{i}" for i in range(12)]
    want, ops, closed, n = spark.createDataFrame([], "source_id string, fingerprint string, validated boolean"), [], 0, 0

    def send(rows):
        nonlocal n
        n += 1
        spark.createDataFrame(rows, changes.EVENTS).coalesce(1).write.parquet(str(tmp_path / "tmp" / str(n)))
        (tmp_path / "in").mkdir(exist_ok=True)
        for p in (tmp_path / "tmp" / str(n)).glob("*.parquet"):
            p.rename(tmp_path / "in" / f"{n:03}-{p.name}")

    def follow():
        changes.change_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    for run in range(1, 7):
        complete = run not in (3, 5)
        seen = {k: (rng.choice("xyz"), rng.choice([True, True, False, None])) for k in keys if rng.random() < 0.7}
        protected = [k for k in keys if k not in seen and rng.random() < 0.3]
        events = [(k, run, closed, "seen", f, v) for k, (f, v) in seen.items()] + [(k, run, closed, "protected", None, None) for k in protected]
        rng.shuffle(events)
        cut = rng.randrange(len(events))
        for part in (events[:cut], events[cut:]):
            if part:
                send(part)
        if complete:
            send([(None, run, closed, "closed", None, None)])
            closed = run
        if run % 2 == 0:  # a restart after each second run
            follow()
        now = spark.createDataFrame([(k, f) for k, (f, _) in seen.items()], "source_id string, fingerprint string")
        read = spark.createDataFrame([(k, v) for k, (_, v) in seen.items() if v is not None], "source_id string, valid boolean")
        found = delta.fingerprint_delta(now, want)
        gone = delta.removed(want, now, spark.createDataFrame([(k,) for k in protected], "source_id string"), complete)
        ops += [(r["source_id"], run, r["op"]) for r in found.where("op <> 'removed'").collect()] + [(r[0], run, "removed") for r in gone.collect()]
        retained = {(r["source_id"], run) for r in delta.retained_warnings(found, read).collect()}
        want = spark.createDataFrame(delta.next_checkpoint(found, read, gone).collect(), "source_id string, fingerprint string, validated boolean")
        ops += [(k, run, "retained") for k, _ in retained]
    # a close takes effect with the next batch after it
    send([(None, 7, closed, "closed", None, None)])
    follow()
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = [(r["source_id"], r["run"], r["op"]) for r in got.collect()] + [(r["source_id"], r["run"], "retained") for r in got.where("retained").collect()]
    assert sorted(x for x in rows if x[1] < 7) == sorted(ops)
    state = {(r["source_id"], r["fingerprint"], r["validated"]) for r in changes.checkpoint_of(got.where("run < 7")).collect()}
    assert state == {tuple(r) for r in want.collect()}


def test_a_call_of_python_serves_many_sources(spark, tmp_path, monkeypatch):
    """6000 sources in 8 places: a source that is gone is told, one that is protected isn't."""
    monkeypatch.setattr(changes, "PLACES", 8)
    n = spark.range(6000).select(F.col("id").cast("string").alias("source_id"))
    event = lambda rows, run, kind, f: rows.select("source_id", F.lit(run).cast("bigint").alias("run"), F.lit(run - 1).cast("bigint").alias("closed"), F.lit(kind).alias("kind"), f.cast("string").alias("fingerprint"), F.lit(True).alias("valid"))
    none, one = F.lit(None), spark.range(1).select(F.lit(None).cast("string").alias("source_id"))
    runs = [event(n, 1, "seen", F.lit("a")), event(one, 1, "closed", none), event(n.where("source_id % 3 = 0"), 2, "seen", F.col("source_id") % 2).unionByName(event(n.where("source_id % 3 = 1"), 2, "protected", none)), event(one, 2, "closed", none), event(one, 3, "closed", none)]
    for k, rows in enumerate(runs):
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    query = changes.change_stream(spark, str(tmp_path / "in/*"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("run <= 2").groupBy("run", "op").count().collect()
    assert {tuple(r) for r in got} == {(1, "new", 6000), (2, "changed", 2000), (2, "removed", 2000)}
