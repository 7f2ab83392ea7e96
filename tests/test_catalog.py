"""Commits of several writers, segments, migrations and searches over segments."""

import json
import random
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.operators import catalog, search
from threadloom.streaming import index

ROW = "source_id string, project_key string, n long"


def projects_apart():
    """Two project keys of different parts."""
    names = [f"q{i}" for i in range(50)]
    other = next(n for n in names[1:] if catalog.Catalog.part_of(n) != catalog.Catalog.part_of(names[0]))
    return names[0], other


def rows(spark, *what):
    return spark.createDataFrame(list(what), ROW)


def ids(store, name="t"):
    return sorted(r["source_id"] for r in store.tables()[name].collect())


def test_two_writers_on_one_part_lose_nothing(spark, tmp_path):
    a, b = projects_apart()
    one, two = (catalog.Catalog(spark, str(tmp_path / "c")) for _ in range(2))
    one.commit({"t": rows(spark, ("x", a, 1), ("y", b, 1))})
    part = [one.part_of(a)]
    first, second = one.tables(part), two.tables(part)
    one.commit({"t": first["t"].union(rows(spark, ("from one", a, 2)))}, part, read=first.version)
    with pytest.raises(catalog.Conflict):
        two.commit({"t": second["t"].union(rows(spark, ("from two", a, 2)))}, part, read=second.version)
    assert ids(two) == ["from one", "x", "y"]
    # what was refused leaves no data, and is done again from what is there
    named = catalog.Catalog._folders(two.current()) | catalog.Catalog._folders(two._read(1))
    assert {f.name for f in (tmp_path / "c" / "data").iterdir()} == named
    two.commit({"t": two.tables(part)["t"].union(rows(spark, ("from two", a, 2)))}, part)
    assert ids(one) == ["from one", "from two", "x", "y"]


def test_two_writers_on_two_parts_both_stand(spark, tmp_path):
    a, b = projects_apart()
    one, two = (catalog.Catalog(spark, str(tmp_path / "c")) for _ in range(2))
    one.commit({"t": rows(spark, ("x", a, 1), ("y", b, 1))})
    first, second = one.tables([one.part_of(a)]), two.tables([two.part_of(b)])
    one.commit({"t": first["t"].where(F.col("project_key") == a).union(rows(spark, ("from one", a, 2)))}, [one.part_of(a)])
    two.commit({"t": second["t"].where(F.col("project_key") == b).union(rows(spark, ("from two", b, 2)))}, [two.part_of(b)])
    assert ids(one) == ["from one", "from two", "x", "y"]
    # a writer that hasn't read what is there can't replace it
    with pytest.raises(catalog.Conflict):
        catalog.Catalog(spark, str(tmp_path / "c")).commit({"t": rows(spark, ("z", a, 1))})


def test_writers_at_once(spark, tmp_path):
    """Eight writers that each add a row to one part, at the same time, again until they succeed."""
    catalog.Catalog(spark, str(tmp_path / "c")).commit({"t": rows(spark, ("x", "p", 0))})
    refused, died = [], []

    def work(i):
        try:
            add(i)
        except BaseException as e:
            died.append(e)
            raise

    def add(i):
        store = catalog.Catalog(spark, str(tmp_path / "c"))
        while True:
            try:
                held = store.tables()
                store.change({"t": rows(spark, (f"w{i}", "p", i))}, {}, [store.part_of("p")], read=held.version)
                return
            except catalog.Conflict:
                refused.append(i)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    assert not died and ids(store) == sorted(["x", *(f"w{i}" for i in range(8))]) and store.current()["number"] == 9
    assert not list((tmp_path / "c" / "versions").glob("*.draft"))


def test_a_swept_number_is_not_taken_again(spark, tmp_path, monkeypatch):
    """A writer that stops between its look at the newest version and its own, while others write and sweep that number."""
    one, two = (catalog.Catalog(spark, str(tmp_path / "c")) for _ in range(2))
    a, b = projects_apart()
    one.commit({"t": rows(spark, ("x", a, 1), ("y", b, 1))})
    held, real, done = two.tables(), catalog.Catalog._publish, []

    def slow(self, number, text):
        if self is two and not done:
            done.append(1)
            for i in range(3):
                one.change({"t": rows(spark, (f"n{i}", a, i))}, {}, [one.part_of(a)])
        return real(self, number, text)

    monkeypatch.setattr(catalog.Catalog, "_publish", slow)
    with pytest.raises(catalog.Conflict):
        two.change({"t": rows(spark, ("late", b, 1))}, {}, [two.part_of(b)], read=held.version)
    assert ids(one) == ["n0", "n1", "n2", "x", "y"]
    two.tables()
    two.change({"t": rows(spark, ("late", b, 1))}, {}, [two.part_of(b)])
    assert ids(one) == ["late", "n0", "n1", "n2", "x", "y"]


def test_a_number_is_taken_once(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    done, lost = [], []

    def work(i):
        try:
            store._publish(7, json.dumps({"schema_version": 3, "number": 7, "id": "i", "by": i, "tables": {}}))
            done.append(i)
        except catalog.Conflict:
            lost.append(i)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(lost) == 11 and store.current()["by"] == done[0]


def test_segments_are_the_same_as_whole_tables(spark, tmp_path):
    rng = random.Random(3)
    store, want = catalog.Catalog(spark, str(tmp_path / "c")), {}
    names = ["pa", "pb", "pc"]
    joined = 0
    for step in range(12):
        new = {f"s{rng.randrange(30)}": (rng.choice(names), step) for _ in range(rng.randint(1, 6))}
        gone = rng.sample(sorted(want), min(len(want), rng.randint(0, 2)))
        away = [(k, want[k][0]) for k in {*gone, *new} if k in want]
        put = {k: v for k, v in new.items() if k not in gone}
        parts = {store.part_of(p) for p in [*(p for p, _ in put.values()), *(p for _, p in away)]}
        held = store.tables()
        store.change({"t": rows(spark, *((k, p, n) for k, (p, n) in put.items()))} if put else {}, {"t": spark.createDataFrame(away, "source_id string, project_key string")}, parts, read=held.version)
        for k in [*gone, *new]:
            want.pop(k, None)
        want |= put
        assert {r["source_id"]: (r["project_key"], r["n"]) for r in store.tables()["t"].collect()} == want
        if step % 3 == 2:
            joined += store.merge(every=step == 11) is not None
            assert {r["source_id"]: (r["project_key"], r["n"]) for r in store.tables()["t"].collect()} == want
    assert joined and not any(store.current()["tables"]["t"]["log"].values())
    assert store.merge() is None


def test_what_a_change_writes_grows_with_the_change(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    many = spark.range(200_000).select(F.concat(F.lit("s"), "id").alias("source_id"), F.lit("p").alias("project_key"), F.xxhash64("id").alias("n"))
    store.commit({"t": many})
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "c" / "data").rglob("*.parquet"))
    before = size()
    part = store.part_of("p")
    for i in range(3):
        one = rows(spark, (f"s{i}", "p", -1))
        store.change({"t": one}, {"t": one}, [part])
        store.merge()  # the small ones are joined with each other, the large one isn't touched
    assert size() - before < before / 50 and len(store.current()["tables"]["t"]["log"][part]) <= 2
    assert store.tables()["t"].agg(F.count("*"), F.count_if(F.col("n") == -1)).first()[:] == (200_000, 3)
    store.merge(every=True)
    assert store.tables()["t"].agg(F.count("*"), F.count_if(F.col("n") == -1)).first()[:] == (200_000, 3)


def test_old_forms_are_migrated_step_by_step(spark, tmp_path, monkeypatch):
    root = tmp_path / "c"
    s = rows(spark, ("x", "p", 1), ("y", "q", 2))
    s.write.partitionBy("project_key").parquet(str(root / "snapshot-1" / "t"))
    spark.range(3).write.parquet(str(root / "snapshot-1" / "numbers"))
    (root / "CURRENT").write_text(json.dumps({"schema_version": 1, "snapshot": "snapshot-1", "tables": ["numbers", "t"]}))
    store = catalog.Catalog(spark, str(root))
    # an older form is never taken for nothing
    for work in (store.tables, store.current, lambda: store.commit({"t": s})):
        with pytest.raises(ValueError, match="migrate"):
            work()
    with monkeypatch.context() as m:
        m.setattr(catalog.Catalog, "MIGRATIONS", {1: catalog._parted})
        with pytest.raises(ValueError, match="no migration"):
            store.migrate()
    # the step that was done stands, and the next call goes on from there
    assert store._latest()["schema_version"] == 2
    assert store.migrate() == [3] and store.migrate() == []
    assert ids(store) == ["x", "y"] and store.tables()["numbers"].count() == 3
    assert [r["n"] for r in store.tables([store.part_of("q")])["t"].where("project_key = 'q'").collect()] == [2]
    store.commit({"numbers": spark.range(5)})
    store.change({"t": rows(spark, ("x", "p", 9))}, {"t": rows(spark, ("x", "p", 1))}, [store.part_of("p")])
    store.commit({"numbers": spark.range(6)})
    assert {r["source_id"]: r["n"] for r in store.tables()["t"].collect()} == {"x": 9, "y": 2} and store.tables()["numbers"].count() == 6
    store._publish(99, json.dumps({"schema_version": 4, "number": 99, "tables": {}}))
    with pytest.raises(ValueError, match="newer"):
        store.tables()
    with pytest.raises(ValueError, match="newer"):
        store.migrate()


def test_what_dead_writers_left_goes(spark, tmp_path, monkeypatch):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    store.commit({"t": rows(spark, ("x", "p", 1))})
    store._write("t", rows(spark, ("dead", "p", 1)), 2)
    store.commit({"t": rows(spark, ("y", "p", 1))})
    assert len(list((tmp_path / "c" / "data").iterdir())) == 3
    monkeypatch.setattr(catalog.Catalog, "PATIENCE", -1)
    store.commit({"t": rows(spark, ("z", "p", 1))})
    assert {f.name for f in (tmp_path / "c" / "data").iterdir()} == store._folders(store.current()) | store._folders(store._read(2)) and ids(store) == ["z"]


# ---------------------------------------------------------------- searches

STOCK = "build test parser index cache token stream window merge commit search query score block".split()


def corpus(spark, n, seed=1, project=lambda i: f"p{i % 3}"):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        w = rng.choices(STOCK, weights=[1 / (k + 1) for k in range(len(STOCK))], k=int(4 + rng.paretovariate(0.9) * 5) % 400)
        if rng.random() < 0.01:
            w += ["build"] * rng.randint(5, 30)
        docs.append((f"s{i:05d}", project(i), " ".join(w), rng.randrange(50)))
    df = spark.createDataFrame(docs, "source_id string, project_key string, search_text string, u long")
    docs = df.select("source_id", "project_key", "search_text").withColumn("length", F.size(search.words(F.col("search_text"))))
    return docs, df.select("source_id", "project_key", F.timestamp_seconds("u").alias("updated_at"))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents, sessions, an index with blocks of some 64 documents, and its maxima."""
    block, search.BLOCK = search.BLOCK, 64
    at = tmp_path_factory.mktemp("small")
    docs, sessions = corpus(spark, 1500)
    index = search.with_blocks(search.postings(docs), docs)
    out = []
    for name, df in (("docs", docs), ("sessions", sessions), ("index", index), ("best", search.maxima(index))):
        df.write.parquet(str(at / name))
        out.append(spark.read.parquet(str(at / name)))
    search.BLOCK = block
    return out


@pytest.mark.parametrize("query,project", [("build", None), ("score OR block", "p1"), ("commit merge", "p2"), ("build NOT cache", None), ("(token OR query) NOT \"index cache\"", "few"), ("zzz", None), ("build OR zzz", "p0")])
def test_blocks_give_the_same_results(spark, small, query, project, monkeypatch):
    monkeypatch.setattr(search, "SEED", 4)
    docs, sessions, index, best = small
    where = F.lit(True) if project is None else F.col("source_id") < "s00025" if project == "few" else F.col("project_key") == project
    plain = search.search(index.drop("block"), docs, sessions, query, where).collect()
    fast = search.search(index, docs, sessions, query, where, best=best, project_key=project if project != "few" else None).collect()
    assert [tuple(r) for r in fast] == [tuple(r) for r in plain]


def test_blocks_that_cannot_matter_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 64)
    monkeypatch.setattr(search, "SEED", 8)
    # a word that stands once in many documents, and is what a few are about
    docs, sessions = corpus(spark, 12_000, 5)
    n = F.abs(F.xxhash64("source_id")) % 1000
    said = F.when(n < 5, F.repeat(F.lit(" needle"), (4 + n * 3).cast("int"))).when(n < 150, F.lit(" needle")).otherwise(F.lit(""))
    docs = docs.withColumn("search_text", F.concat("search_text", said)).withColumn("length", F.size(search.words(F.col("search_text")))).cache()
    index = search.with_blocks(search.postings(docs), docs).cache()
    best = search.maxima(index)
    totals = docs.where("length > 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    read, _ = search.best_blocks(index, best, search.parse("needle"), totals, sessions, 20)
    wanted = F.col("term") == "needl"
    assert 20 <= read.where(wanted).count() < index.where(wanted).count() / 4
    got, want = ([tuple(r) for r in search.search(index, docs, sessions, "needle", F.lit(True), best=b).collect()] for b in (best, None))
    assert got == want and len(got) == 20
    spark.catalog.clearCache()


def stream_rows(spark, batch):
    full = [(s, p, "codex", s, f, None, "unknown", None, None, op, [(0, "user", t, "l")]) for s, p, f, t, op in batch]
    return spark.createDataFrame(full, index.STREAM).withColumn("updated_at", F.timestamp_seconds(F.lit(5)))


def test_searches_over_segments_equal_a_full_build(spark, tmp_path):
    rng = random.Random(11)
    store, now = catalog.Catalog(spark, str(tmp_path / "c")), {}
    say = lambda: " ".join(rng.choices(STOCK, k=rng.randint(2, 30)))
    for step in range(4):
        batch = []
        for i in rng.sample(range(40), 9 if step else 30):
            name = f"s{i}"
            if name in now and rng.random() < 0.3:
                batch.append((name, now.pop(name)[0], uuid.uuid4().hex, "", "removed"))
            else:
                now[name] = (rng.choice(["pa", "pb"]), say())
                batch.append((name, now[name][0], uuid.uuid4().hex, now[name][1], "new"))
        assert index.apply_batch(store, stream_rows(spark, batch))["indexed"] == sum(b[4] == "new" for b in batch)
        assert index.apply_batch(store, stream_rows(spark, batch)) == {"indexed": 0, "removed": 0}
        if step < 2:
            continue
        whole = catalog.Catalog(spark, str(tmp_path / f"whole{step}"))
        index.apply_batch(whole, stream_rows(spark, [(s, p, "1", t, "new") for s, (p, t) in now.items()]))
        for name in ("postings", "capsules", "sessions"):
            columns = {"postings": ["source_id", "project_key", "term", "positions", "length"], "capsules": ["source_id", "project_key", "search_text"], "sessions": ["source_id", "project_key"]}[name]
            got, want = (sorted(map(tuple, x.tables()[name].select(*columns).collect())) for x in (store, whole))
            assert got == want, (step, name)
        count = lambda x: {r["term"]: r["n"] for r in x.tables()["maxima"].groupBy("term").agg(F.sum("documents").alias("n")).collect() if r["n"]}
        assert count(store) == count(whole)
        for query, project in (("build OR score", None), ("test parser", "pa")):
            where = F.lit(True) if project is None else F.col("project_key") == project
            got, want = ([(r["source_id"], round(r["score"], 9), r["snippet"]) for r in search.kept(x, query, where, project_key=project).collect()] for x in (store, whole))
            assert got == want


def test_two_streams_into_one_part(spark, tmp_path, monkeypatch):
    """A batch that is overtaken by another writer between its reading and its commit is derived again."""
    root, real, done = str(tmp_path / "c"), catalog.Catalog.change, []
    index.apply_batch(catalog.Catalog(spark, root), stream_rows(spark, [("a", "p", "1", "one", "new")]))

    def overtaken(self, *args, **kwargs):
        if not done:
            done.append(1)
            index.apply_batch(catalog.Catalog(spark, root), stream_rows(spark, [("b", "p", "1", "two", "new"), ("a", "p", "2", "one more", "new")]))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(catalog.Catalog, "change", overtaken)
    assert index.apply_batch(catalog.Catalog(spark, root), stream_rows(spark, [("c", "p", "1", "three", "new"), ("a", "p", "3", "one again", "new")])) == {"indexed": 2, "removed": 0}
    held = catalog.Catalog(spark, root).tables()
    assert {r["source_id"]: r["search_text"] for r in held["capsules"].collect()} == {"a": "one again", "b": "two", "c": "three"}
