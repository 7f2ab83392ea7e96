"""Graphs of any size and shape, against plain versions."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph

EDGE = "source_id string, target_id string"


def dags(seed, many=14):
    """Edges of random acyclic graphs of many shapes, each a component or more of its own."""
    rng, out = random.Random(seed), []
    for g in range(many):
        n, p = rng.randint(2, 22), rng.choice([0.05, 0.15, 0.4])
        names = [f"g{g:02}-{x:02}" for x in rng.sample(range(100), n)]
        out += [(names[i], names[j]) for i in range(n) for j in range(i + 1, n) if j == i + 1 and rng.random() < 0.7 or rng.random() < p]
    return out + [(f"c{i:02}", f"c{i + 1:02}") for i in range(37)] + out[:3]


def depths_by_hand(edges):
    after, n_in = defaultdict(set), defaultdict(int)
    for s, t in set(edges):
        after[s].add(t)
        n_in[t] += 1
    depth = {s: 0 for s in {x for e in edges for x in e} if not n_in[s]}
    ready = deque(depth)
    while ready:
        s = ready.popleft()
        for t in after[s]:
            depth[t] = max(depth.get(t, 0), depth[s] + 1)
            n_in[t] -= 1
            if not n_in[t]:
                ready.append(t)
    return {s: d for s, d in depth.items() if not n_in[s]}


def ancestors_by_hand(edges, anchor, most):
    before = defaultdict(set)
    for s, t in edges:
        before[t].add(s)
    hops, pending = {anchor: 0}, deque([anchor])
    while pending:
        t = pending.popleft()
        for s in before[t]:
            if s not in hops and (most is None or hops[t] < most):
                hops[s] = hops[t] + 1
                pending.append(s)
    return {s: h for s, h in hops.items() if s != anchor}


def group_of(edges):
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for s, t in edges:
            low = min(root[s], root[t])
            if (root[s], root[t]) != (low, low):
                root[s] = root[t] = low
                changed = True
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_depths_and_ancestors_by_hand(spark, seed):
    edges = dags(seed)
    df = spark.createDataFrame(edges, EDGE)
    root = group_of(edges)
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == root
    assert {r["source_id"]: r["depth"] for r in graph.depths(df).collect()} == depths_by_hand(edges)
    anchors = sorted(root)[::4] + ["nowhere"]
    for most in (None, 2):
        got = defaultdict(dict)
        for r in graph.ancestors(df, spark.createDataFrame([(a,) for a in anchors], "source_id string"), most).collect():
            assert r["source_id"] not in got[r["anchor"]]
            got[r["anchor"]][r["source_id"]] = r["hops"]
        assert {a: got[a] for a in anchors} == {a: ancestors_by_hand(edges, a, most) for a in anchors}
    want = defaultdict(list)
    for c in set(root.values()):
        want[c] = list(graph.paths([e for e in set(edges) if root[e[0]] == c], 8))
    got = defaultdict(list)
    for r in graph.timelines(df, 7).collect():
        assert r["truncated"] == (len(want[r["component"]]) > 7)
        got[r["component"]].append(r["path"])
    assert {c: sorted(p) for c, p in got.items()} == {c: sorted(p[:7]) for c, p in want.items()}


def test_orders_and_cycles_by_hand(spark):
    edges = dags(3, 6)
    df, nodes = spark.createDataFrame(edges, EDGE), sorted({x for e in edges for x in e})
    rng = random.Random(1)
    times = {x: rng.randrange(5) for x in nodes}
    sessions = spark.createDataFrame(list(times.items()), "source_id string, u long").withColumn("updated_at", F.timestamp_seconds("u"))
    depth, root = depths_by_hand(edges), group_of(edges)
    place = {}
    for c in set(root.values()):
        place |= {x: i for i, x in enumerate(sorted((x for x in nodes if root[x] == c), key=lambda x: (depth[x], times[x], x)), 1)}
    assert {r["source_id"]: r["place"] for r in graph.topological(df, sessions).collect()} == place
    anchors = spark.createDataFrame([(x,) for x in nodes[::3]], "source_id string")
    got = {(r["anchor"], r["source_id"]): r["place"] for r in graph.ordered_ancestors(df, sessions, anchors).collect()}
    assert got == {(a, x): i for a in nodes[::3] for i, x in enumerate(sorted(ancestors_by_hand(edges, a, None), key=lambda x: (times[x], x)), 1)}
    asked = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)]
    got = {(r[0], r[1]): r[2] for r in graph.cycle_candidates(df, spark.createDataFrame(asked, EDGE)).collect()}
    assert got == {(s, t): "self-link" if s == t else "cycle" if t in ancestors_by_hand(edges, s, None) else "ok" for s, t in asked}


def test_knots_are_what_cycles_hold(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y"), ("y", "z"), ("p", "q"), ("q", "p"), ("y", "p"), ("k", "l"), ("l", "m")]
    assert {r["node"]: r["knot"] for r in graph.knots(spark.createDataFrame(edges, EDGE)).collect()} == dict.fromkeys("abcypq", "a")
    assert graph.knots(spark.createDataFrame(edges[-2:], EDGE)).count() == 0
    assert {r["node"]: r["knot"] for r in graph.knots(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], EDGE)).collect()} == {"a": "a", "b": "a"}


def test_a_chain_takes_few_rounds(spark):
    """1,501 sessions after each other, which one round a hop would take 1,500 rounds for."""
    df = spark.range(1500).select(F.format_string("n%05d", "id").alias("source_id"), F.format_string("n%05d", F.col("id") + 1).alias("target_id"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert {r["source_id"]: r["depth"] for r in graph.depths(df).collect()} == {f"n{i:05}": i for i in range(1501)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 250
    (path,) = graph.timelines(df).collect()
    assert path["path"] == [f"n{i:05}" for i in range(1501)] and not path["truncated"] and path["component"] == "n00000"
    up = graph.ancestors(df, spark.createDataFrame([("n01500",)], "source_id string")).agg(F.count("*"), F.sum("hops"), F.max("hops")).first()
    assert up[:] == (1500, 1500 * 1501 // 2, 1500)


def test_a_component_of_many_edges_is_many_tasks(spark):
    """One component of 300,000 edges: chains of 50 that a hub begins and others branch from."""
    n = F.col("id")
    chain = spark.range(300_000).select(F.when(n % 50 == 0, F.lit(-1)).otherwise(n - 1).alias("s"), n.alias("t"))
    df = chain.select(F.concat(F.lit("s"), "s").alias("source_id"), F.concat(F.lit("s"), "t").alias("target_id"))
    found = graph.depths(df).withColumn("part", F.spark_partition_id())
    assert found.agg(F.count("*"), F.max("depth"), F.sum("depth")).first()[:] == (300_001, 50, 6000 * sum(range(51)))
    assert found.groupBy("part").count().agg(F.max("count")).first()[0] < 200_000
    up = graph.ancestors(df, spark.createDataFrame([("s49",), ("s299999",)], "source_id string"))
    assert sorted(map(tuple, up.groupBy("anchor").agg(F.count("*"), F.max("hops")).collect())) == [("s299999", 50, 50), ("s49", 50, 50)]
