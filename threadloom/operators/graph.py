"""Graph queries over continuation edges: components, ancestors, root-to-leaf paths, depths, cycles, shapes.

Edges never join sessions of two projects, and close no cycle. Components come from alternating stars over all edges at
once. What follows edges does so over chains: a run of nodes where each has one edge out and the next one edge in is found
by doubling pointers, in as many rounds as the logarithm of its length, and is one node from then on; between chains, a
round of joins follows all edges of the nodes that the last round has reached. So a component of any size or shape is many
small rows in many tasks, and a chain of a million hops some twenty rounds; every component goes the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.plans.storage import dropped, folder, numbered, spread_join, stored

PATH_LIMIT = 256
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its weakly connected component."""
    now = stored(edges.select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    for _ in range(MAX_ROUNDS):
        sums = [F.sum(F.xxhash64(*x).cast("decimal(38,0)")) for x in (("u", "v"), ("v", "u"))]
        state = now.agg(F.count("*"), *sums).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("v > u"), least, ["u"], 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"], state[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, now = now, stored(small, "stars")
        dropped(last)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def component_of(edges: DataFrame, sessions: DataFrame, anchor: str) -> DataFrame:
    """The anchor's component as (source_id); a session without edges is one by itself."""
    found = components(edges)
    mine = found.join(F.broadcast(found.where(F.col("node") == anchor).select("component")), "component", "left_semi").select(F.col("node").alias("source_id"))
    alone = sessions.where(F.col("source_id") == anchor).select("source_id")
    return mine.union(alone).distinct()


def induced(edges: DataFrame, sessions: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) among the members, nodes by time and id, edges by confirmation and ends."""
    m = members.select("source_id")
    nodes = sessions.join(m, "source_id", "left_semi").orderBy("updated_at", "source_id")
    inner = edges.join(m, "source_id", "left_semi").join(m.select(F.col("source_id").alias("target_id")), "target_id", "left_semi")
    return nodes, inner.orderBy("confirmed_at", "source_id", "target_id")


def nodes(found: DataFrame, capsules: DataFrame, active: str | None = None) -> DataFrame:
    """Nodes as they are drawn: title, health, whether active, whether still there."""
    from threadloom.functions.redaction import redacted_text
    from threadloom.functions.text import first_non_blank

    rows = found.join(capsules.select("source_id", "source_title", "display_name"), "source_id", "left")
    return rows.select(
        "source_id",
        F.col("adapter").alias("harness"),
        "native_id",
        redacted_text(first_non_blank(F.col("source_title"), F.col("display_name"), F.col("title"))).alias("title"),
        "updated_at",
        "health",
        F.col("native_available"),
        (F.col("source_id") == F.lit(active)).alias("active") if active else F.lit(False).alias("active"),
    )


# ---------------------------------------------------------------- chains


@dataclass(frozen=True)
class Chains:
    """nodes: (node, chain, offset), a chain's name being its first node; sizes: (chain, size, n_in), n_in counting the edges
    that lead into it; edges: (a, b), from the end of chain a to the beginning of chain b. Nodes of a cycle without any other
    edge are in no chain."""

    nodes: DataFrame
    sizes: DataFrame
    edges: DataFrame


def chains(edges: DataFrame) -> Chains:
    """Edges contracted: of a run without branches and merges its ends are left."""
    edges = stored(edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).where("s <> t").distinct(), "edges")
    n_out, n_in = edges.groupBy("s").agg(F.count("*").alias("n_out")), edges.groupBy("t").agg(F.count("*").alias("n_in"))
    edges = stored(edges.join(n_out, "s").join(n_in, "t").select("s", "t", ((F.col("n_out") == 1) & (F.col("n_in") == 1)).alias("inner")), "edges")
    all_ = edges.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    back = edges.where("inner").select(F.col("t").alias("node"), F.col("s").alias("to"))
    held = all_.join(back, "node", "left")
    held = stored(held.select("node", F.coalesce("to", "node").alias("chain"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("offset"), F.col("to").isNull().alias("done")), "pointers")
    for _ in range(MAX_ROUNDS):
        # a pointer that has got to the beginning stays; all others go twice as far, no two of them over the same node
        far = held.select(F.col("node").alias("chain"), F.col("chain").alias("next"), F.col("offset").alias("more"), F.col("done").alias("ends"))
        moved = held.where("not done").join(far, "chain").select("node", F.col("next").alias("chain"), (F.col("offset") + F.col("more")).alias("offset"), F.col("ends").alias("done"))
        left, width = moved.agg(F.count_if(~F.col("done")), F.max("offset")).first()
        last, held = held, stored(held.where("done").unionByName(moved), "pointers")
        dropped(last)
        # a pointer that has gone further than there are nodes goes round
        if not left or width > held.count():
            break
    held = held.where("done").drop("done")
    between = edges.where("not inner")
    ends = held.select(F.col("node").alias("s"), F.col("chain").alias("a"))
    between = stored(between.join(ends, "s").select("a", F.col("t").alias("b")), "between")
    sizes = held.groupBy("chain").agg(F.count("*").alias("size")).join(between.groupBy(F.col("b").alias("chain")).agg(F.count("*").alias("n_in")), "chain", "left").na.fill(0, ["n_in"])
    return Chains(held, stored(sizes, "sizes"), between)


class _Waves:
    """Rows that rounds add, in a folder that each round writes a part of."""

    def __init__(self, like: DataFrame) -> None:
        self.spark, self.path, self.n = like.sparkSession, folder(like.sparkSession, "waves"), 0
        self.schema = like.schema

    def add(self, rows: DataFrame) -> DataFrame:
        """A round's rows, written."""
        at = f"{self.path}/wave-{self.n}"
        rows.write.parquet(at)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def _chain_depths(found: Chains) -> DataFrame:
    """(chain, depth): the longest way to the beginning of each chain that no cycle leads to, by waves from the roots.

    Each edge is followed once, when the chain that it comes from is done; a chain waits until all that leads into it is.
    """
    ready = found.sizes.where("n_in = 0").select("chain", F.lit(0).cast("bigint").alias("depth"))
    waves = _Waves(ready)
    ready = waves.add(ready)
    waiting = None
    while not ready.isEmpty():
        told = ready.join(found.sizes.select("chain", "size"), "chain").select(F.col("chain").alias("a"), (F.col("depth") + F.col("size")).alias("depth"))
        told = found.edges.join(told, "a").groupBy(F.col("b").alias("chain")).agg(F.count("*").alias("got"), F.max("depth").alias("depth"))
        if waiting is not None:
            told = told.unionByName(waiting).groupBy("chain").agg(F.sum("got").alias("got"), F.max("depth").alias("depth"))
        told = stored(told.join(found.sizes.select("chain", "n_in"), "chain"), "told")
        ready = waves.add(told.where("got = n_in").select("chain", "depth"))
        waiting = told.where("got < n_in").select("chain", "got", "depth")
    return waves.all()


def _upwards(found: Chains, anchors: DataFrame, max_hops: int | None) -> DataFrame:
    """(anchor, chain, hops): the chains that lead to each anchor (anchor, chain, offset), with the hops to their last node."""
    within = F.lit(True) if max_hops is None else F.col("hops") <= max_hops
    into = found.edges.select(F.col("b").alias("chain"), F.col("a").alias("from"))
    front = anchors.join(into, "chain").groupBy("anchor", F.col("from").alias("chain")).agg(F.min(F.col("offset") + 1).alias("hops")).where(within)
    waves = _Waves(front)
    front = waves.add(front)
    while not front.isEmpty():
        more = front.join(found.sizes.select("chain", "size"), "chain").join(into, "chain")
        more = more.groupBy("anchor", F.col("from").alias("chain")).agg(F.min(F.col("hops") + F.col("size")).alias("hops")).where(within)
        known = waves.all().groupBy("anchor", "chain").agg(F.min("hops").alias("known"))
        more = more.join(known, ["anchor", "chain"], "left").where("known is null or hops < known").select("anchor", "chain", "hops")
        front = waves.add(more)
    return waves.all().groupBy("anchor", "chain").agg(F.min("hops").alias("hops"))


def _neighbours(edges: list[tuple[str, str]], forward: bool = True) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for s, t in edges:
        out.setdefault(s if forward else t, []).append(t if forward else s)
        out.setdefault(t if forward else s, [])
    return {n: sorted(v) for n, v in out.items()}


def paths(edges: list[tuple[str, str]], limit: int = PATH_LIMIT) -> Iterator[list[str]]:
    """Root-to-leaf paths, depth first in the order of ids, at most `limit`."""
    after = _neighbours(edges)
    inner = {t for _, t in edges}
    n = 0
    for root in sorted(set(after) - inner):
        stack = [iter([root])]
        path: list[str] = []
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            path.append(node)
            if after[node]:
                stack.append(iter(after[node]))
                continue
            yield list(path)
            n += 1
            if n >= limit:
                return
            path.pop()


def timelines(edges: DataFrame, limit: int = PATH_LIMIT) -> DataFrame:
    """(component, path, truncated): each component's root-to-leaf paths, the first `limit` of them in depth-first order.

    Paths grow from all roots at once, a chain a round. As each of them ends somewhere, the first ones of all paths begin
    with the first ones of their beginnings; so no more than these are kept of a component.
    """
    found = chains(edges)
    depth = _chain_depths(found).select("chain")
    whole = components(found.edges.select(F.col("a").alias("source_id"), F.col("b").alias("target_id")))
    group = found.sizes.select("chain").join(whole.withColumnRenamed("node", "chain"), "chain", "left").select("chain", F.coalesce("component", "chain").alias("group"))
    names = found.nodes.join(group, "chain").groupBy("group").agg(F.min("node").alias("component"))
    group = stored(group.join(names, "group").drop("group"), "groups")
    after = stored(found.edges.join(depth.withColumnRenamed("chain", "b"), "b").select(F.col("a").alias("last"), F.col("b").alias("next")), "after")
    order = Window.partitionBy("component").orderBy("path")
    roots = found.sizes.where("n_in = 0").select("chain").join(group, "chain")
    rows = roots.select("component", F.array("chain").alias("path"), F.col("chain").alias("last"), F.lit(False).alias("done"))
    while True:
        now = stored(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1).drop("n"), "paths")
        if now.where("not done").isEmpty():
            break
        grown = now.where("not done").join(after, "last", "left")
        grown = grown.select("component", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"), F.coalesce("next", "last").alias("last"), F.col("next").isNull().alias("done"))
        rows = now.where("done").unionByName(grown)
    kept = now.withColumn("n", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy("component")) > limit).where(F.col("n") <= limit)
    steps = kept.select("component", "n", "truncated", F.posexplode("path").alias("step", "chain")).join(found.nodes, "chain")
    own = steps.groupBy("component", "n", "truncated").agg(F.array_sort(F.collect_list(F.struct("step", "offset", "node"))).alias("path"))
    return own.select("component", F.col("path.node").alias("path"), "truncated")


def depths(edges: DataFrame) -> DataFrame:
    """(source_id, depth): the longest path from a root to each node."""
    found = chains(edges)
    return found.nodes.join(_chain_depths(found), "chain").select(F.col("node").alias("source_id"), (F.col("depth") + F.col("offset")).cast("int").alias("depth"))


def ancestors(edges: DataFrame, anchors: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(anchor, source_id, hops): all that lead to each anchor within max_hops edges; the anchor itself isn't one."""
    if max_hops is not None and max_hops < 1:
        raise ValueError("a depth is at least 1")
    found = chains(edges)
    mine = stored(anchors.select(F.col("source_id").alias("node")).distinct().join(found.nodes, "node").withColumnRenamed("node", "anchor"), "anchors")
    up = _upwards(found, mine, max_hops).join(found.sizes.select("chain", "size"), "chain").join(found.nodes, "chain")
    up = up.select("anchor", F.col("node").alias("source_id"), (F.col("hops") + F.col("size") - 1 - F.col("offset")).alias("hops"))
    before = mine.join(found.nodes.select("chain", "node", F.col("offset").alias("at")), "chain").where("at < offset")
    rows = up.unionByName(before.select("anchor", F.col("node").alias("source_id"), (F.col("offset") - F.col("at")).alias("hops")))
    within = F.lit(True) if max_hops is None else F.col("hops") <= max_hops
    return rows.where(within & (F.col("anchor") != F.col("source_id"))).select("anchor", "source_id", F.col("hops").cast("int").alias("hops"))


def ordered_ancestors(edges: DataFrame, sessions: DataFrame, anchors: DataFrame, max_hops: int | None = None, project_key: str | None = None) -> DataFrame:
    """(anchor, source_id, hops, place): ancestors in the order of their times, then ids. An anchor of another project is an error."""
    if project_key is not None:
        own = sessions.where(F.col("project_key") == project_key).select("source_id")
        if not anchors.select("source_id").join(own, "source_id", "left_anti").isEmpty():
            raise ValueError("an anchor isn't a session of the project")
    found = ancestors(edges, anchors, max_hops).join(sessions.select("source_id", "updated_at"), "source_id")
    return numbered(found, "anchor", ["updated_at", "source_id"], "ordered").select("anchor", "source_id", "hops", (F.col("i") + 1).cast("int").alias("place"))


def topological(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """(component, source_id, depth, place): the order in which a component is drawn: by depth, then time, then id, which never
    puts a session before what leads to it, as a depth is the longest way from a root."""
    rows = depths(edges).join(components(edges).withColumnRenamed("node", "source_id"), "source_id").join(sessions.select("source_id", "updated_at"), "source_id")
    return numbered(rows, "component", ["depth", "updated_at", "source_id"], "topological").select("component", "source_id", "depth", (F.col("i") + 1).cast("int").alias("place"))


def edge_records(edges: DataFrame) -> DataFrame:
    """(target_id, mode, confirmed_at, source_ids): edges of one confirmation as one record."""
    rows = edges.groupBy("target_id", "mode", "confirmed_at").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))
    return rows.orderBy("confirmed_at", "target_id", "mode")


def has_cycle(edges: list[tuple[str, str]]) -> bool:
    """Whether peeling nodes without predecessors leaves any; no recursion, so chains of any length will do."""
    after = _neighbours(edges)
    waiting = {n: 0 for n in after}
    for targets in after.values():
        for t in targets:
            waiting[t] += 1
    ready, done = [n for n, k in waiting.items() if not k], 0
    while ready:
        done += 1
        for t in after[ready.pop()]:
            waiting[t] -= 1
            if not waiting[t]:
                ready.append(t)
    return done < len(after)


def cycle_candidates(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate edges (source_id, target_id) with whether each alone would close a cycle, or tie a session to itself.

    A candidate closes a cycle if its target already leads to its source: target is an ancestor of source.
    """
    found = chains(edges)
    asked = candidates.select("source_id", "target_id").distinct()
    place = found.nodes.select(F.col("node").alias("source_id"), "chain", "offset")
    asked = stored(asked.join(place, "source_id").join(found.nodes.select(F.col("node").alias("target_id"), F.col("chain").alias("up"), F.col("offset").alias("at")), "target_id"), "candidates")
    up = _upwards(found, asked.select(F.col("source_id").alias("anchor"), "chain", "offset").distinct(), None).select(F.col("anchor").alias("source_id"), F.col("chain").alias("up"), F.lit(True).alias("leads"))
    reach = asked.join(up, ["source_id", "up"], "left").where(F.col("leads") | ((F.col("chain") == F.col("up")) & (F.col("at") < F.col("offset")))).select("source_id", "target_id", F.lit(True).alias("back"))
    rows = candidates.join(reach, ["source_id", "target_id"], "left")
    return rows.select("source_id", "target_id", F.when(F.col("source_id") == F.col("target_id"), "self-link").when(F.col("back"), "cycle").otherwise("ok").alias("verdict"))


def knots(edges: DataFrame) -> DataFrame:
    """(node, knot): nodes that lie on cycles or between them, with the smallest node of those that hang together.

    Nodes that no cycle leads to go first, then those that lead to none of what is left.
    """
    for _ in range(2):
        calm = depths(edges).select("source_id")
        edges = stored(edges.join(calm, "source_id", "left_anti").join(calm.withColumnRenamed("source_id", "target_id"), "target_id", "left_anti").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), "knots")
    return components(edges).withColumnRenamed("component", "knot")


def degrees(edges: DataFrame) -> DataFrame:
    """(source_id, n_in, n_out) of each node of an edge: one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("source_id")).agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def edge_shapes(edges: DataFrame) -> DataFrame:
    """Edges with their shape: into a node of several sources MERGE, else out of a node of several targets BRANCH, else CONTINUE."""
    n_in = F.count("*").over(Window.partitionBy("target_id"))
    n_out = F.count("*").over(Window.partitionBy("source_id"))
    rows = edges.withColumn("n_in", n_in).withColumn("n_out", n_out)
    return rows.withColumn("shape", F.when(F.col("n_in") > 1, "MERGE").when(F.col("n_out") > 1, "BRANCH").otherwise("CONTINUE")).drop("n_in", "n_out")


def node_roles(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    rows = sessions.select("source_id").join(degrees(edges), "source_id", "left")
    i, o = F.coalesce("n_in", F.lit(0)), F.coalesce("n_out", F.lit(0))
    role = F.when((i == 0) & (o == 0), "ISOLATED").when(i == 0, "ROOT").when(o == 0, "LEAF").otherwise("INNER")
    return rows.select("source_id", role.alias("role"))


def latest_targets(edges: DataFrame) -> DataFrame:
    """(project_key, target_id, confirmed_at, tied): targets confirmed last; more than one is a tie, which is refused."""
    last = edges.withColumn("r", F.rank().over(Window.partitionBy("project_key").orderBy(F.desc("confirmed_at")))).where("r = 1")
    last = last.select("project_key", "target_id", "confirmed_at").distinct()
    return last.withColumn("tied", F.count("*").over(Window.partitionBy("project_key")) > 1)
