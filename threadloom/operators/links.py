"""Linking: requests for continuation edges, checked in one order of refusals and inserted once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import knots
from threadloom.plans.storage import stored
from threadloom.schema import HARNESSES

# Why a request is refused, in the order in which it is checked.
REFUSALS = (
    "no-sources", "invalid-session-id", "duplicate-source", "self-link", "unknown-target", "foreign-target", "unsupported-target", "unknown-source",
    "foreign-source", "unavailable-target", "unavailable-source", "cycle",
)


def valid_id(c: str):
    parts = F.split(c, ":")
    return (F.size(parts) == 3) & F.forall(parts, lambda p: (p != "") & (F.trim(p) == p) & ~F.rlike(p, F.lit(r"\p{C}")))


def judge(requests: DataFrame, sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests (request, project_key, source_ids, target_id) with the first reason against each but cycles; null if none."""
    known = sessions.select("source_id", F.col("project_key").alias("own"), "adapter", "native_available")
    target = known.select(*(F.col(c).alias(f"t_{c}") for c in known.columns))
    rows = requests.join(target, F.col("target_id") == F.col("t_source_id"), "left")
    each = requests.select("request", "project_key", "target_id", F.explode_outer("source_ids").alias("source_id")).join(known, "source_id", "left")
    pairs = edges.select("source_id", "target_id", F.lit(True).alias("exists"))
    each = each.join(pairs, ["source_id", "target_id"], "left")
    facts = each.groupBy("request").agg(
        F.bool_or(F.col("own").isNull()).alias("unknown"),
        F.bool_or(F.col("own") != F.col("project_key")).alias("foreign"),
        F.bool_or(F.col("exists").isNull()).alias("fresh"),
        F.bool_or(F.col("exists").isNull() & ~F.col("native_available")).alias("gone"),
    )
    rows = rows.join(facts, "request", "left")
    bad_id = ~valid_id("target_id") | F.exists("source_ids", lambda s: ~((F.size(F.split(s, ":")) == 3) & F.forall(F.split(s, ":"), lambda p: (p != "") & (F.trim(p) == p))))
    n = F.coalesce(F.size("source_ids"), F.lit(0))
    refusal = (
        F.when(n <= 0, "no-sources")
        .when(bad_id, "invalid-session-id")
        .when(F.size(F.array_distinct("source_ids")) < n, "duplicate-source")
        .when(F.array_contains("source_ids", F.col("target_id")), "self-link")
        .when(F.col("t_source_id").isNull(), "unknown-target")
        .when(F.col("t_own") != F.col("project_key"), "foreign-target")
        .when(~F.col("t_adapter").isin(*HARNESSES), "unsupported-target")
        .when(F.col("unknown"), "unknown-source")
        .when(F.col("foreign"), "foreign-source")
        .when(F.col("fresh") & ~F.col("t_native_available"), "unavailable-target")
        .when(F.col("gone"), "unavailable-source")
    )
    return rows.select("request", "project_key", "source_ids", "target_id", refusal.alias("refusal"))


class Acyclic:
    """A graph kept without cycles, with a topological order that an edge changes only between its ends (Pearce and Kelly 2006)."""

    def __init__(self) -> None:
        self.after: dict[str, set[str]] = {}
        self.before: dict[str, set[str]] = {}
        self.place: dict[str, int] = {}

    def _node(self, n: str) -> None:
        if n not in self.place:
            self.place[n] = len(self.place)
            self.after[n], self.before[n] = set(), set()

    def _reached(self, start: str, ways: dict[str, set[str]], within) -> list[str]:
        seen, todo = {start}, [start]
        while todo:
            for n in ways[todo.pop()]:
                if n not in seen and within(self.place[n]):
                    seen.add(n)
                    todo.append(n)
        return sorted(seen, key=self.place.__getitem__)

    def add(self, source: str, target: str) -> bool:
        """Adds the edge unless it would close a cycle; whether it stands."""
        self._node(source)
        self._node(target)
        if source == target:
            return False
        low, high = self.place[target], self.place[source]
        if low < high:
            forward = self._reached(target, self.after, lambda p: p <= high)
            if forward[-1] == source:
                return False
            back = self._reached(source, self.before, lambda p: p >= low)
            places = sorted(self.place[n] for n in (*back, *forward))
            for n, p in zip((*back, *forward), places, strict=True):
                self.place[n] = p
        self.after[source].add(target)
        self.before[target].add(source)
        return True

    def remove(self, source: str, target: str) -> None:
        self.after[source].discard(target)
        self.before[target].discard(source)


def settled(checked: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, refusal, inserted, existing): requests that nothing else speaks against, taken one after another in the order of `request`.

    A request that would close a cycle with the edges that stand, or with those of requests before it, is refused as a
    whole. An edge can only do so if it lies on a cycle of all that stands and is asked for; only these knots are taken in
    order, each by a call of its own, and all other requests need none.
    """
    open_ = checked.where(F.col("refusal").isNull())
    asked = stored(open_.select("request", F.explode("source_ids").alias("source_id"), "target_id"), "asked")
    standing = edges.select("source_id", "target_id").distinct()
    knot = stored(knots(standing.unionByName(asked.select("source_id", "target_id"))), "knots")
    null = F.lit(None).cast("string")
    rows = standing.select(null.alias("request"), "source_id", "target_id").unionByName(asked.select("request", "source_id", "target_id"))
    rows = rows.join(knot.withColumnRenamed("node", "target_id"), "target_id").join(knot.select(F.col("node").alias("source_id"), F.col("knot").alias("same")), "source_id").where("knot = same").drop("same")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, stands = Acyclic(), set()
        new = pdf["request"].notna()
        for s, t in sorted(zip(pdf.loc[~new, "source_id"], pdf.loc[~new, "target_id"], strict=True)):
            graph.add(s, t)
            stands.add((s, t))
        out = []
        for request, own in pdf[new].groupby("request", sort=True):
            fresh = [p for p in zip(own["source_id"], own["target_id"], strict=True) if p not in stands]
            done = []
            for p in fresh:
                if not graph.add(*p):
                    break
                done.append(p)
            if len(done) < len(fresh):
                for p in done:
                    graph.remove(*p)
                out.append((request, "cycle"))
            else:
                stands.update(fresh)
        return pd.DataFrame(out, columns=["request", "found"])

    refused = stored(rows.groupBy("knot").applyInPandas(work, "request string, found string"), "refused")
    # of those that are left the first one inserts an edge that doesn't stand
    taken = asked.join(refused.select("request"), "request", "left_anti").join(standing.withColumn("old", F.lit(True)), ["source_id", "target_id"], "left")
    first = taken.where("old is null").groupBy("source_id", "target_id").agg(F.min("request").alias("first"))
    taken = taken.join(first, ["source_id", "target_id"], "left")
    done = taken.groupBy("request").agg(F.count_if(F.col("first") == F.col("request")).alias("inserted"), F.count_if(~F.col("first").eqNullSafe(F.col("request"))).alias("existing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return checked.join(refused, "request", "left").join(done, "request", "left").select("request", F.coalesce("refusal", "found").alias("refusal"), zero("inserted"), zero("existing"))


def link(requests: DataFrame, sessions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with those of accepted requests, (request, refusal, inserted, existing)). Edges that stand aren't inserted again;
    of requests for one new edge the first one inserts it. The edges stay without cycles, whatever is asked together."""
    result = settled(judge(requests, sessions, edges), edges)
    asked = requests.join(result.where(F.col("refusal").isNull()).select("request"), "request").select("request", "project_key", F.explode("source_ids").alias("source_id"), "target_id", "mode", "confirmed_at")
    fresh = asked.join(edges.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    new = fresh.groupBy("source_id", "target_id", "project_key").agg(F.min_by("mode", "request").alias("mode"), F.min_by("confirmed_at", "request").alias("confirmed_at"))
    return edges.unionByName(new.select(*edges.columns)), result


def link_resolved(requests: DataFrame, resolved: DataFrame, sessions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As link(), through targets as they were resolved (project_key, kind, source_id): a request (request, project_key,
    source_ids, confirmed_at) whose project has no resolved or confirmed target is refused before anything else."""
    target = resolved.where((F.col("kind") == "resolved") & F.col("source_id").isNotNull()).select("project_key", F.col("source_id").alias("target_id"))
    rows = requests.drop("target_id", "mode").join(target, "project_key", "left").withColumn("mode", F.lit("current"))
    after, result = link(rows.where(F.col("target_id").isNotNull()), sessions, edges)
    none = rows.where(F.col("target_id").isNull()).select("request", F.lit("target-unconfirmed").alias("refusal"), F.lit(0).cast("bigint").alias("inserted"), F.lit(0).cast("bigint").alias("existing"))
    return after, result.unionByName(none)


def link_document(requests: DataFrame, result: DataFrame) -> DataFrame:
    """(request, document): what a request did, as JSON; a refusal's code where it did nothing."""
    rows = result.join(requests.select("request", "source_ids", "target_id"), "request")
    body = F.struct(F.col("refusal").alias("error"), "existing", "inserted", F.lit(1).alias("schema_version"), "source_ids", "target_id")
    return rows.select("request", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def insert_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with those of `more` that don't stand yet."""
    return edges.unionByName(more.dropDuplicates(["source_id", "target_id"]).join(edges.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti").select(*edges.columns))
