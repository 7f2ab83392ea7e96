"""Operator 8: mixing sources to target weights by hierarchical budgeting.

Documents stand in a tree of domain, language and source. A budget of tokens goes down the tree: each node deals its
budget to its children by their weights. A child can take no more than its documents give in `max_epochs` epochs; what it
leaves is dealt anew among its siblings, and only what all of them leave goes back to the parent's siblings, as a node can
take what its children can. Each leaf then takes a prefix of its tokens: whole epochs first, then a part of the next one,
in an order that the seed and the epoch give. The document at the end of a prefix gives part of its tokens.

A node may have any number of children: the level up to which they are filled is found over the distinct ratios of room
to weight, of which there are at most the square root of twice all tokens for each weight that is listed, and whole
numbers come from running sums over buckets of children. A leaf may have any part of the documents: an epoch's order is a
hash, cut into buckets of about BUCKET documents; sums over buckets find the one bucket in which the prefix ends, and only
that bucket is sorted. Neither leaves nor documents reach the driver.

A token is a run of letters and digits, or one other character that isn't white space.

Cases: null languages and sources are nodes of their own; a child without a listed weight weighs 1 among its siblings, one
of weight 0 gets what its siblings can't take; weights count to six decimals; texts of no tokens cost nothing and are
taken with each whole epoch; null texts have none; repeated rows are documents of their own; an empty table gives none;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import collected, spread_join, stored

BUCKET, SALTS = 2048, 16
LEVELS = ("domain", "lang", "source")
NONE = "\0"
#: A weight of 1 as a whole number.
ONE = 1_000_000
NO_ID = -(1 << 63)


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("bigint")


def _bucket(hashed: Column, buckets: Column) -> Column:
    """0 .. buckets - 1, evenly and in the order of the hash."""
    return F.floor((F.shiftrightunsigned(hashed, 33) * buckets) / (1 << 31))


def dealt(children: DataFrame, budgets: DataFrame) -> DataFrame:
    """(node, budget) of children (parent, node, room, weight) from budgets (parent, budget): by weight, none above its room.

    Whole numbers; a parent's children get all of its budget that they have room for. Nodes are numbers, and so are the
    keys of all joins here: what is small enough for Spark to broadcast stays small then.
    """
    rows = children.where("room > 0").withColumn("tier", F.when(F.col("weight") > 0, 0).otherwise(1)).withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1))
    rows = rows.select("node", "parent", "tier", F.xxhash64("parent", "tier").alias("g"), "room", "weight", (F.col("room") / F.col("weight")).alias("ratio"))
    pools = rows.groupBy("parent", "tier", "g").agg(F.sum("room").alias("all"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("parent").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pools = pools.withColumn("before", before).join(budgets, "parent")
    pools = pools.select("g", "n", F.greatest(F.lit(0), F.least("all", F.col("budget") - F.col("before"))).alias("amount"))
    # children are full up to some ratio: those whose room is less than their share of what the fuller ones leave
    ratios = rows.groupBy("g", "ratio").agg(F.sum("room").alias("room"), F.sum("weight").alias("weight"))
    by = Window.partitionBy("g").orderBy("ratio")
    ratios = ratios.withColumn("up_to", F.sum("room").over(by)).withColumn("from", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    full = (wide("amount") - (wide("up_to") - wide("room"))) * wide("weight") >= wide("from") * wide("room")
    level = ratios.join(pools, "g").groupBy("g").agg(
        F.first("n").alias("n"),
        F.max(F.when(full, F.col("ratio"))).alias("level"),
        (F.first("amount") - F.coalesce(F.sum(F.when(full, F.col("room"))), F.lit(0))).alias("left"),
        F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("shares"),
    )
    # a parent's children are dealt over SALTS tasks, as one may have nearly all of them
    level = level.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("gs", F.xxhash64("g", "salt")).drop("g", "salt")
    rows = rows.withColumn("gs", F.xxhash64("g", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))).join(level, "gs")
    rows = stored(rows.withColumn("full", F.coalesce(F.col("ratio") <= F.col("level"), F.lit(False))).drop("gs"), "dealt")
    filled = rows.where("full").select("node", F.col("room").alias("budget"))
    # the others' shares as differences of rounded running sums, in the order of a hash
    open_ = rows.where("not full").withColumn("h", F.xxhash64("node"))
    open_ = open_.withColumn("bucket", _bucket(F.col("h"), F.ceil(F.col("n") / BUCKET))).withColumn("gb", F.xxhash64("g", "bucket"))
    sums = open_.groupBy("g", "bucket", "gb").agg(F.sum("weight").alias("own"))
    sums = sums.select("gb", (F.sum("own").over(Window.partitionBy("g").orderBy("bucket")) - F.col("own")).alias("base"))
    open_ = open_.join(sums, "gb")
    upto = F.col("base") + F.sum("weight").over(Window.partitionBy("gb").orderBy("h", "node"))
    open_ = open_.withColumn("upto", upto)
    share = lambda c: F.expr(f"(cast(left as decimal(19,0)) * cast({c} as decimal(19,0))) div shares")
    return filled.unionByName(open_.select("node", (share("upto") - share("upto - weight")).cast("bigint").alias("budget")))


def number(depth: int) -> Column:
    """The number of a node at a depth: a hash of its path."""
    return F.xxhash64(F.lit(depth), *LEVELS[:depth])


def budgets(leaves: DataFrame, weights: Mapping[tuple, float], budget: int, max_epochs: int) -> DataFrame:
    """(node, budget) of leaves (domain, lang, source, tokens), no level null; a node is its number()."""
    spark = leaves.sparkSession
    now = spark.range(1).select(F.lit(0).cast("bigint").alias("parent"), F.lit(budget).cast("bigint").alias("budget"))
    for depth in range(1, len(LEVELS) + 1):
        listed = [(*(NONE if x is None else str(x) for x in path), round(w * ONE)) for path, w in weights.items() if len(path) == depth]
        listed = spark.createDataFrame(listed, ", ".join(f"{c} string" for c in LEVELS[:depth]) + ", weight bigint")
        listed = listed.select(number(depth).alias("node"), "weight")
        parent = number(depth - 1) if depth > 1 else F.lit(0).cast("bigint")
        children = leaves.groupBy(parent.alias("parent"), number(depth).alias("node")).agg((F.sum("tokens") * max_epochs).alias("room"))
        children = stored(children.join(listed, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(ONE))), "children")
        now = stored(dealt(children, now), "budgets").withColumnRenamed("node", "parent")
        collected(spark)
    return now.withColumnRenamed("parent", "node")


def mix(docs: DataFrame, domain: Column, weights: Mapping[tuple, float], budget: int | None = None, share: float = 0.5, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """A row for each document and epoch that it is taken in: doc_id, domain, lang, source, epoch, n_tokens, n_taken, text_hash.

    budget: tokens; by default `share` of all tokens. weights: by paths ("web",), ("web", "en"), ("web", "en", "src1").
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain.cast("string").alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), tokens(text).alias("n_tokens"), F.xxhash64(text).alias("text_hash"))
    path = (F.coalesce(F.col(c), F.lit(NONE)) for c in LEVELS)
    rows = stored(rows.withColumn("node", F.xxhash64(F.lit(len(LEVELS)), *path)), "mixing")
    leaves = rows.groupBy("node", *(F.coalesce(F.col(c), F.lit(NONE)).alias(c) for c in LEVELS)).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    leaves = stored(leaves, "leaves")
    every = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    amount = int(every["tokens"] * share) if budget is None else budget
    plan = leaves.select("node", "tokens", "n").join(budgets(leaves, weights, amount, max_epochs), "node", "left")
    took = F.coalesce("budget", F.lit(0))
    # leaves without tokens are taken whole, once
    plan = plan.select("node", "n", F.when(F.col("tokens") > 0, F.expr("coalesce(budget, 0) div tokens")).otherwise(1).cast("int").alias("whole"), F.when(F.col("tokens") > 0, took % F.col("tokens")).otherwise(0).cast("bigint").alias("part"), F.ceil(F.col("n") / BUCKET).alias("buckets"))
    draw = F.xxhash64(F.lit(seed), F.col("whole"), F.coalesce("doc_id", F.lit(NO_ID)), "text_hash")
    placed = spread_join(rows, plan, ["node"], every["n"]).withColumn("draw", draw).withColumn("bucket", _bucket(F.col("draw"), F.col("buckets")))
    placed = stored(placed, "placed")
    sums = placed.where("part > 0").groupBy("node", "bucket").agg(F.sum("n_tokens").alias("m"), F.first("part").alias("part"), F.first("buckets").alias("buckets"))
    sums = sums.withColumn("upto", F.sum("m").over(Window.partitionBy("node").orderBy("bucket")))
    # a row a leaf
    cuts = sums.where((F.col("upto") >= F.col("part")) & (F.col("upto") - F.col("m") < F.col("part"))).select("node", F.col("bucket").alias("cut"), (F.col("upto") - F.col("m")).alias("before"), (F.col("buckets") * BUCKET).alias("n"))
    placed = spread_join(placed, cuts, ["node"], every["n"] + BUCKET * leaves.count(), "left")
    within = Window.partitionBy("node").orderBy("draw", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.where(F.col("bucket") == F.col("cut")).withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    ends = ends.withColumn("extra", F.greatest(F.lit(0), F.least("n_tokens", F.col("part") - F.col("start"))))
    rest = placed.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("extra", F.when(F.col("bucket") < F.col("cut"), F.col("n_tokens")).otherwise(0))
    columns = ["doc_id", *LEVELS, "n_tokens", "text_hash", "whole", "extra"]
    both = rest.select(*columns).unionByName(ends.select(*columns))
    epochs = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("whole"), F.col("n_tokens")).otherwise(F.col("extra")).alias("n_taken")))
    kept = F.filter(epochs, lambda x: (x["epoch"] < F.col("whole")) | (x["n_taken"] > 0))
    out = both.select(*columns, F.explode(kept).alias("e"))
    return out.select("doc_id", *LEVELS, F.col("e.epoch").alias("epoch"), "n_tokens", F.col("e.n_taken").alias("n_taken"), "text_hash")


def mixed_documents(docs: DataFrame, domain: Column, weights: Mapping[tuple, float], **how) -> DataFrame:
    """The documents, all their columns, once for each epoch that takes any of their tokens; they stay whole.

    Cases as above; rows that repeat a document are taken as often as they are repeated, in the same epochs; columns may
    have any names.
    """
    taken = mix(docs, domain, weights, **how).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.col("text_hash").alias("th"), "epoch")
    taken = taken.groupBy("k", "th").agg((F.max("epoch") + 1).alias("times"))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return keyed.join(taken, ["k", "th"]).select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
