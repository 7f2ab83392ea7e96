"""The driver's tables as sessions, turns and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The order in which the derived sessions take turns among the sources.
ADAPTERS = ("codex", "grok", "opencode", "cursor", "claude", "antigravity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _adapter(conv: Column) -> Column:
    return F.get(F.array(*map(F.lit, ADAPTERS)), (conv % 6).cast("int"))


def source_id(conv: Column) -> Column:
    return F.concat_ws(":", _adapter(conv), F.lit("store"), conv.cast("string"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each conversation."""
    conv = F.col("conv_id")
    k = F.floor(conv / 7).cast("bigint")
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id")
        .distinct()
        .select(
            source_id(conv).alias("source_id"),
            F.concat(F.lit("p"), (conv % 4).cast("string")).alias("project_key"),
            _adapter(conv).alias("adapter"),
            F.lit("store").alias("namespace"),
            conv.cast("string").alias("native_id"),
            F.timestamp_seconds(F.lit(1704067200) + conv * 2220 - 600).alias("started_at"),
            F.timestamp_seconds(F.lit(1704067200) + conv * 2220).alias("updated_at"),
            F.when(conv % 5 == 0, F.concat(F.lit("Session "), k.cast("string"))).alias("title"),
            F.when(conv % 3 == 0, "complete").when(conv % 3 == 1, "possibly_interrupted").otherwise("unknown").alias("health"),
            (conv % 11 != 0).alias("native_available"),
        )
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible turns, numbered from 0; system turns are of a kind that never passes."""
    spoken = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return spoken.select(
        source_id(F.col("conv_id")).alias("source_id"),
        number.alias("ordinal"),
        F.when(F.col("role") == "user", "user").otherwise("agent").alias("role"),
        "text",
        F.concat(F.lit("jsonl:"), (F.col("turn") + 1).cast("string")).alias("locator"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuations between sessions of one project; each leads to a later session."""
    conv = F.col("conv_id")
    k = F.floor(conv / 4).cast("bigint")
    b = k % 7
    back = F.filter(
        F.array(
            F.when(~b.isin(0, 4), F.lit(4)),
            F.when((b >= 3) & (k % 2 == 0), F.lit(12)),
            F.when(b == 6, F.lit(8)),
        ),
        lambda x: x.isNotNull(),
    )
    all_ = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    pairs = all_.select(conv.alias("t"), F.explode(back).alias("back")).select((F.col("t") - F.col("back")).alias("s"), "t").where("s >= 0")
    return pairs.join(all_.select(F.col("conv_id").alias("s")), "s").select(
        source_id(F.col("s")).alias("source_id"),
        source_id(F.col("t")).alias("target_id"),
        F.concat(F.lit("p"), (F.col("t") % 4).cast("string")).alias("project_key"),
        F.lit("explicit").alias("mode"),
        F.timestamp_seconds(F.lit(1706745600) + F.floor(F.col("t") / 2) * 60).alias("confirmed_at"),
    )
