"""Where intermediate tables are cut, in the folder that the cluster shares, and joins and numbers that no hot key makes one task of."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one if all of Spark is on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it goes with the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


_paths: dict[int, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read from there; lost executors cost nothing of it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


def dropped(table: DataFrame) -> None:
    """Removes a stored table that nothing will read any more."""
    path = _paths.pop(id(table), None)
    if path:
        drop_path(table.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has gone already
        return


#: A key is hot if it has more than one in MANY of all rows, so there are fewer than MANY hot keys; each is dealt over SALTS places.
MANY, SALTS = 512, 64


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with keys (a row a key, n: its rows) without n; total: the number of rows, or more. Hot keys' rows are dealt by a salt."""
    hot = F.broadcast(keys.where(F.col("n") * MANY > F.lit(total)).select(*on, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("n") * MANY > F.lit(total), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(keys.withColumn("_salt", F.explode(salts)).drop("n"), [*on, "_salt"]).drop("_salt")


#: What monotonically_increasing_id counts the rows of a partition with.
ROW_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `i`, the place in their group by `order` from 0: the place in a range-sorted partition and the rows before it.

    So a group may hold any part of all rows, and is never numbered by one task.
    """
    keys = [group, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_block", F.shiftright("_at", ROW_BITS))
    # a row for each partition and group; written, so that its size is known where it is joined
    blocks = held.groupBy(group, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows"), f"{name}-places")
    return held.join(places, [group, "_block"]).withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_block", "_first", "_before")
