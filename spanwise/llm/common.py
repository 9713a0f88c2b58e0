"""Shared pieces: row identity, connected components, bucket counts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators.chain import cut, ensure_checkpoint_dir

__all__ = ["components", "cut", "free_name", "last_id", "order_key", "partitions", "shared_folder", "small_batches", "staged"]

#: Stands for a missing id: it orders after every other id.
LAST = 2**63 - 1


def last_id(name: str) -> Column:
    """An id as a long; a missing one comes after all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST))


def order_key(value: Column) -> Column:
    return F.when(value == LAST, F.lit(None).cast("long")).otherwise(value)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """As many as the session deals a shuffle into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node that each node of ``edges`` (a, b longs) can reach: (node, root).

    Large star and small star in turn: every node hangs its larger neighbours, then all its
    neighbours, under the smallest one. A round is two grouped minima and two joins; the
    number of rounds is logarithmic in the longest path. Each round is checkpointed. Nodes
    with very many neighbours are no single group of values: only a minimum is kept for them.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now[0] == now[2] and now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts go to Python in batches of fewer rows than Spark's default, unless the session has set its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def staged(df: DataFrame, folder: str) -> DataFrame:
    """Written as Parquet in the folder that the cluster shares, and read again."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
