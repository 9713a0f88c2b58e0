"""Cut lineage safely, and follow a jump table along each series."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators.ordered import Seq, scan


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    A folder of this machine's own stands in for it only on a local master, where driver and
    executors are one process; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-ckpt-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write to the checkpoint folder so that later steps neither recompute nor depend on executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _leave(rows: Column, start: Column) -> Column:
    """Where the path from ``start`` leaves a sorted list of (i, n)."""
    return F.aggregate(rows, start, lambda p, x: F.when(x["i"] == p, x["n"]).otherwise(p))


def _visit(rows: Column, start: Column) -> Column:
    """Indices of a sorted list of (i, n) on the path from ``start``."""
    init = F.struct(start.cast("long").alias("p"), F.array().cast("array<bigint>").alias("o"))
    step = lambda s, x: F.when(x["i"] == s["p"], F.struct(x["n"].alias("p"), F.array_append(s["o"], x["i"]).alias("o"))).otherwise(s)
    return F.aggregate(rows, init, step, lambda s: s["o"])


def jump_chain(df: DataFrame, keys: Sequence[str], index: str, nxt: str, block: int = 2048) -> DataFrame:
    """Rows on the path that starts at index 0 of each series and follows ``nxt``.

    ``index`` is dense and ``nxt > index``. Series that fit a block are folded as one
    small list. Longer ones are cut into blocks: for the few rows of a block that another
    block points to, find where they leave it; these crossings form a much shorter jump
    table, solved the same way; then each block is entered at its one visited crossing.
    """
    keys = list(keys)
    slim = df.select(*keys, F.col(index).cast("long").alias("i"), F.col(nxt).cast("long").alias("n"))
    top = slim.agg(F.max("i")).first()[0]
    rows = F.array_sort(F.collect_list(F.struct("i", "n"))).alias("_rows")
    if top is None or top < block:
        seen = slim.groupBy(*keys).agg(rows).select(*keys, F.explode(_visit(F.col("_rows"), F.lit(0))).alias(index))
    else:
        at = F.floor(F.col("i") / block).cast("long")
        blocks = slim.withColumn("_blk", at).groupBy(*keys, "_blk").agg(rows)
        far = slim.filter(F.floor(F.col("n") / block) > at).select(*keys, F.col("n").alias("i"))
        doors = far.unionByName(slim.filter("i = 0").select(*keys, "i")).distinct()
        doors = doors.withColumn("_blk", at).groupBy(*keys, "_blk").agg(F.collect_list("i").alias("_doors"))
        out = F.transform("_doors", lambda e: F.struct(e.alias("i"), _leave(F.col("_rows"), e).alias("x")))
        cross = blocks.join(doors, [*keys, "_blk"]).select(*keys, "_blk", F.inline(out))
        cross = scan(cross, Seq(tuple(keys), ("i",), float(block) * 1000), index="_j")
        where = cross.select(*keys, F.col("i").alias("x"), F.col("_j").alias("_nj"))
        cross = cut(cross.join(where, [*keys, "x"], "left").withColumn("_nj", F.coalesce("_nj", F.lit(2**62))))
        on = jump_chain(cross, keys, "_j", "_nj", block).select(*keys, "_blk", F.col("i").alias("_in"))
        path = blocks.join(on, [*keys, "_blk"])
        seen = path.select(*keys, F.explode(_visit(F.col("_rows"), F.col("_in"))).alias(index))
    return df.join(seen, [*keys, index], "left_semi").select(*df.columns)
