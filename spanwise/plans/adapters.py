"""Roles played by the given tables: frames, channels, intervals, poses, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.scalar import band
from spanwise.operators.ordered import Seq, balance
from spanwise.plans.session import epoch_micros, table

DAY = 86400.0
EVENT_SEQ = Seq(("user_id",), ("t", "event_id"), DAY)
CUTS = (0.25, 0.5, 0.75)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Scored frames: one series per user, time in seconds, score = min(value / 200, 1)."""
    d = table(spark, sf, "events")
    d = d.withColumn("t", epoch_micros("ts") / F.lit(1e6)).withColumn("score", F.least(F.col("value") / 200.0, F.lit(1.0)))
    return d.withColumn("risk_level", band(F.col("score"), CUTS))


def event_frames(spark: SparkSession, sf: str, *cols: str) -> tuple[DataFrame, Seq]:
    """Scored frames with hot users cut into buckets."""
    d = events(spark, sf).select("user_id", "event_id", "t", *cols)
    return balance(d, EVENT_SEQ)


# The same in SQL, used as the first common table expression.
EV = """ev AS (SELECT *, CASE WHEN score >= 0.75 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH'
  WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
 FROM (SELECT event_id, user_id, event_type, value, props, ts, epoch_us(ts) / 1e6 AS t, least(value / 200.0, 1.0) AS score FROM events))"""


def rnd(c: Column | str, name: str | None = None, d: int = 9) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, d)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def orders_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Reference intervals: per customer, 30 days from each order date (in days)."""
    o = table(spark, sf, "orders")
    s = epoch_micros("o_orderdate") / F.lit(86400e6)
    return o.select(
        F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ref_id"), s.alias("ref_start"), (s + 30.0).alias("ref_end"),
        F.substring("o_orderpriority", 1, 1).alias("ref_label"), F.col("o_orderstatus").alias("status"),
    )


def ship_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted intervals: per customer, 20 days from each ship date (in days)."""
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o.hint("shuffle_hash"), li.l_orderkey == o.o_orderkey)  # orders are hashed task by task: lines are not sorted
    s = epoch_micros("l_shipdate") / F.lit(86400e6)
    return j.select(
        F.col("o_custkey").alias("cust"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pred_id"),
        s.alias("pred_start"),
        (s + 20.0).alias("pred_end"),
        (F.col("l_linenumber") % 5 + 1).cast("string").alias("pred_label"),
        (F.col("l_quantity") / 50.0).alias("pred_score"),
        F.col("l_returnflag").alias("flag"),
    )


REFS = """refs AS (SELECT o_custkey AS cust, o_orderkey AS ref_id, epoch_us(o_orderdate) / 86400e6 AS ref_start,
 epoch_us(o_orderdate) / 86400e6 + 30.0 AS ref_end, substr(o_orderpriority, 1, 1) AS ref_label, o_orderstatus AS status FROM orders)"""
PREDS = """preds AS (SELECT o_custkey AS cust, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS pred_id, epoch_us(l_shipdate) / 86400e6 AS pred_start,
 epoch_us(l_shipdate) / 86400e6 + 20.0 AS pred_end, CAST(l_linenumber % 5 + 1 AS VARCHAR) AS pred_label, l_quantity / 50.0 AS pred_score,
 l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
