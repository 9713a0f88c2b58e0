"""Sinks: scored frames, features, episodes, metrics and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.operators.store import json_safe


def write_frames(df: DataFrame, path: str, partition: Sequence[str] = ("video_id",), mode: str = "overwrite") -> None:
    """Partitioned parquet; readers prune by partition."""
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def csv_view(df: DataFrame, lists: Sequence[str] = ("triggered_rules",)) -> DataFrame:
    """List columns as JSON text."""
    return df.withColumns({c: F.to_json(F.col(c)) for c in lists if c in df.columns})


def json_view(df: DataFrame) -> DataFrame:
    return json_safe(df)


def episode_rows(df: DataFrame) -> DataFrame:
    """Ten fixed columns; the timestamp is the last-seen time, the duration has four digits."""
    dur = F.round(F.col("last_seen") - F.col("start_time"), 4)
    return df.select(
        "event_id", "event_type", "start_time", F.col("last_seen").alias("end_time"), F.col("last_seen").alias("timestamp"), "level", "category", dur.alias("duration"), "finished", "description"
    )


def episode_envelope(df: DataFrame, keys: Sequence[str], settings: Column) -> DataFrame:
    """One JSON document per run: bus settings and its episodes (a report format; one run per document)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.to_json(F.struct(settings.alias("settings"), F.array_sort(F.collect_list(F.struct(*rest))).alias("events"))).alias("document"))


def metric_rows(per_item: DataFrame, pooled: DataFrame, macro: DataFrame, item: str) -> DataFrame:
    """Per-item rows and the ``micro`` / ``macro`` pseudo-rows in one table."""
    a = per_item.unionByName(pooled.withColumn(item, F.lit("micro")), allowMissingColumns=True)
    return a.unionByName(macro.withColumn(item, F.lit("macro")), allowMissingColumns=True)


def write_star(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Run tables as parquet; run tables are partitioned by run."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        (w.partitionBy("run_id") if "run_id" in df.columns and name != "runs" else w).parquet(f"{path}/{name}")
