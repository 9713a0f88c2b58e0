"""Run tables: upsert, lifecycle, ordered reads, set operations and text rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions.scalar import clean, slug

STAR = {
    "projects": "project_id bigint, name string, created_at timestamp",
    "videos": "video_id bigint, project_id bigint, path string, metadata string",
    "runs": "run_id bigint, project_id bigint, video_id bigint, mode string, status string, config string, started_at timestamp, finished_at timestamp",
    "parameters": "run_id bigint, key string, value string, value_type string",
    "events": "run_id bigint, event_key string, event_type string, category string, level string, title string, start_time double, end_time double, score double, payload string",
    "timeline_points": "run_id bigint, timestamp double, frame_index bigint, risk_score double, risk_level string",
    "evaluations": "run_id bigint, name string, metrics string",
    "artifacts": "run_id bigint, kind string, path string",
    "feedback": "event_key string, feedback_type string, note string, payload string",
}


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str, nullable: str | None = None) -> DataFrame:
    """Latest row per key by ``seq``; rows whose ``nullable`` key is null are always kept.

    An aggregate, not a window: versions of a hot key combine before the shuffle.
    """
    both = old.unionByName(new, allowMissingColumns=True)
    key_ok = F.col(nullable).isNotNull() if nullable else F.lit(True)
    rest = [c for c in both.columns if c not in keys]
    latest = both.filter(key_ok).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")
    return latest.select(*both.columns).unionByName(both.filter(~key_ok)) if nullable else latest.select(*both.columns)


def list_events(df: DataFrame, start: str, tie: str, where: Column | None = None) -> DataFrame:
    """All events (of a run, with ``where``) by start time, missing times first, then id."""
    d = df if where is None else df.filter(where)
    return d.orderBy(F.col(start).asc_nulls_first(), tie)


def list_runs(df: DataFrame, started: str, key: str, limit: int = 200) -> DataFrame:
    """The newest runs by start time, a report of ``limit`` rows; equal times by key."""
    return df.orderBy(F.desc_nulls_last(started), F.desc(key)).limit(limit)


def list_timeline(df: DataFrame, frame: str, tie: str, limit: int = 50_000) -> DataFrame:
    """Timeline points in frame order, at most ``limit`` for one page."""
    return df.orderBy(F.col(frame).asc_nulls_first(), tie).limit(limit)


def find_or_create(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows to insert: wanted keys that do not exist yet."""
    return wanted.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def finish_runs(runs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Status and end time of finished runs replaced, others unchanged."""
    d = done.select(key, F.col("status").alias("_s"), F.col("finished_at").alias("_f"))
    j = runs.join(d, key, "left")
    return j.withColumns({"status": F.coalesce("_s", "status"), "finished_at": F.coalesce("_f", "finished_at")}).drop("_s", "_f")


def attach(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows linked to a known parent; others are skipped."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def union_legs(*legs: tuple[str, DataFrame]) -> DataFrame:
    """UNION ALL with a ``leg`` column; absent columns become null."""
    tagged = [d.withColumn("leg", F.lit(n)) for n, d in legs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def label_union(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).union(b.select(col)).distinct()


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_from(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def dedupe_events(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], digits: int = 2) -> DataFrame:
    """First event per (keys, rounded bounds)."""
    d = df.withColumns({"_s": F.round(start, digits), "_e": F.round(end, digits)})
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return d.groupBy(*keys, "_s", "_e").agg(best).select(*keys, "_r.*").select(*df.columns)


def unique_labels(names: Sequence[str]) -> list[str]:
    """Slugged column labels made unique with a numeric suffix (schema names only)."""
    import re

    seen: dict[str, int] = {}
    out = []
    for n in names:
        base = re.sub(r"[^a-z0-9]+", "_", n.strip().lower()).strip("_") or "col"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every double column, also inside arrays and structs."""

    def fix(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return clean(c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: fix(x, t.elementType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fix(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda k, v: fix(v, t.valueType))
        return c

    return df.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def explanation(level: Column, kind: Column, start: Column, end: Column, score: Column) -> Column:
    """Deterministic sentence for an event."""
    return F.format_string("%s event (%s) from %.2f s to %.2f s, peak score %.2f. Needs human review.", level, kind, start, end, score)


def evidence_text(evidence: Column, kind: Column, limit: int = 900) -> Column:
    """``kind: key=value; ...`` with keys in order, cut to ``limit`` characters."""
    pairs = F.transform(F.array_sort(F.map_entries(evidence)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.substring(F.concat(kind, F.lit(": "), F.array_join(pairs, "; ")), 1, limit)
