"""Checks and validation as DataFrames: one row per check, or one row per violation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.scalar import LEVELS
from spanwise.operators.ordered import Scan, Seq, scan


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from the schema (no job)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def _check(name: str, bad: Column, message: Column | None = None, warn: bool = False) -> list[Column]:
    status = F.when(bad > 0, F.lit("warn" if warn else "fail")).otherwise(F.lit("pass"))
    text = message if message is not None else F.format_string("%d rows", bad)
    return [F.lit(name).alias("name"), status.alias("status"), F.coalesce(text, F.lit("")).alias("message")]


def check_score_range(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows outside [0, 1] fail; missing scores pass here and are counted as ``n_null``."""
    s = F.col(score)
    a = df.groupBy(*by).agg(F.count_if(~F.isnan(s) & ((s < 0) | (s > 1))).alias("n_bad"), F.count_if(s.isNull() | F.isnan(s)).alias("n_null"))
    return a.select(*by, *_check("score_range", F.col("n_bad")), "n_bad", "n_null")


def check_levels(df: DataFrame, level: str, allowed: Sequence[str] = LEVELS, by: Sequence[str] = ()) -> DataFrame:
    """Values not in the allowed set, with counts (anti-join form of the check)."""
    bad = df.filter(~F.coalesce(F.upper(F.trim(F.col(level))).isin(*allowed), F.lit(False)))
    return bad.groupBy(*by, level).agg(F.count(F.lit(1)).alias("n"))


def check_monotonic(df: DataFrame, seq: Seq, t: str, eps: float = 1e-9) -> DataFrame:
    """Backward steps of ``t`` in row order, per series."""
    d = scan(df, seq, _p=Scan("last", F.struct(F.col(t).alias("v")), exclusive=True))
    bad = F.col(t) - F.col("_p")["v"] < -eps
    return d.groupBy(*seq.keys).agg(F.count_if(bad).alias("n_bad")).select(*seq.keys, *_check("monotonic_time", F.col("n_bad")), "n_bad")


def check_event_order(df: DataFrame, start: str, end: str, by: Sequence[str] = (), example: str | None = None) -> DataFrame:
    """Start before end, both present and finite; up to six examples by id."""
    s, e = F.col(start), F.col(end)
    ok = s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e) & (s < e)
    aggs = [F.count_if(~ok).alias("n_bad")]
    if example:
        w = Window.partitionBy(*by).orderBy(example) if by else None
        bad = df.filter(~ok)
        top = bad.orderBy(example).limit(6) if w is None else bad.withColumn("_k", F.row_number().over(w)).filter("_k <= 6")
        ex = top.groupBy(*by).agg(F.array_sort(F.collect_list(example)).alias("examples"))
        a = df.groupBy(*by).agg(*aggs)
        a = a.join(ex, list(by), "left") if by else a.withColumn("_o", F.lit(1)).join(ex.withColumn("_o", F.lit(1)), "_o", "left").drop("_o")
        return a.select(*by, *_check("event_order", F.col("n_bad")), "n_bad", "examples")
    return df.groupBy(*by).agg(*aggs).select(*by, *_check("event_order", F.col("n_bad")), "n_bad")


def check_constant(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Warn when a run has at most one distinct score (two-level count: min = max)."""
    a = df.groupBy(*by).agg(F.min(score).alias("_a"), F.max(score).alias("_b"))
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(True)).cast("int")
    return a.select(*by, *_check("constant_score", same, F.when(same == 1, "score never changes").otherwise("score varies"), warn=True))


def coverage_status(pct: Column, ok: float = 80.0, low: float = 50.0) -> Column:
    """pass / warn / fail ladder; missing coverage warns."""
    return F.when(pct.isNull(), "warn").when(pct >= ok, "pass").when(pct >= low, "warn").otherwise("fail")


def quality_report(checks: Sequence[DataFrame], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All check rows and, per run, whether none failed."""
    rows = reduce(DataFrame.unionByName, [c.select(*by, "name", "status", "message") for c in checks])
    return rows, rows.groupBy(*by).agg(F.bool_and(F.col("status") != "fail").alias("passed"), F.count_if(F.col("status") == "warn").alias("n_warn"))


def interval_violations(
    df: DataFrame,
    keep: Sequence[str],
    start: str,
    end: str,
    label: str | None = None,
    labels: Sequence[str] = (),
    confidence: str | None = None,
    required: Sequence[str] = (),
    clip: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per broken rule: bounds finite, start >= 0, end > start, label, confidence, ids, clip bounds."""
    s, e = F.col(start), F.col(end)
    fin = s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e) & (F.abs(s) < float("inf")) & (F.abs(e) < float("inf"))
    rules = [(~fin, "times_not_finite"), (fin & (s < 0), "start_negative"), (fin & (e <= s), "end_not_after_start")]
    if label:
        rules.append((~F.coalesce(F.col(label).isin(*labels), F.lit(False)), "unknown_label"))
    if confidence:
        c = F.col(confidence)
        rules.append((c.isNotNull() & ~c.between(0.0, 1.0), "confidence_out_of_range"))
    rules += [(F.coalesce(F.length(F.trim(F.col(c).cast("string"))), F.lit(0)) == 0, f"empty_{c}") for c in required]
    if clip:
        lo, hi = F.col(clip[0]), F.col(clip[1])
        rules += [(s < lo, "before_clip"), (e > hi, "after_clip")]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for bad, n in rules]))
    return df.select(*keep, F.explode(found).alias("violation"))


def sheet_issues(df: DataFrame, source: str, row: str, checks: Mapping[str, Column]) -> DataFrame:
    """Row issues with file and row number; any issue should block a build."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.select(source, row, F.explode(found).alias("issue"))


def assign_event_ids(df: DataFrame, video: str, start: str, end: str, tie: str, width: float) -> DataFrame:
    """``<video>_e0001`` in (start, end, tie) order per video."""
    d = scan(df, Seq((video,), (start, end, tie), width), index="_k")
    return d.withColumn("event_id", F.format_string("%s_e%04d", F.col(video).cast("string"), F.col("_k") + 1)).drop("_k")


# Legacy annotation states.
STATUS = {"verified": "visually_confirmed", "confirmed": "visually_confirmed", "visually_confirmed": "visually_confirmed", "draft": "draft", "pending": "draft"}


def annotation_gate(df: DataFrame, status: str) -> DataFrame:
    """Normalised status and whether metrics built on it are only diagnostic."""
    norm = F.lit("draft")
    for k, v in STATUS.items():
        norm = F.when(F.lower(F.trim(F.col(status))) == k, F.lit(v)).otherwise(norm)
    return df.withColumn("annotation_status", norm).withColumn("diagnostic_only", F.col("annotation_status") != "visually_confirmed")


def file_digests(df: DataFrame) -> DataFrame:
    """Path, length and SHA-256 of a ``binaryFile`` scan."""
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"))


def compare_manifest(got: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """ok, mismatch, missing or unlisted per file (full outer join)."""
    g = got.select(key, F.col("sha256").alias("_g"))
    m = manifest.select(key, F.col("sha256").alias("_m"))
    j = g.join(m, key, "full_outer")
    s = F.when(F.col("_g").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(F.col("_g") == F.col("_m"), "ok").otherwise("mismatch")
    return j.select(key, s.alias("status"))


def missing_artifacts(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected outputs that are absent or empty."""
    return expected.join(found.filter(F.col("length") > 0), list(keys), "left_anti")


def sheet_profile(df: DataFrame, source: str, valid: Column, first: str) -> DataFrame:
    """Per file: rows, valid rows and the first valid value."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid"), F.min(F.when(valid, F.col(first))).alias("first_valid"))
