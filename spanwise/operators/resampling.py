"""Resampling statistics over per-video values.

Replicates are made by exploding a number range next to each value; no pairs of data
rows are formed. Draws come from hashes and do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.scalar import unit_hash
from spanwise.operators.ordered import exact_percentile


def bootstrap_ci(df: DataFrame, keys: Sequence[str], index: str, value: str, reps: int = 1000, seed: int = 20260730) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of resampled means per key.

    ``index`` is dense from 0 within a key. Each replicate draws as many indices as the
    key has values; equal draws are counted first, so the join is on (key, index).
    """
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("mean"))
    draws = df.select(*keys, F.col(index).alias("_d")).join(n, keys)
    draws = draws.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    pick = F.floor(unit_hash(*[F.col(k) for k in keys], F.col("_d"), F.col("_b"), F.lit(seed)) * F.col("_n")).cast("long")
    counts = draws.select(*keys, "_b", pick.alias(index)).groupBy(*keys, index, "_b").agg(F.count(F.lit(1)).alias("_m"))
    j = counts.join(df.select(*keys, F.col(index).cast("long").alias(index), value), [*keys, index])
    means = j.groupBy(*keys, "_b").agg((F.sum(F.col("_m") * F.col(value)) / F.sum("_m")).alias("_x"))
    lo = exact_percentile(means, keys, "_x", 0.025, "ci_low")
    hi = exact_percentile(means, keys, "_x", 0.975, "ci_high")
    return n.drop("_n").join(lo, keys).join(hi, keys)


def paired_permutation_exact(df: DataFrame, keys: Sequence[str], index: str, diff: str, n: int) -> DataFrame:
    """Two-sided sign-flip p by full enumeration of 2^n sign patterns; ``index`` is 0..n-1."""
    if n > 20:
        raise ValueError("too many pairs to enumerate; use sampled signs")
    keys = list(keys)
    pat = df.select(*keys, F.col(index).cast("int").alias("_k"), F.col(diff).alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))).alias("_p"))
    sign = F.when(F.expr("bit_get(_p, _k)") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    sums = pat.groupBy(*keys, "_p").agg(F.abs(F.sum(sign * F.col("_d"))).alias("_s"))
    obs = df.groupBy(*keys).agg(F.abs(F.sum(diff)).alias("_o"), F.count(F.lit(1)).alias("n"))
    hit = F.col("_s") >= F.col("_o") - 1e-12
    return sums.join(obs, keys).groupBy(*keys, "n").agg(F.avg(hit.cast("double")).alias("p_value"))


def paired_permutation_sampled(df: DataFrame, keys: Sequence[str], index: str, diff: str, reps: int = 5000, seed: int = 20260730) -> DataFrame:
    """(hits + 1) / (reps + 1) with hashed random signs."""
    keys = list(keys)
    d = df.select(*keys, index, F.col(diff).alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_p"))
    sign = F.when(unit_hash(*[F.col(k) for k in keys], F.col(index), F.col("_p"), F.lit(seed)) < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))
    sums = d.groupBy(*keys, "_p").agg(F.abs(F.sum(sign * F.col("_d"))).alias("_s"))
    obs = df.groupBy(*keys).agg(F.abs(F.sum(diff)).alias("_o"), F.count(F.lit(1)).alias("n"))
    hit = F.count_if(F.col("_s") >= F.col("_o") - 1e-12)
    return sums.join(obs, keys).groupBy(*keys, "n").agg(((hit + 1) / F.lit(reps + 1.0)).alias("p_value"))


def cliffs_delta(diff: str):
    """Share of positive minus share of negative paired differences."""
    d = F.col(diff)
    return F.avg(F.when(d > 0, 1.0).when(d < 0, -1.0).otherwise(0.0))


def paired_comparison(a: DataFrame, b: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Inner join by video: mean and median difference, Cliff's delta, pairs."""
    j = a.select(*by, key, F.col(value).alias("_a")).join(b.select(*by, key, F.col(value).alias("_b")), [*by, key])
    d = j.withColumn("_d", F.col("_a") - F.col("_b"))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.percentile("_d", F.lit(0.5)).alias("median_diff"), cliffs_delta("_d").alias("delta")
    )


def dropout_trend(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation over seeds."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).alias("std"), F.count(value).alias("n_seeds"))
