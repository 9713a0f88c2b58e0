"""Windowed signals over ordered series.

``*_col`` builders return a column for a window produced by
:func:`spanwise.operators.ordered.chunk_window`, so that many features share one
pass through :func:`features`. Series ends are found from the dense index and not
from a null neighbour: a missing neighbour must give a missing result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spanwise.functions.scalar import clip
from spanwise.operators.ordered import START, Scan, Seq, chunk_window, core, exact_percentile, framed, runs, scan

Stage = Callable[[WindowSpec], Mapping[str, Column]]


def features(
    df: DataFrame,
    seq: Seq,
    before: int,
    after: int,
    *stages: Stage,
    index: str | None = None,
    total: str | None = None,
    keep: bool = False,
) -> DataFrame:
    """Add columns built by ``stages`` (each may use the columns of earlier ones).

    ``before``/``after`` are the total reach in rows of all stages together.
    """
    d = framed(df, seq, before, after, index=index, total=total)
    w = chunk_window(seq)
    for stage in stages:
        d = d.withColumns(dict(stage(w)))
    d = core(d)
    return d if keep else d.drop("_i", "_n")


def is_first() -> Column:
    return F.col("_i") == 0


def is_last() -> Column:
    return F.col("_i") == F.col("_n") - 1


def central_gradient_col(x: Column, w: WindowSpec, dt: float, single: float | None = 0.0) -> Column:
    """Central difference inside, one-sided at the ends, ``single`` for one row."""
    nxt, prv = F.lead(x, 1).over(w), F.lag(x, 1).over(w)
    return (
        F.when(F.col("_n") == 1, F.lit(single).cast("double"))
        .when(is_first(), (nxt - x) / dt)
        .when(is_last(), (x - prv) / dt)
        .otherwise((nxt - prv) / (2.0 * dt))
    )


def rolling_col(fn: Callable[[Column], Column], x: Column, w: WindowSpec, rows: int, min_periods: int = 1) -> Column:
    f = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(f) >= min_periods, fn(x).over(f))


def rolling_std_col(x: Column, w: WindowSpec, rows: int, min_periods: int = 1) -> Column:
    """Sample deviation; one observation gives null."""
    return rolling_col(F.stddev_samp, x, w, rows, max(2, min_periods))


def rolling_median_col(x: Column, w: WindowSpec, rows: int, min_periods: int = 1) -> Column:
    return rolling_col(lambda c: F.percentile(c, F.lit(0.5)), x, w, rows, min_periods)


def instability_col(xs: Sequence[Column], w: WindowSpec, rows: int, min_periods: int = 1) -> Column:
    """Mean of the rolling sample deviations, null when one of them is."""
    total = None
    for x in xs:
        d = rolling_std_col(x, w, rows, min_periods)
        total = d if total is None else total + d
    return total / float(len(xs))


def mean_variance_col(xs: Sequence[Column], w: WindowSpec, rows: int) -> Column:
    """Sum of rolling sample variances over the number of series; any null -> null."""
    total = None
    for x in xs:
        v = rolling_col(F.var_samp, x, w, rows, 2)
        total = v if total is None else total + v
    return total / float(len(xs))


def edge_smooth_col(x: Column, w: WindowSpec, rows: int) -> Column:
    """Centred mean over an odd number of rows with the end values repeated.

    Needs ``rows // 2`` rows of reach on both sides.
    """
    if rows % 2 == 0:
        raise ValueError("an even window would change the length; use an odd one")
    if rows <= 1:
        return x
    half = rows // 2
    left = F.first_value(x).over(w.rowsBetween(-half, 0))
    right = F.last_value(x).over(w.rowsBetween(0, half))
    total = x
    for k in range(1, half + 1):
        total = total + F.when(F.col("_i") >= k, F.lag(x, k).over(w)).otherwise(left)
        total = total + F.when(F.col("_i") + k < F.col("_n"), F.lead(x, k).over(w)).otherwise(right)
    return total / float(rows)


def second_difference_col(x: Column, w: WindowSpec, fps: float) -> Column:
    d = (F.lead(x, 1).over(w) - 2.0 * x + F.lag(x, 1).over(w)) * float(fps) ** 2
    return F.when(is_first() | is_last(), F.lit(0.0)).otherwise(d)


def local_max_col(x: Column, w: WindowSpec, min_height: Column) -> Column:
    """At least ``min_height`` and not below either neighbour; ends are never peaks."""
    peak = (x >= min_height) & (x >= F.lag(x, 1).over(w)) & (x >= F.lead(x, 1).over(w))
    return F.coalesce(peak & ~is_first() & ~is_last(), F.lit(False))


def step_col(x: Column, y: Column, w: WindowSpec) -> Column:
    """Distance to the previous row's point, null when either is missing."""
    return F.hypot(x - F.lag(x, 1).over(w), y - F.lag(y, 1).over(w))


def reaction_delay_cols(
    hip_vel: Column,
    head_vel: Column,
    w: WindowSpec,
    dt: float,
    jerk_threshold: float = 1.15,
    lookback: int = 18,
    still_ref: float = 0.14,
) -> tuple[Stage, Stage]:
    """Two stages: jerk, then stillness after a recent jerk peak (reach ``lookback``)."""

    def first(ww: WindowSpec) -> dict[str, Column]:
        j = F.abs(hip_vel - F.lag(hip_vel, 1).over(ww)) / max(dt, 1e-9)
        return {"_jerk": F.when(is_first(), F.lit(0.0)).otherwise(F.coalesce(j, F.lit(0.0)))}

    def second(ww: WindowSpec) -> dict[str, Column]:
        recent = F.max("_jerk").over(ww.rowsBetween(-(lookback - 1), 0)) > jerk_threshold
        still = 1.0 - clip((F.abs(hip_vel) + F.abs(head_vel)) * 0.5 / still_ref)
        return {"reaction_delay_score": F.when(recent & hip_vel.isNotNull() & head_vel.isNotNull(), still).otherwise(0.0)}

    return first, second


def streak(df: DataFrame, seq: Seq, flag: Column, name: str = "streak") -> DataFrame:
    """Length of the current run of ``flag``; 0 where it does not hold."""
    d = runs(df, seq, flag, gap=1, index="_si", run="_sr")
    n = F.when(F.col("_sr_flag"), F.col("_si") - F.col("_sr") + 1).otherwise(F.lit(0))
    return d.withColumn(name, n.cast("long")).drop("_si", "_sr", "_sr_flag")


def cumulative(df: DataFrame, seq: Seq, amount: Column, name: str) -> DataFrame:
    return scan(df, seq, **{name: Scan("sum", amount)})


def trailing_time(
    df: DataFrame,
    seq: Seq,
    seconds: float,
    build: Callable[[WindowSpec], Mapping[str, Column]],
) -> DataFrame:
    """Frames bounded by time: rows within ``seconds`` before each row, inclusive.

    ``order[0]`` holds seconds; rows are copied forward into the buckets whose
    frames reach them, so each (key, bucket) is complete.
    """
    home = F.floor(F.col(seq.order[0]) / float(seq.width)).cast("long")
    reach = F.floor((F.col(seq.order[0]) + float(seconds)) / float(seq.width)).cast("long")
    d = df.withColumn("_c", F.explode(F.sequence(home, reach))).withColumn("_core", F.col("_c") == home)
    d = d.withColumn("_us", F.round(F.col(seq.order[0]) * 1e6).cast("long"))
    w = Window.partitionBy(*seq.keys, "_c").orderBy("_us").rangeBetween(-round(seconds * 1e6), 0)
    return core(d.withColumns(dict(build(w))), "_us")


def ema(df: DataFrame, seq: Seq, x: str, alpha: float, name: str = "ema") -> DataFrame:
    """Exponential mean: the first value seeds, then a*x + (1-a)*previous.

    Rows are cut into blocks short enough that the decay over one block stays in
    double range; inside a block the recurrence is a weighted running sum. A block
    receives the end values of the two before it (older ones decay below 1e-200).
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1:
        return df.withColumn(name, F.col(x))
    decay = 1.0 - alpha
    block = max(2, int(500.0 / -math.log(decay)))
    keys = list(seq.keys)
    d = scan(df, seq, index="_i")
    # blocks are needed for the number range in any case, so they also bound the rows per task
    d = d.withColumn("_k", F.floor(F.col("_i") / block).cast("long")).withColumn("_p", (F.col("_i") % block) + 1)
    gain = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    term = gain * F.col(x) * F.pow(F.lit(decay), -F.col("_p"))
    w = Window.partitionBy(*keys, "_k").orderBy("_i").rowsBetween(START, 0)
    d = d.withColumn("_loc", F.sum(term).over(w) * F.pow(F.lit(decay), F.col("_p")))
    ends = d.groupBy(*keys, "_k").agg(F.max_by("_loc", "_i").alias("_e1"))
    last = ends.select(*keys, (F.col("_k") + 1).alias("_k"), "_e1")
    prev = ends.select(*keys, (F.col("_k") + 2).alias("_k"), F.col("_e1").alias("_e2"))
    d = d.join(last, [*keys, "_k"], "left").join(prev, [*keys, "_k"], "left")
    carry = F.coalesce("_e1", F.lit(0.0)) + F.coalesce("_e2", F.lit(0.0)) * decay**block
    return d.select(*df.columns, (F.col("_loc") + carry * F.pow(F.lit(decay), F.col("_p"))).alias(name))


def interpolate_at(samples: DataFrame, queries: DataFrame, seq: Seq, value: str, name: str = "value") -> DataFrame:
    """Linear interpolation of ``value`` at query times, clamped to the series ends.

    Both inputs carry ``seq.keys`` and ``seq.order[0]``; extra query columns are kept.
    """
    t = seq.order[0]
    keys = list(seq.keys)
    extra = [c for c in queries.columns if c not in (*keys, t)]
    pt = F.struct(F.col(t).alias("t"), F.col(value).alias("y"))
    s = samples.select(*keys, t, F.lit(0).alias("_q"), pt.alias("_pt"), F.lit(None).cast(queries.select(F.struct(*(extra or [t])).alias("x")).schema["x"].dataType).alias("_x"))
    q = queries.select(*keys, t, F.lit(1).alias("_q"), F.lit(None).cast(s.schema["_pt"].dataType).alias("_pt"), F.struct(*(extra or [t])).alias("_x"))
    both = s.unionByName(q)
    sq = Seq(seq.keys, (t, "_q"), seq.width, seq.chunk)
    d = scan(both, sq, _lo=Scan("last", F.col("_pt")), _hi=Scan("last", F.col("_pt"), reverse=True)).filter("_q = 1")
    lo, hi = F.col("_lo"), F.col("_hi")
    span = hi["t"] - lo["t"]
    y = (
        F.when(lo.isNull(), hi["y"])
        .when(hi.isNull() | (span <= 0), lo["y"])
        .otherwise(lo["y"] + (hi["y"] - lo["y"]) * (F.col(t) - lo["t"]) / span)
    )
    return d.select(*keys, t, *[F.col("_x")[c].alias(c) for c in extra], y.alias(name))


def percentile_gate(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, floor: float = 0.0) -> DataFrame:
    """Exact percentile of finite values per key, 0 without any, floored; one row per key."""
    p = exact_percentile(df, keys, value, q, name)
    base = df.select(*keys).distinct().join(p, list(keys), "left")
    return base.withColumn(name, F.greatest(F.coalesce(name, F.lit(0.0)), F.lit(float(floor))))


def knee_stress_col(deg: Column) -> Column:
    """Stress of a knee that is almost straight or bent very deep; missing -> 0."""
    return F.coalesce(F.greatest(clip((5.0 - deg) / 5.0), clip((deg - 100.0) / 45.0)), F.lit(0.0))


def _stress(deg: Column) -> Column:
    return F.when(deg.isNotNull(), knee_stress_col(deg)).otherwise(F.lit(0.0))


def leg_collapse_col(knee_l: Column, knee_r: Column, ankle_y: Column, w: WindowSpec, fps: float) -> Column:
    """Sudden knee change and downward ankle speed; a missing step counts as 0."""
    change = F.greatest(
        F.coalesce(F.abs(knee_l - F.lag(knee_l, 1).over(w)), F.lit(0.0)),
        F.coalesce(F.abs(knee_r - F.lag(knee_r, 1).over(w)), F.lit(0.0)),
    )
    fall = F.coalesce(clip((ankle_y - F.lag(ankle_y, 1).over(w)) * float(fps) / 0.5), F.lit(0.0))
    return clip(0.55 * clip(change / 25.0) + 0.45 * fall)


def limb_stages(
    fps: float,
    knee_l: str = "knee_flexion_left_deg",
    knee_r: str = "knee_flexion_right_deg",
    ankle_y: str = "ankle_y_min",
) -> tuple[Stage, Stage]:
    """Stages adding ``anomaly_score`` and ``anomaly_type`` (reach one row back)."""
    kl, kr, ay = F.col(knee_l), F.col(knee_r), F.col(ankle_y)
    sl, sr = _stress(kl), _stress(kr)
    asym = F.coalesce(clip(F.abs(kl - kr) / 40.0), F.lit(0.0))
    asym = F.when(kl.isNotNull() & kr.isNotNull(), asym).otherwise(F.lit(0.0))

    def first(w: WindowSpec) -> dict[str, Column]:
        return {"_collapse": leg_collapse_col(kl, kr, ay, w, fps)}

    def second(w: WindowSpec) -> dict[str, Column]:
        score = clip(0.3 * F.greatest(sl, sr) + 0.3 * asym + 0.4 * F.col("_collapse"))
        kind = (
            F.when(F.col("_collapse") > 0.5, "sudden_leg_collapse")
            .when(asym > 0.5, "bilateral_leg_asymmetry")
            .when(F.greatest(sl, sr) > 0.45, "extreme_knee_configuration")
            .when(score > 0.2, "combined_limb_stress")
            .otherwise("none")
        )
        return {"anomaly_score": score, "anomaly_type": kind}

    return first, second
