"""Rule channels, fusion, interaction boosts, bands, ablation and missingness.

A channel is a column in [0, 1]. NULL means the channel is unavailable and leaves
the pool; 0.0 is evidence of nothing and stays in the denominator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.scalar import LEVELS, band, clip, clip01, level_of, rank_of, safe_div, unit_hash
from spanwise.operators.ordered import Seq
from spanwise.operators.windows import streak
from spanwise.plans.config import ABLATIONS, RULES, Ablation, FusionConfig, Interaction, RuleConfig, Scale



def scaled(x: Column, s: Scale) -> Column:
    """clip((x - threshold) / scale); null and NaN count as 0."""
    return clip01((x - max(0.0, s.threshold)) / max(s.scale, 1e-9))


def low_posture_component(frames: Column, start: float, full: float) -> Column:
    span = max(full, start + 1e-6) - start
    return F.when(frames >= start, clip01((frames - start) / span)).otherwise(F.lit(0.0))


def post_fall_component(near: Column, run_length: Column, hip: Column, head: Column, cfg: RuleConfig) -> Column:
    """Stillness once a series has been near the ground for long enough."""
    upper = max(cfg.post_fall_max_speed, 1e-9) + max(cfg.post_fall_buffer, 0.0)
    still = 1.0 - clip((F.abs(hip) + F.abs(head)) / upper)
    return F.when(near & (run_length >= cfg.post_fall_streak), clip01(still)).otherwise(F.lit(0.0))


def rule_components(df: DataFrame, cfg: RuleConfig, seq: Seq | None = None, prefix: str = "c_") -> DataFrame:
    """Add one column per rule; columns absent from ``df`` make their rules NULL.

    ``seq`` is needed for the streak of ``near_ground``. Without it every row is
    its own series, so the streak never exceeds 1.
    """
    have = set(df.columns)
    cols = [c for c in df.columns]
    near_ok = {"near_ground", "hip_vertical_velocity"} <= have
    if near_ok:
        near = F.coalesce(F.col("near_ground"), F.lit(False))
        df = streak(df, seq, near, "_streak") if seq else df.withColumn("_streak", near.cast("int"))
    num = lambda n: F.col(n).cast("double")
    torso = next((c for c in ("torso_angle_deg", "torso_angle_degrees") if c in have), None)
    head = num("head_vertical_velocity") if "head_vertical_velocity" in have else F.lit(0.0)
    c: dict[str, Column | None] = dict.fromkeys(RULES)
    if "hip_vertical_velocity" in have:
        c["fast_downward_motion"] = scaled(num("hip_vertical_velocity"), cfg.fast_downward)
    if torso:
        c["large_torso_angle"] = scaled(F.abs(num(torso)), cfg.large_torso)
    if "low_posture_duration_frames" in have:
        c["prolonged_low_posture"] = low_posture_component(
            num("low_posture_duration_frames"), cfg.low_posture_min_frames, cfg.low_posture_full_frames
        )
    if "instability_score" in have:
        c["high_instability"] = scaled(num("instability_score"), cfg.instability)
    if near_ok:
        c["post_fall_low_movement"] = post_fall_component(
            F.coalesce(F.col("near_ground"), F.lit(False)), F.col("_streak"), num("hip_vertical_velocity"), head, cfg
        )
    for rule, col, s in (
        ("low_guard", "guard_level", cfg.low_guard),
        ("facing_away", "facing_away_score", cfg.facing_away),
        ("reaction_delay_after_impact", "reaction_delay_score", cfg.reaction_delay),
        ("limb_anomaly", "anomaly_score", cfg.limb),
    ):
        if col in have:
            c[rule] = scaled(num(col), s)
    v = lambda r: F.lit(0.0) if c[r] is None else c[r]
    if c["high_instability"] is not None and (c["low_guard"] is not None or c["facing_away"] is not None):
        c["loss_of_control"] = clip01(F.sqrt(clip(F.greatest(v("low_guard"), v("facing_away")) * v("high_instability"))))
    if c["large_torso_angle"] is not None and c["fast_downward_motion"] is not None:
        c["clear_danger_fall"] = v("large_torso_angle") * v("fast_downward_motion")
    if "strike_incoming_proxy" in have and c["low_guard"] is not None:
        c["high_risk_guard_strike"] = v("low_guard") * scaled(num("strike_incoming_proxy"), cfg.incoming_strike)
    if c["post_fall_low_movement"] is not None and c["prolonged_low_posture"] is not None:
        c["intervention_urgent"] = v("post_fall_low_movement") * v("prolonged_low_posture")
    return df.select(
        *cols, *[(F.lit(None).cast("double") if c[r] is None else c[r]).alias(f"{prefix}{r}") for r in RULES]
    )


def plan_active(df: DataFrame, cfg: RuleConfig) -> set[str]:
    """Rules whose input columns exist (decided on the schema, no job)."""
    have = set(df.columns)
    torso = have & {"torso_angle_deg", "torso_angle_degrees"}
    on = set()
    for rule, need in (
        ("fast_downward_motion", {"hip_vertical_velocity"}),
        ("prolonged_low_posture", {"low_posture_duration_frames"}),
        ("high_instability", {"instability_score"}),
        ("post_fall_low_movement", {"near_ground", "hip_vertical_velocity"}),
        ("low_guard", {"guard_level"}),
        ("facing_away", {"facing_away_score"}),
        ("reaction_delay_after_impact", {"reaction_delay_score"}),
        ("limb_anomaly", {"anomaly_score"}),
    ):
        if need <= have:
            on.add(rule)
    if torso:
        on.add("large_torso_angle")
    if "high_instability" in on and on & {"low_guard", "facing_away"}:
        on.add("loss_of_control")
    if {"large_torso_angle", "fast_downward_motion"} <= on:
        on.add("clear_danger_fall")
    if "strike_incoming_proxy" in have and "low_guard" in on:
        on.add("high_risk_guard_strike")
    if {"post_fall_low_movement", "prolonged_low_posture"} <= on:
        on.add("intervention_urgent")
    return on


def renormalised_weights(weights: Mapping[str, float], active: set[str]) -> dict[str, float]:
    """Weights of active rules scaled to sum 1; none active -> equal shares."""
    kept = {k: (v if k in active else 0.0) for k, v in weights.items()}
    total = sum(kept.values())
    if total <= 0:
        return {k: 1.0 / max(len(weights), 1) for k in weights}
    return {k: v / total for k, v in kept.items()}


def triggered(channels: Mapping[str, Column], epsilon: float) -> Column:
    return F.array_compact(F.array(*[F.when(c > epsilon, F.lit(n)) for n, c in channels.items()]))


def weighted_score(channels: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = None
    for n, c in channels.items():
        t = F.lit(float(weights.get(n, 0.0))) * F.coalesce(c, F.lit(0.0))
        total = t if total is None else total + t
    return clip01(total)


def score_frames(df: DataFrame, cfg: RuleConfig, seq: Seq | None = None, components: bool = False) -> DataFrame:
    """Add ``risk_score``, ``risk_level`` and ``triggered_rules`` per row."""
    w = renormalised_weights(cfg.weights, plan_active(df, cfg))
    d = rule_components(df, cfg, seq)
    ch = {r: F.col(f"c_{r}") for r in RULES}
    d = d.withColumn("risk_score", weighted_score(ch, w))
    d = d.withColumns(
        {"risk_level": band(F.col("risk_score"), cfg.cuts), "triggered_rules": triggered(ch, cfg.trigger_epsilon)}
    )
    if "anomaly_score" in df.columns:
        d = limb_override(d, cfg.cuts)
    return d if components else d.drop(*[f"c_{r}" for r in RULES])


# Limb anomaly tiers.
LIMB_HIGH, LIMB_CRITICAL = 0.55, 0.80


def limb_override(df: DataFrame, cuts: Sequence[float], anomaly: str = "anomaly_score") -> DataFrame:
    """Raise level and score floor where the limb anomaly is high, and list the rule."""
    a = F.coalesce(F.nanvl(F.col(anomaly), F.lit(0.0)), F.lit(0.0))
    _, high, crit = cuts
    s = F.col("risk_score")
    below = rank_of(F.col("risk_level")) < LEVELS.index("HIGH")
    floor = (
        F.when(a >= LIMB_CRITICAL, F.lit(max(crit, min(0.99, crit + 0.1))))
        .when((a >= LIMB_HIGH) & below, F.lit(max(high, min(0.99, high + 0.02))))
        .when(a >= LIMB_HIGH, F.lit(max(high, min(0.99, high + 0.01))))
    )
    level = (
        F.when(a >= LIMB_CRITICAL, F.lit("CRITICAL"))
        .when((a >= LIMB_HIGH) & below, F.lit("HIGH"))
        .otherwise(F.col("risk_level"))
    )
    rules = F.when(a >= LIMB_HIGH, F.array_union("triggered_rules", F.array(F.lit("limb_anomaly")))).otherwise(
        F.col("triggered_rules")
    )
    return df.withColumns({"risk_score": clip(F.greatest(s, floor)), "risk_level": level, "triggered_rules": rules})


def surrender_override(df: DataFrame, detected: Column) -> DataFrame:
    """A detected surrender is CRITICAL with score 1 and is listed as a rule."""
    hit = F.coalesce(detected, F.lit(False))
    return df.withColumns(
        {
            "risk_score": F.when(hit, F.lit(1.0)).otherwise(F.col("risk_score")),
            "risk_level": F.when(hit, F.lit("CRITICAL")).otherwise(F.col("risk_level")),
            "triggered_rules": F.when(
                hit, F.array_union("triggered_rules", F.array(F.lit("surrender_gesture")))
            ).otherwise(F.col("triggered_rules")),
        }
    )


# ---------------------------------------------------------------- fusion (wide)


def scheme_score(channels: Mapping[str, Column], weights: Mapping[str, float], scheme: str) -> Column:
    """Pool available channels: ``equal``, ``weighted`` (reliability-discounted) or ``max``."""
    used = {n: c for n, c in channels.items() if float(weights.get(n, 0.0)) > 0}
    if not used:
        return F.lit(0.0)
    vals = {n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for n, c in used.items()}  # read only where not null
    on = {n: c.isNotNull() for n, c in used.items()}
    if scheme == "max":
        parts = [F.when(on[n], vals[n]) for n in used]
        best = parts[0] if len(parts) == 1 else F.greatest(*parts)
        return F.coalesce(best, F.lit(0.0))
    if scheme == "equal":
        w = dict.fromkeys(used, 1.0)
    elif scheme in ("weighted", "reliability_discounted"):
        w = {n: float(weights[n]) for n in used}
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    num = den = F.lit(0.0)
    for n in used:
        num = num + F.when(on[n], vals[n] * w[n]).otherwise(F.lit(0.0))
        den = den + F.when(on[n], F.lit(w[n])).otherwise(F.lit(0.0))
    return clip01(safe_div(num, den))


def rule_fires(channels: Mapping[str, Column], rule: Interaction, default: float) -> Column:
    """Every required channel is available and above the threshold (0 means the default)."""
    t = rule.threshold or default
    out = F.lit(True)
    for n in rule.required:
        out = out & (F.coalesce(channels[n] > t, F.lit(False)) if n in channels else F.lit(False))
    return out


def boosts(channels: Mapping[str, Column], cfg: FusionConfig) -> Column:
    total = F.lit(0.0)
    for r in cfg.interactions:
        total = total + F.when(rule_fires(channels, r, cfg.threshold), F.lit(r.boost)).otherwise(F.lit(0.0))
    return total


def fired_rules(channels: Mapping[str, Column], cfg: FusionConfig) -> Column:
    return F.array_compact(
        F.array(*[F.when(rule_fires(channels, r, cfg.threshold), F.lit(r.name)) for r in cfg.interactions])
    )


def fused_score(channels: Mapping[str, Column], cfg: FusionConfig, scheme: str = "weighted") -> Column:
    return clip01(scheme_score(channels, cfg.weights, scheme) + boosts(channels, cfg))


def fuse(
    df: DataFrame, channels: Mapping[str, Column], cfg: FusionConfig, scheme: str = "weighted"
) -> DataFrame:
    """Add ``pre_score``, ``boost``, ``risk_score``, ``risk_level``, ``active`` and ``fired``."""
    pre = scheme_score(channels, cfg.weights, scheme)
    d = df.withColumns({"pre_score": pre, "boost": boosts(channels, cfg), "fired": fired_rules(channels, cfg)})
    d = d.withColumn("risk_score", clip01(F.col("pre_score") + F.col("boost")))
    active = F.array_sort(triggered(channels, cfg.threshold))
    return d.withColumns({"risk_level": band(F.col("risk_score"), cfg.cuts), "active": active})


def audit(channels: Mapping[str, Column], cfg: FusionConfig) -> Column:
    """Map of what entered a fused score, as text."""
    entries = [F.lit("base_score"), F.col("pre_score").cast("string"), F.lit("fused_score"), F.col("risk_score").cast("string")]
    for n, c in channels.items():
        entries += [F.lit(f"signal.{n}"), F.concat_ws(":", c.cast("string"), F.lit(str(float(cfg.weights.get(n, 0.0)))))]
    return F.create_map(*entries)


def facts(cfg: FusionConfig) -> Column:
    """One sentence per fired rule."""
    out = F.array().cast("array<string>")
    for r in cfg.interactions:
        text = f"Interaction '{r.name}': +{r.boost:.3f}" + (f" — {r.rationale}" if r.rationale else "")
        out = F.when(F.array_contains("fired", r.name), F.array_append(out, F.lit(text))).otherwise(out)
    return out


# ---------------------------------------------------------------- fusion (long)


def signals_long(df: DataFrame, keep: Sequence[str], channels: Mapping[str, Column], cfg: FusionConfig) -> DataFrame:
    """One row per signal: name, group, confidence, weight, polarity, available."""
    items = [
        F.struct(
            F.lit(n).alias("name"),
            F.lit(cfg.groups.get(n, "biomechanics")).alias("group"),
            c.cast("double").alias("confidence"),
            F.lit(float(cfg.weights.get(n, 0.0))).alias("weight"),
            F.lit("risk_increasing").alias("polarity"),
            c.isNotNull().alias("available"),
        )
        for n, c in channels.items()
    ]
    return df.select(*keep, F.inline(F.array(*items)))


def pre_interaction_long(signals: DataFrame, keys: Sequence[str], damping: float = 0.35, scheme: str = "weighted") -> DataFrame:
    """``pre_score`` per key from long signals, damped by risk-decreasing ones."""
    conf = clip01(F.col("confidence"))
    ok = (F.col("group") != "vlm") & (F.col("weight") > 0) & F.col("available")
    inc = ok & (F.col("polarity") == "risk_increasing")
    dec = ok & (F.col("polarity") == "risk_decreasing")

    def pool(cond: Column, name: str) -> list[Column]:
        if scheme == "max":
            return [F.max(F.when(cond, conf)).alias(name)]
        w = F.lit(1.0) if scheme == "equal" else F.col("weight")
        return [F.try_divide(F.sum(F.when(cond, w * conf)), F.sum(F.when(cond, w))).alias(name)]

    agg = signals.groupBy(*keys).agg(*pool(inc, "_up"), *pool(dec, "_down"))
    up = clip01(F.col("_up"))
    down = F.least(F.lit(1.0), F.coalesce(F.col("_down"), F.lit(0.0)))
    return agg.select(*keys, clip01(up * (1.0 - damping * down)).alias("pre_score"))


def interactions_long(signals: DataFrame, keys: Sequence[str], cfg: FusionConfig) -> DataFrame:
    """Boost sum and fired rules per key from long signals."""
    aggs = [
        F.max(F.when((F.col("name") == n) & F.col("available"), clip01(F.col("confidence")))).alias(f"_s_{n}")
        for n in sorted({x for r in cfg.interactions for x in r.required})
    ]
    wide = signals.groupBy(*keys).agg(*aggs)
    ch = {n: F.col(f"_s_{n}") for r in cfg.interactions for n in r.required}
    return wide.select(*keys, boosts(ch, cfg).alias("boost"), fired_rules(ch, cfg).alias("fired"))


# ---------------------------------------------------------------- grids


def ablation_scores(
    df: DataFrame,
    keep: Sequence[str],
    channels: Mapping[str, Column],
    cfg: FusionConfig,
    modes: Sequence[Ablation] = ABLATIONS,
    scheme: str = "weighted",
) -> DataFrame:
    """Score every row under every mode in one pass: one output row per (row, mode)."""
    params = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("mode"),
                F.lit(m.interactions).alias("_int"),
                *[
                    F.lit(n not in m.dropped and (m.groups is None or cfg.groups.get(n, "biomechanics") in m.groups)).alias(f"_m_{n}")
                    for n in channels
                ],
            )
            for m in modes
        ]
    )
    base = df.select(*keep, *[c.alias(f"_c_{n}") for n, c in channels.items()])
    d = base.select("*", F.inline(params))
    d = d.select(*keep, "mode", "_int", *[F.when(F.col(f"_m_{n}"), F.col(f"_c_{n}")).alias(f"_c_{n}") for n in channels])
    ch = {n: F.col(f"_c_{n}") for n in channels}
    d = d.withColumns({"_pre": scheme_score(ch, cfg.weights, scheme), "_up": boosts(ch, cfg)})
    score = clip01(F.col("_pre") + F.when(F.col("_int"), F.col("_up")).otherwise(F.lit(0.0)))
    d = d.select(*keep, "mode", score.alias("risk_score"))
    return d.withColumn("risk_level", band(F.col("risk_score"), cfg.cuts))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores before rows are multiplied when a scan has few splits; large scans are left alone.

    For plain scans: the number of splits is read from the plan, no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Scenario(NamedTuple):
    name: str
    scheme: str = "weighted"
    interactions: bool = True
    p: float = 0.0
    seed: int = 0
    naive: bool = False


def hash_draw(*cols: Column) -> Column:
    return unit_hash(*cols)


def md5_draw(*cols: Column) -> Column:
    """Same draw in any SQL engine: the first 13 hex digits of md5 over 2^52."""
    text = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def scenario_scores(
    df: DataFrame,
    keys: Sequence[str],
    channels: Mapping[str, Column],
    cfg: FusionConfig,
    scenarios: Sequence[Scenario],
    draw=hash_draw,
) -> DataFrame:
    """Score every row under every scenario; no shuffle, no join.

    Dropout of probability ``p`` is drawn per (key, channel, seed) from a hash, so
    it does not depend on the partitioning. A dropped channel becomes unavailable,
    or zero evidence when ``naive``.
    """
    params = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(s.scheme).alias("scheme"),
                F.lit(s.interactions).alias("interactions"),
                F.lit(float(s.p)).alias("p"),
                F.lit(int(s.seed)).alias("seed"),
                F.lit(s.naive).alias("naive"),
            )
            for s in scenarios
        ]
    )
    base = df.select(*keys, *[c.alias(f"_c_{n}") for n, c in channels.items()])
    d = base.select("*", F.inline(params))
    random = any(s.p > 0 for s in scenarios)
    ch = {}
    for n in channels:
        c = F.col(f"_c_{n}")
        if random:
            hit = (F.col("p") > 0) & (draw(*[F.col(k) for k in keys], F.lit(n), F.col("seed")) < F.col("p"))
            c = F.when(hit & c.isNotNull(), F.when(F.col("naive"), F.lit(0.0))).otherwise(c)
        ch[n] = c
    d = d.select(*keys, "scenario", "scheme", "interactions", *[c.alias(f"_c_{n}") for n, c in ch.items()])
    ch = {n: F.col(f"_c_{n}") for n in channels}
    schemes = sorted({s.scheme for s in scenarios})
    score = F.lit(None).cast("double")
    for s in schemes:
        score = F.when(F.col("scheme") == s, scheme_score(ch, cfg.weights, s)).otherwise(score)
    d = d.withColumn("_pre", score)
    boost = F.when(F.col("interactions"), boosts(ch, cfg)).otherwise(F.lit(0.0))
    n_fired = F.lit(0.0).cast("int")
    for r in cfg.interactions:
        n_fired = n_fired + rule_fires(ch, r, cfg.threshold).cast("int")
    fired = F.when(F.col("interactions"), n_fired).otherwise(F.lit(0))
    d = d.select(*keys, "scenario", clip01(F.col("_pre") + boost).alias("risk_score"), fired.alias("n_fired"))
    return d.withColumn("risk_level", band(F.col("risk_score"), cfg.cuts))


def experiment_scenarios(ps=(0.0, 0.1, 0.3, 0.5), seeds=range(10)) -> list[Scenario]:
    """Three schemes, boosts on and off, and the dropout grid in both encodings."""
    out = [Scenario(s, s) for s in ("equal", "weighted", "max")]
    out += [Scenario("interactions_on"), Scenario("interactions_off", interactions=False)]
    out.append(Scenario("dropout_p0"))
    for p in ps:
        if p <= 0:
            continue
        for s in seeds:
            out.append(Scenario(f"explicit_p{p}_s{s}", p=p, seed=s))
            out.append(Scenario(f"naive_p{p}_s{s}", p=p, seed=s, naive=True))
    return out


def firing_counts(df: DataFrame, channels: Mapping[str, Column], cfg: FusionConfig, by: Sequence[str] = ()) -> DataFrame:
    """Rows on which each rule fires, and rows with any firing (rule ``__any__``)."""
    f = fired_rules(channels, cfg)
    d = df.select(*by, F.explode(F.when(F.size(f) > 0, F.array_append(f, "__any__"))).alias("rule"))
    return d.groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- other engines


def legacy_stages(rows: int = 9):
    """Rolling median ratio and velocity jerk used by :func:`legacy_score`."""
    from spanwise.operators.windows import rolling_median_col

    v, vel = F.col("keypoint_position_variance"), F.abs(F.col("hip_vertical_velocity"))
    return lambda w: {
        "_ratio": v / (rolling_median_col(v, w, rows, 2) + 1e-9),
        "_jerk": F.abs(vel - F.lag(vel, 1).over(w)),
    }


def legacy_score(df: DataFrame) -> DataFrame:
    """Three-term score from tilt x velocity, ground streak and erratic motion.

    Expects ``_ratio`` and ``_jerk`` (:func:`legacy_stages`) and ``_streak``.
    """
    # Thresholds and equal-ish weights of the three terms.
    angle_t, vel_t, angle_s, vel_s, ground_n = 28.0, 0.45, 20.0, 1.0, 20
    ratio_f, jerk_t, weights, flag_t = 2.2, 3.5, (0.34, 0.33, 0.33), 0.5
    angle, vel = F.abs(F.col("torso_angle_deg")), F.abs(F.col("hip_vertical_velocity"))
    both = F.coalesce((angle > angle_t) & (vel > vel_t), F.lit(False))
    inten = clip01((angle - angle_t) / angle_s * ((vel - vel_t) / vel_s))
    tilt = F.when(both, F.greatest(inten, F.lit(0.35))).otherwise(F.lit(0.0))
    near = F.coalesce(F.col("near_ground"), F.lit(False))
    prog = clip(F.col("_streak") / float(ground_n))
    ground = F.when(~near, F.lit(0.0)).when(F.col("_streak") > ground_n, F.lit(1.0)).otherwise(prog * prog * 0.45)
    erratic = F.greatest(
        clip01((F.col("_ratio") - 1.0) / (ratio_f - 1.0)), clip01(F.col("_jerk") / jerk_t)
    )
    tot = sum(weights)
    score = clip01(weights[0] / tot * tilt + weights[1] / tot * ground + weights[2] / tot * erratic)
    d = df.withColumns(
        {"risk_from_tilt_velocity": tilt, "risk_from_ground": ground, "risk_from_erratic": erratic, "risk_score": score}
    )
    return d.withColumn("risk_flag", F.col("risk_score") >= flag_t).drop("_ratio", "_jerk", "_streak")


def max_severity(df: DataFrame) -> DataFrame:
    """Rule bands whose highest level wins; adds ``level``, ``triggers`` and ``score``.

    Inputs (null = 0): surrender_detected, surrender_confidence, surrender_like,
    fall_any, fall_rapid, inactivity, inactivity_score, limb, hip_velocity,
    instability, turned_back, low_guard.
    """
    # Thresholds per rule band and score base per level.
    eps, surr_t, surr_like_t, inact_t, fall_inact_t, fall_t = 1e-4, 0.48, 0.46, 0.32, 0.3, 0.16
    limb_h, limb_c, rapid_t, rapid_hip_t, hip_t = 0.52, 0.78, 0.38, 0.36, 0.48
    turn_t, inst_m, inst_h, guard_t = 0.3, 0.4, 0.66, 0.3
    bases = {"LOW": 0.1, "MEDIUM": 0.4, "HIGH": 0.68, "CRITICAL": 0.86}

    def v(n: str) -> Column:
        return F.coalesce(F.col(n).cast("double"), F.lit(0.0))

    conf, like, limb = v("surrender_confidence"), F.greatest(F.lit(0.0), v("surrender_like")), F.greatest(F.lit(0.0), v("limb"))
    surr = F.coalesce(F.col("surrender_detected"), F.lit(False)) & (conf + eps >= surr_t)
    surr_any = surr | (like + eps >= surr_like_t)
    fall_strength = F.greatest(F.lit(0.0), v("fall_any"))
    fall = v("fall_any") > fall_t
    inact = F.greatest(v("inactivity"), clip(v("inactivity_score")))
    inact_hit = (inact + eps >= inact_t) | (v("inactivity") + eps >= fall_inact_t)
    down = fall & inact_hit
    limb_crit = limb + eps >= limb_c
    critical = surr_any | down | limb_crit
    hip, rapid = F.greatest(F.lit(0.0), v("hip_velocity")), v("fall_rapid")
    fast = (
        ((rapid + eps >= rapid_hip_t) & (hip + eps >= hip_t)) | (rapid + eps >= rapid_t) | ((hip + eps >= hip_t) & fall)
    )
    fall_high = fall & fast & ~critical
    limb_high = (limb >= limb_h - eps) & (limb < limb_c - eps) & ~critical
    inst, turned = clip(v("instability")), v("turned_back")
    turn = (turned + eps >= turn_t) & (inst + eps >= inst_m)
    rank = F.greatest(
        F.when(critical, 3).otherwise(0),
        F.when(fall_high | limb_high, 2).otherwise(0),
        F.when(turn, F.when(inst + eps >= inst_h, 2).otherwise(1)).otherwise(0),
    )
    guard = (v("low_guard") + eps >= guard_t) & (rank == 0)
    rank = F.when(guard, F.lit(1)).otherwise(rank)
    strength = F.greatest(
        F.when(surr_any, F.greatest(conf, like)).otherwise(F.lit(0.0)),
        F.when(down, F.least(F.lit(1.0), 0.5 * inact + 0.5 * fall_strength)).otherwise(F.lit(0.0)),
        F.when(limb_crit | limb_high, limb).otherwise(F.lit(0.0)),
        F.when(fall_high, F.greatest(rapid, F.least(F.lit(1.0), 0.35 * hip + 0.3 * rapid))).otherwise(F.lit(0.0)),
        F.when(turn, 0.5 * (turned + inst)).otherwise(F.lit(0.0)),
        F.when(guard, v("low_guard") * 0.7).otherwise(F.lit(0.0)),
    )
    fallback = F.greatest(F.lit(0.12), v("low_guard") * 0.4, limb * 0.2, fall_strength * 0.3)
    strength = clip(F.when(strength <= 0, fallback).otherwise(strength))
    names = [
        (surr, "surrender_detected_critical"),
        (surr_any & ~surr, "surrender_like_vision_critical"),
        (down, "fall_and_inactivity_critical"),
        (limb_crit, "limb_anomaly_critical"),
        (fall_high, "fall_high_downward_velocity_high"),
        (limb_high, "limb_anomaly_elevated_high"),
        (turn, "turned_back_instability_medium_or_high"),
        (guard, "low_guard_elevated_medium"),
    ]
    d = df.withColumns(
        {
            "_rank": rank,
            "_strength": strength,
            "triggers": F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in names])),
        }
    )
    d = d.withColumn("level", level_of(F.col("_rank")))
    base = F.lit(0.0)
    for k, b in bases.items():
        base = F.when(F.col("level") == k, F.lit(b)).otherwise(base)
    score = clip(base + 0.08 * (1.0 + F.col("_strength")) * (1 + F.col("_rank")))
    return d.withColumn("score", score).drop("_rank", "_strength")


def at_least(level: Column, threshold: str, names: Sequence[str] = LEVELS) -> Column:
    """Keep rows at or above a level."""
    return rank_of(level, names) >= list(names).index(threshold.upper())


# Alert level per risk level.
ALERT_LEVELS = {"LOW": "INFO", "MEDIUM": "WATCH", "HIGH": "WARNING", "CRITICAL": "STOP_RECOMMENDED"}
ALERT_TEXT = {
    "INFO": "Nothing to review.",
    "WATCH": "Keep an eye on this.",
    "WARNING": "Review this moment.",
    "STOP_RECOMMENDED": "A person should look at this now.",
}


def alert_rows(
    df: DataFrame,
    level: str = "risk_level",
    score: str = "risk_score",
    rules: str = "triggered_rules",
    facts_col: str | None = None,
    override: str | None = None,
    labels: Mapping[str, str] | None = None,
    texts: Mapping[str, str] = ALERT_TEXT,
) -> DataFrame:
    """Alert level, reason (override, first fact, else labelled rules) and a line of at most 118 characters."""
    lv = F.upper(F.trim(F.col(level)))
    lv = F.when(lv.isin(*ALERT_LEVELS), lv).otherwise(F.lit("LOW"))
    alert = F.lit(None).cast("string")
    text = F.lit("")
    for k, a in ALERT_LEVELS.items():
        alert = F.when(lv == k, F.lit(a)).otherwise(alert)
        text = F.when(lv == k, F.lit(texts[a])).otherwise(text)

    def named(r: Column) -> Column:
        out = r
        for k, v in (labels or {}).items():
            out = F.when(r == k, F.lit(v)).otherwise(out)
        return F.concat(r, F.lit(" — "), out)

    def cut(c: Column) -> Column:
        return F.nullif(F.substring(F.trim(c), 1, 2000), F.lit(""))

    joined = F.when(F.size(rules) > 0, F.array_join(F.transform(F.col(rules), named), " | "))
    choices = [cut(F.col(override))] if override else []
    if facts_col:
        choices.append(cut(F.get(F.col(facts_col), F.lit(0))))
    reason = F.coalesce(*choices, joined, F.lit("No rule above the reporting threshold."))
    s = F.coalesce(F.concat(F.lit(" s="), F.format_string("%.2f", F.col(score).cast("double"))), F.lit(""))
    line = F.concat(text, F.lit(" (band "), lv, s, F.lit(")"))
    line = F.when(F.length(line) > 118, F.concat(F.substring(line, 1, 115), F.lit("..."))).otherwise(line)
    return df.withColumns({"alert_level": alert, "reason": reason, "message": line})
