"""Candidate detectors composed from geometry, windows, percentiles and intervals.

Every detector reads wide poses with keys, a dense frame index ``i`` and its total
``n``; frames are windowed in chunks, per-video thresholds are exact percentiles, and
what follows works on peaks or intervals only. Frames are checkpointed once where
several thresholds are read from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from spanwise.functions import geometry as g
from spanwise.functions.scalar import band, clip, clip01, safe_div
from spanwise.operators import windows as wn
from spanwise.operators.chain import cut
from spanwise.operators.intervals import REACH, padded_segments, peak_clusters, points_in_intervals, segments
from spanwise.operators.ordered import Seq, exact_percentile, percentiles, scan


def index_frames(df: DataFrame, seq: Seq) -> tuple[DataFrame, Seq]:
    """Add the dense frame index ``i`` and the frame count ``n``; the result is ordered by ``i``."""
    d = scan(df, seq, index="i", total="n")
    return d, Seq(seq.keys, ("i",), float(seq.chunk), seq.chunk, None, seq.whole)


def _frames(df: DataFrame, seq: Seq, before: int, after: int, *stages) -> DataFrame:
    return wn.features(df, seq, before, after, *stages, index="i", total="n")


def early_reference(df: DataFrame, seq: Seq, value: str, first: int, name: str, index: str | None = None) -> DataFrame:
    """75th percentile of the first rows, else the 90th of all, else 1; one row per series."""
    keys = list(seq.keys)
    d = df if index else scan(df.select(*keys, *seq.order, value, *([seq.bucket] if seq.bucket else [])), seq, index="_i")
    d = d.withColumn("_early", F.when(F.col(index or "_i") < first, F.col(value)))
    p = percentiles(d, keys, {"_p75": ("_early", 0.75), "_p90": (value, 0.9)}, whole=seq.whole)
    ok = lambda c: F.when(F.col(c) > 1e-6, F.col(c))
    return p.select(*keys, F.coalesce(ok("_p75"), ok("_p90"), F.lit(1.0)).alias(name))


def joint_speed(w: WindowSpec, joints: Sequence[int], fps: float, how: str = "max", prefix: str = "j") -> Column:
    """Maximum or mean joint speed between frames; joints missing on either side are skipped, 0 without any."""
    steps = []
    for k in joints:
        p = g.joint(k, prefix)
        steps.append(F.hypot(p.x - F.lag(p.x, 1).over(w), p.y - F.lag(p.y, 1).over(w)) * float(fps))
    if how == "max":
        best = steps[0] if len(steps) == 1 else F.greatest(*steps)
        return F.coalesce(best, F.lit(0.0))
    total, count = F.lit(0.0), F.lit(0)
    for s in steps:
        total = total + F.coalesce(s, F.lit(0.0))
        count = count + s.isNotNull().cast("int")
    return total / F.greatest(F.lit(1), count)


# ------------------------------------------------------------- strikes


def person_strike_speed(df: DataFrame, keys: Sequence[str], frame: str, person: str, seq: Seq, fps: float, min_valid: int = 5) -> DataFrame:
    """Per frame: the highest wrist speed of the two persons with most valid focus joints.

    ``seq`` orders the frames of one (key, person). A person needs ``min_valid`` valid
    focus joints in both frames.
    """
    focus = range(5, 11)

    def stage(w: WindowSpec) -> dict[str, Column]:
        nv = g.n_valid(focus)
        ok = (nv >= min_valid) & (F.lag(nv, 1).over(w) >= min_valid) & (F.lag(frame, 1).over(w) == F.col(frame) - 1)
        return {"_nv": nv, "_sp": F.when(ok, joint_speed(w, (g.L_WR, g.R_WR), fps))}

    d = wn.features(df, seq, 1, 0, stage)
    ranked = F.when(F.col("_nv") >= min_valid, F.struct((-F.col("_nv")).alias("n"), F.col(person).alias("p"), F.col("_sp").alias("s")))
    # at most one row per person and frame; keep the two best without a sort of the frame
    top = F.slice(F.array_sort(F.array_compact(F.collect_list(ranked))), 1, 2)
    a = d.groupBy(*keys, frame).agg(top.alias("_t"))
    return a.select(*keys, frame, F.coalesce(F.array_max(F.transform("_t", lambda t: t["s"])), F.lit(0.0)).alias("speed"))


def strikes(df: DataFrame, seq: Seq, speed: str, fps: float, pct: float = 0.85, merge: int = 8, smooth: int = 5) -> DataFrame:
    """Runs where smoothed speed exceeds the percentile of its positive values.

    ``smooth=1`` is the plain velocity baseline. ``df`` has ``i`` and ``n``.
    """
    keys = list(seq.keys)
    d = _frames(df, seq, smooth // 2, smooth // 2, lambda w: {"_sm": wn.edge_smooth_col(F.col(speed), w, smooth)})
    d = cut(d.select(*keys, "i", "n", "_sm"))
    thr = exact_percentile(d.filter(F.col("_sm") > 1e-12), keys, "_sm", pct, "_thr", whole=seq.whole)
    d = d.join(thr, keys)
    s = segments(d, seq, F.col("_sm") > F.greatest(F.col("_thr"), F.lit(1e-12)), merge, F.col("_sm"))
    return s.select(
        *keys, "start_index", "end_index", (F.col("start_index") / fps).alias("start_time"), ((F.col("end_index") + 1) / fps).alias("end_time"), F.col("peak").alias("score")
    )


# ------------------------------------------------------------- taps

# Tap detector constants.
TAP = dict(
    smooth=3, vel_pct=0.75, peak_hand=0.88, peak_foot=0.85, height=0.42, emit=0.22, window=1.5, repeats=2, pad=4, band=0.55,
    osc_hand=0.35, osc_foot=0.45, trap_low=0.55, trap_high=0.45, cap=12.0, norm=8.0, opp_weight=0.25, opp_gamma=12.0, trap_scale=18.0, tuck_margin=0.02, tuck_low=0.45,
)


def tap_strength(df: DataFrame, seq: Seq, fps: float, contact: Column | None = None, near: Column | None = None) -> DataFrame:
    """Per-frame hand and foot impulse strengths."""
    keys, c = list(seq.keys), TAP

    def first(w: WindowSpec) -> dict[str, Column]:
        wr, an = g.mid(g.joint(g.L_WR), g.joint(g.R_WR)), g.mid(g.joint(g.L_AN), g.joint(g.R_AN))
        sh, el = g.shoulders(), g.mid(g.joint(g.L_EL), g.joint(g.R_EL))
        tuck = F.when(wr.y < el.y + c["tuck_margin"], 1.0).otherwise(c["tuck_low"])
        return {
            "_wv": joint_speed(w, (g.L_WR, g.R_WR), fps),
            "_av": joint_speed(w, (g.L_AN, g.R_AN), fps),
            "_ow": F.abs(wn.second_difference_col(wr.y, w, fps)),
            "_oa": F.abs(wn.second_difference_col(an.y, w, fps)),
            "mat_gate": g.mat_band(wr.y, sh.y, an.y, c["band"]),
            "trapped": F.coalesce(clip(F.exp(-c["trap_scale"] * g.dist(wr, sh)) * tuck), F.lit(0.0)),
        }

    def second(w: WindowSpec) -> dict[str, Column]:
        return {"wrist_speed": wn.edge_smooth_col(F.col("_wv"), w, c["smooth"]), "ankle_speed": wn.edge_smooth_col(F.col("_av"), w, c["smooth"])}

    d = cut(_frames(df, seq, 2, 2, first, second))
    p = percentiles(d, keys, {"_ht": ("wrist_speed", c["vel_pct"]), "_ft": ("ankle_speed", c["vel_pct"]), "_mw": ("_ow", 0.5), "_ma": ("_oa", 0.5)}, whole=seq.whole)
    d = d.join(p, keys)
    boost = (0.55 + 0.45 * clip(contact)) if contact is not None else F.lit(1.0)
    opp = (1.0 + c["opp_weight"] * near) if near is not None else F.lit(1.0)
    hand = F.col("wrist_speed") / (F.col("_ht") + 1e-9) * (1.0 + c["osc_hand"] * F.col("_ow") / (F.col("_mw") + 1e-9)) * boost * opp
    foot = F.col("ankle_speed") / (F.col("_ft") + 1e-9) * (1.0 + c["osc_foot"] * F.col("_oa") / (F.col("_ma") + 1e-9))
    foot = foot * (c["trap_low"] + c["trap_high"] * F.col("trapped")) * boost
    lim = lambda x: F.coalesce(clip(x, 0.0, c["cap"]), F.lit(0.0))
    gate = F.col("mat_gate").cast("double")
    return d.withColumns({"hand_strength": F.when(hand.isNotNull(), lim(hand) * gate).otherwise(0.0), "foot_strength": F.when(foot.isNotNull(), lim(foot)).otherwise(0.0)})


def taps(df: DataFrame, seq: Seq, fps: float, contact: Column | None = None, near: Column | None = None) -> DataFrame:
    """Tap candidates: repeated impulse peaks, with score and evidence."""
    keys, c = list(seq.keys), TAP
    d = cut(tap_strength(df, seq, fps, contact, near))
    lv = percentiles(d, keys, {"_hl": ("hand_strength", c["peak_hand"]), "_fl": ("foot_strength", c["peak_foot"])}, whole=seq.whole)
    d = d.join(lv, keys)
    window = max(3, int(c["window"] * fps))
    out = None
    for branch, s, lev, osc, vel, thr in (
        ("hand_tap", "hand_strength", "_hl", "_ow", "wrist_speed", "_ht"),
        ("foot_tap", "foot_strength", "_fl", "_oa", "ankle_speed", "_ft"),
    ):
        floor = F.greatest(F.lit(c["emit"]), F.coalesce(F.col(lev), F.lit(0.0)) * c["height"])
        pk = _frames(d, seq, 1, 1, lambda w, s=s, floor=floor: {"_pk": wn.local_max_col(F.col(s), w, floor)}).filter("_pk")
        cl = peak_clusters(pk, Seq(seq.keys, ("i",), float(max(4096, window))), window, c["repeats"])
        last = d.groupBy(*keys).agg(F.max("n").alias("_n"))
        cl = cl.join(last, keys).select(
            *keys, F.greatest(F.lit(0), F.col("start_pos") - c["pad"]).alias("start_index"), F.least(F.col("_n") - 1, F.col("end_pos") + c["pad"]).alias("end_index"), "n_peaks"
        )
        cover = F.when(F.lit(branch == "hand_tap"), F.col("mat_gate").cast("double")).otherwise(F.col("trapped"))
        rel = clip(F.col(vel) / (F.col(thr) + 1e-9), 0.0, 6.0)
        pts = d.select(*keys, "i", F.col(s).alias("_s"), F.col("mat_gate").cast("double").alias("_mg"), F.col(osc).alias("_os"), ((1.0 - cover) * rel).alias("_sc"), "trapped")
        j = points_in_intervals(pts, cl, keys, "i", "start_index", "end_index", REACH)
        ev = j.groupBy(*keys, "start_index", "end_index", "n_peaks").agg(
            F.avg("_s").alias("_ms"), F.avg("_mg").alias("mat_fraction"), F.avg("_os").alias("oscillation"), F.avg("_sc").alias("_scr"), F.avg("trapped").alias("arms_trapped")
        )
        ev = ev.withColumn("score", clip(F.col("_ms") / c["norm"])).filter(F.col("score") >= c["emit"])
        ev = ev.select(
            *keys, F.lit(f"submission_signal.{branch}").alias("event_type"), (F.col("start_index") / fps).alias("start_time"), (F.col("end_index") / fps).alias("end_time"),
            "score", F.col("n_peaks").alias("repetition_count"), "mat_fraction", "oscillation", "arms_trapped",
            clip(F.exp(-5.0 * F.col("oscillation"))).alias("hand_posting_risk"), clip(F.col("_scr") / 6.0).alias("scramble_risk"), (F.col("mat_fraction") >= 0.5).alias("contact_band_passed"),
        )
        out = ev if out is None else out.unionByName(ev)
    return out


# ------------------------------------------------------------- vulnerability

# Vulnerability detector constants.
VUL = dict(
    smooth=3, min_rows=6, emit=0.28, pad=5, head_pct=0.82, collapse_pct=0.78, low_pct=0.22, high_pct=0.75, impact_pct=0.28, grounded=0.52, guard_min=0.42, guard_floor=0.18,
    w_head=0.38, w_collapse=0.32, w_ground=0.22, w_still=0.18, upright=0.62, history=24, impact_window=2.2, near_gamma=22.0, near_min=0.22, opp_motion=0.55, sustain=18,
    beta=0.35, cuts=(0.34, 0.52, 0.72), veto_guard=0.38, veto_head=1.05, scramble=0.88, static_std=0.012, static_span=0.58, norm=1.65,
)


def vulnerability_frames(df: DataFrame, seq: Seq, fps: float, risk: Column | None = None) -> DataFrame:
    """Per-frame scores and masks of the four candidate types.

    Optional inputs: ``impact`` (1 within reach is derived by the caller as
    ``post_impact``: boolean column), ``opp_near`` and ``opp_motion``.
    """
    keys, c = list(seq.keys), VUL
    have = set(df.columns)
    motion = (g.L_WR, g.R_WR, g.L_EL, g.R_EL, g.L_HIP, g.R_HIP, g.L_KN, g.R_KN)
    sh, an, nose = g.shoulders(), g.mid(g.joint(g.L_AN), g.joint(g.R_AN)), g.joint(g.NOSE)
    wr = g.mid(g.joint(g.L_WR), g.joint(g.R_WR))
    span = an.y - sh.y
    zone = g.mid(nose, sh)
    df = df.withColumns({"_span": span, "_gd": F.when(span > 1e-6, g.dist(wr, zone) / span)})

    def first(w: WindowSpec) -> dict[str, Column]:
        step = lambda x: F.when(wn.is_first(), F.lit(0.0)).otherwise((x - F.lag(x, 1).over(w)) * float(fps))
        return {"_hv": step(nose.y), "_sd": step(F.col("_span")), "_mm": joint_speed(w, motion, fps, "mean")}

    def second(w: WindowSpec) -> dict[str, Column]:
        sm = lambda x: wn.edge_smooth_col(F.col(x), w, c["smooth"])
        return {"head_v": sm("_hv"), "collapse": F.when(sm("_sd").isNotNull(), F.greatest(F.lit(0.0), -sm("_sd"))), "motion": sm("_mm")}

    def third(w: WindowSpec) -> dict[str, Column]:
        m = F.col("motion")
        return {"_m1": wn.edge_smooth_col(m, w, 9), "_m2": wn.edge_smooth_col(m * m, w, 9), "_hist": F.max("_span").over(w.rowsBetween(-c["history"], 0))}

    d = cut(_frames(df, seq, c["history"] + 2, 6, first, second, third))
    p = percentiles(
        d, keys,
        {"_lo": ("motion", c["low_pct"]), "_hi": ("motion", c["high_pct"]), "_ht": ("head_v", c["head_pct"]), "_ct": ("collapse", c["collapse_pct"]), "_cap": ("motion", c["impact_pct"])}, whole=seq.whole,
    )
    ref = early_reference(d, seq, "_span", max(12, round(2.0 * fps)), "_ref", index="i")
    eps = max(5e-6 * fps, 1e-5)
    d = d.join(p, keys).join(ref, keys)
    for k in ("_lo", "_hi", "_ht", "_ct", "_cap"):
        d = d.withColumn(k, F.greatest(F.coalesce(k, F.lit(0.0)), F.lit(eps)))
    ratio, m, gd = F.col("_span") / F.col("_ref"), F.col("motion"), F.col("_gd")
    d = d.withColumns(
        {
            "ratio": ratio,
            "grounded": F.coalesce(ratio <= c["grounded"], F.lit(False)),
            "head_drop": clip(F.col("head_v") / (F.col("_ht") + 1e-9), 0.0, 4.0),
            "collapse_score": clip(F.col("collapse") / (F.col("_ct") + 1e-9), 0.0, 4.0),
            "stillness": clip(clip((F.col("_lo") + 1e-6) / (m + 1e-6), 0.0, 5.0) / 5.0),
            "guard_loss": F.coalesce(clip((gd - c["guard_floor"]) / c["guard_min"], 0.0, 1.5), F.lit(0.0)),
            "upright": F.coalesce(F.col("_hist") / F.col("_ref") >= c["upright"], F.lit(False)),
            "opp_near": F.coalesce(F.col("opp_near"), F.lit(0.0)) if "opp_near" in have else F.lit(0.0),
            "opp_motion": F.coalesce(F.col("opp_motion"), F.lit(0.0)) if "opp_motion" in have else F.lit(0.0),
            "risk": clip01(risk) if risk is not None else F.lit(1.0),
            "_std": F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0))),
        }
    )
    # head and collapse are null where a coordinate is missing: scores become null, masks false
    d = d.withColumns({x: F.when(F.col(s).isNotNull(), F.col(x)) for x, s in (("head_drop", "head_v"), ("collapse_score", "collapse"))})
    mix = 1.0 + c["beta"] * F.col("risk")
    no = lambda x: F.coalesce(x, F.lit(False))
    guard_low, hd, cs, still = no(gd < c["veto_guard"]), F.col("head_drop"), F.col("collapse_score"), F.col("stillness")
    ko = c["w_head"] * clip(hd / 4.0) + c["w_collapse"] * clip(cs / 4.0) + c["w_ground"] * F.col("grounded").cast("double") + c["w_still"] * still
    ko = F.when(hd.isNotNull() & cs.isNotNull(), clip(ko * mix, 0.0, 2.5))
    ko_mask = no((hd >= 0.85) & (cs >= 0.55)) & F.col("grounded") & F.col("upright")
    ko_mask = ko_mask & ~(guard_low & no(hd < c["veto_head"]))
    ko_mask = ko_mask & ~(guard_low & no(hd < c["veto_head"] * 0.95) & no(cs < 0.62) & (m >= F.col("_lo") * 0.9))
    static = no((F.col("_std") < c["static_std"]) & (F.col("ratio") > c["static_span"]))
    calm = ~(m >= F.col("_hi") * c["scramble"]) & ~static
    defense = clip((0.55 * F.col("guard_loss") + 0.45 * still) * mix, 0.0, 2.5)
    defense_mask = F.col("grounded") & no(gd > c["guard_min"]) & (m <= F.col("_hi") * 0.95) & calm
    impact = F.col("post_impact") if "post_impact" in have else F.lit(False)
    post = F.when(impact, clip((1.0 - m / (F.col("_cap") + 1e-9)) * mix, 0.0, 1.8)).otherwise(0.0)
    post_mask = impact & (m <= F.col("_cap") * 1.15) & F.col("grounded") & calm
    opp = clip(F.col("opp_motion") / (F.col("_hi") + 1e-9), 0.0, 4.0)
    choke = clip((0.55 * still + 0.35 * F.col("opp_near") + 0.25 * clip(opp)) * mix, 0.0, 2.5)
    choke_mask = (m <= F.col("_lo") * 2.5) & (F.col("opp_near") >= c["near_min"]) & F.col("grounded") & (F.col("opp_motion") >= F.col("_hi") * c["opp_motion"]) & calm
    cols = {}
    for name, s, mk in (("ko", ko, ko_mask), ("defense", defense, defense_mask), ("post", post, post_mask), ("choke", choke, choke_mask)):
        cols[f"s_{name}"], cols[f"k_{name}"] = clip(s / c["norm"]), mk
        cols[f"s_{name}"] = F.when(s.isNotNull(), cols[f"s_{name}"])
    return d.withColumns(cols)


KINDS = {
    "ko": "extreme_vulnerability.ko_collapse",
    "defense": "extreme_vulnerability.no_intelligent_defense",
    "post": "extreme_vulnerability.post_impact_inactivity",
    "choke": "extreme_vulnerability.choke_unconsciousness_candidate",
}


def vulnerabilities(df: DataFrame, seq: Seq, fps: float, risk: Column | None = None) -> DataFrame:
    """Candidate intervals of extreme vulnerability with score, level and evidence."""
    keys, c = list(seq.keys), VUL
    d = cut(vulnerability_frames(df, seq, fps, risk))
    out = None
    for name, kind in KINDS.items():
        rows = max(c["min_rows"], c["sustain"]) if name == "choke" else c["min_rows"]
        seg = padded_segments(d, seq, F.col(f"k_{name}"), f"s_{name}", rows, c["pad"], max(c["emit"], c["cuts"][0]), "i")
        pts = d.select(*keys, "i", "head_drop", "collapse_score", "stillness", "guard_loss", "ratio", F.col("grounded").cast("double").alias("_g"), "motion")
        j = points_in_intervals(pts, seg, keys, "i", "start_index", "end_index", REACH)
        ev = j.groupBy(*keys, "start_index", "end_index", "score").agg(
            F.avg("head_drop").alias("head_drop_score"), F.avg("collapse_score").alias("collapse_score"), F.avg("stillness").alias("inactivity_score"),
            F.avg("guard_loss").alias("guard_loss_score"), F.avg(clip(F.col("ratio"), 0.0, 3.0)).alias("grounded_score"), F.avg("_g").alias("grounded_fraction"), F.avg("motion").alias("mean_motion"),
        )
        ev = ev.withColumns(
            {
                "event_type": F.lit(kind), "start_time": F.col("start_index") / fps, "end_time": F.col("end_index") / fps,
                "level": band(F.col("score"), c["cuts"], ("low", "moderate", "high", "critical")),
            }
        )
        out = ev if out is None else out.unionByName(ev)
    return out.drop("start_index", "end_index")


def opponent_columns(df: DataFrame, keys: Sequence[str], frame: str, person: str, gamma: float = 22.0) -> DataFrame:
    """Closest opponent wrist to the head, same frame: max over opponents and wrists of exp(-gamma * distance)."""
    me = df.select(*keys, frame, person, F.col("j0x").alias("_hx"), F.col("j0y").alias("_hy"))
    other = df.select(*keys, frame, F.col(person).alias("_op"), *[F.col(f"j{k}{a}") for k in (g.L_WR, g.R_WR) for a in "xy"])
    j = me.join(other, [*keys, frame]).filter(F.col("_op") != F.col(person))
    head = g.Pt(F.col("_hx"), F.col("_hy"))
    near = F.greatest(g.proximity(head, g.joint(g.L_WR), gamma), g.proximity(head, g.joint(g.R_WR), gamma))
    return j.groupBy(*keys, frame, person).agg(F.coalesce(F.max(near), F.lit(0.0)).alias("opp_near"))


def with_opponent(df: DataFrame, seq: Seq, fps: float, pair: Sequence[str], person: str) -> DataFrame:
    """``df`` with what the persons of one ``pair`` mean to each other, frame by frame.

    ``opp_near``: closest opponent wrist to the head; ``opp_motion``: the opponent's smoothed mean
    speed; ``opp_touch``: the own wrists' closeness to the opponent's hips; ``post_impact``: within
    the impact window behind the end of an opponent's strike. A frame without opponent has 0 and
    false. Persons of a pair share the frame index ``i``.
    """
    keys, pair = list(seq.keys), list(pair)
    joints = (g.L_WR, g.R_WR, g.L_EL, g.R_EL, 5, 6, g.L_HIP, g.R_HIP)
    d = _frames(
        df, seq, 2, 2,
        lambda w: {"_om": joint_speed(w, joints, fps, "mean"), "_sp": joint_speed(w, (g.L_WR, g.R_WR), fps)},
        lambda w: {"_os": wn.edge_smooth_col(F.col("_om"), w, VUL["smooth"])},
    )
    hips, wrist = g.hips(), g.mid(g.joint(g.L_WR), g.joint(g.R_WR))
    d = cut(d.withColumns({"_hipx": hips.x, "_hipy": hips.y, "_wrx": wrist.x, "_wry": wrist.y}))
    near = opponent_columns(d, pair, "i", person, VUL["near_gamma"])
    me = d.select(*pair, "i", person, "_wrx", "_wry")
    other = d.select(*pair, "i", F.col(person).alias("_op"), "_os", "_hipx", "_hipy")
    j = me.join(other, [*pair, "i"]).filter(F.col("_op") != F.col(person))
    touch = F.exp(-TAP["opp_gamma"] * F.hypot(F.col("_wrx") - F.col("_hipx"), F.col("_wry") - F.col("_hipy")))
    cues = j.groupBy(*pair, "i", person).agg(F.max("_os").alias("opp_motion"), F.max(touch).alias("opp_touch"))

    who = d.select(*keys, *pair, person).distinct()
    hits = strikes(d.select(*keys, "i", "n", F.col("_sp").alias("speed")), seq, "speed", fps).join(who, keys)
    last = max(2, int(VUL["impact_window"] * fps))
    hits = hits.select(*pair, F.col(person).alias("_by"), F.col("end_index").alias("_lo"), (F.col("end_index") + last).alias("_hi"))
    hits = who.join(hits, pair).filter(F.col("_by") != F.col(person)).select(*keys, "_lo", "_hi")
    after = points_in_intervals(d.select(*keys, "i"), hits, keys, "i", "_lo", "_hi", REACH).select(*keys, "i").distinct()

    out = df.join(near, [*pair, "i", person], "left").join(cues, [*pair, "i", person], "left")
    out = out.join(after.withColumn("post_impact", F.lit(True)), [*keys, "i"], "left")
    return cut(out.fillna(0.0, ["opp_near", "opp_motion", "opp_touch"]).fillna(False, ["post_impact"]))


# ------------------------------------------------------------- typed signals


def _emit(df: DataFrame, keep: Sequence[str], items: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One row per signal whose condition holds."""
    arr = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(n).alias("type"), conf.cast("double").alias("confidence"))) for n, conf, ok in items]))
    return df.select(*keep, F.inline(arr))


def action_signals(df: DataFrame, seq: Seq, t: str, keep: Sequence[str], least: float = 0.3) -> DataFrame:
    """Up to five typed signals per frame; of punch and kick only the stronger one."""

    def first(w: WindowSpec) -> dict[str, Column]:
        dt = F.greatest(F.lit(1.0 / 30.0), F.coalesce(F.col(t) - F.lag(t, 1).over(w), F.lit(0.0)))
        return g.limb_motion(w, dt)

    d = _frames(df, seq, 1, 0, first)
    d = d.withColumns({"_p": g.punch_confidence(), "_k": g.kick_confidence(), "_low": g.low_guard_confidence(), "_back": g.turned_back_confidence()})
    both = (F.col("_p") >= least) & (F.col("_k") >= least)
    kick = both & (F.col("_k") > F.col("_p") + 0.02) & (F.col("max_ankle_speed") + 0.01 >= F.col("max_wrist_speed"))
    punch = both & ~kick & (F.col("_p") >= F.col("_k"))
    limb = F.greatest("max_wrist_speed", "max_ankle_speed")
    d = d.withColumns({"_inc": g.incapacity_confidence(F.col("_low"), limb), "_pk": F.when(kick, 0.0).otherwise(F.col("_p")), "_kk": F.when(punch, 0.0).otherwise(F.col("_k"))})
    cols = (("punch_activity", "_pk"), ("kick_activity", "_kk"), ("low_guard", "_low"), ("turned_back", "_back"), ("defensive_incapacity", "_inc"))
    return _emit(d, keep, [(n, F.least(F.lit(1.0), F.col(c)), F.col(c) >= least) for n, c in cols])


def fall_signals(df: DataFrame, seq: Seq, t: str, keep: Sequence[str], ground: float = 0.78) -> DataFrame:
    """Fast descent, torso collapse and prolonged low posture at the end of each window."""
    # one hip stands for both where the other is missing
    hy, ny = F.coalesce(g.hips().y, g.joint(11).y, g.joint(12).y), g.joint(g.NOSE).y
    angle = g.torso_angle(g.shoulders(), g.hips())
    df = df.withColumns({"_hy": hy, "_an": angle, "_lk": g.fall_likelihood(ny, hy, ground)})

    def stage(w: WindowSpec) -> dict[str, Column]:
        dt = F.greatest(F.lit(1e-4), F.col(t) - F.lag(t, 1).over(w))
        v = lambda x: F.coalesce((x - F.lag(x, 1).over(w)) / dt, F.lit(0.0))
        f = w.rowsBetween(-11, 0)
        return {
            "_vd": F.greatest(v(F.col("_hy")), v(ny)), "_da": F.abs(F.col("_an") - F.lag("_an", 1).over(w)),
            "_ml": F.avg("_lk").over(f), "_nl": F.count_if(F.col("_lk") > 0.2).over(f), "_rows": F.count(F.lit(1)).over(f),
        }

    d = _frames(df, seq, 11, 0, stage)
    has = F.col("_rows") >= 2
    desc = F.when(F.col("_vd") > 0, clip((F.col("_vd") - 0.225) / (0.9 + 1e-6))).otherwise(0.0)
    tors = F.when(F.col("_da") >= 4.8, clip((F.col("_da") - 6.0) / (14.4 + 1e-6))).otherwise(0.0)
    low = F.when(F.col("_ml") >= 0.55 * 0.85, clip((F.col("_ml") - 0.35) / 0.55)).otherwise(0.0)
    return _emit(
        d, keep,
        [
            ("fall_rapid_downward", desc, has & (desc >= 0.32)), ("fall_torso_angle_collapse", tors, has & (tors >= 0.35)),
            ("fall_prolonged_low_posture", low, (F.col("_rows") >= 4) & (low >= 0.36) & (F.col("_nl") >= 4)),
        ],
    )


def limb_signals(df: DataFrame, seq: Seq, keep: Sequence[str], fps: float = 30.0) -> DataFrame:
    """Joint stress, asymmetry and sudden support loss from the last two frames; knees count as a pair."""
    p = g.joint_panel()
    kl, kr = p["left_knee_flexion_deg"], p["right_knee_flexion_deg"]
    pair = kl.isNotNull() & kr.isNotNull()
    el, er = p["left_elbow_flexion_deg"], p["right_elbow_flexion_deg"]
    ep = el.isNotNull() & er.isNotNull()
    df = df.withColumns({"_kl": F.when(pair, kl), "_kr": F.when(pair, kr), "_el": F.when(ep, el), "_er": F.when(ep, er), "_ay": g.foot_y_max()})

    def stage(w: WindowSpec) -> dict[str, Column]:
        return {"_col": wn.leg_collapse_col(F.col("_kl"), F.col("_kr"), F.col("_ay"), w, fps), "_first": wn.is_first()}

    d = _frames(df, seq, 1, 0, stage)
    st = lambda c: F.when(F.col(c).isNotNull(), wn.knee_stress_col(F.col(c))).otherwise(0.0)
    sj = F.greatest(st("_kl"), st("_kr"), st("_el"), st("_er"))
    cj = clip((sj - 0.3) / 0.5)
    asym = F.coalesce(clip(F.abs(F.col("_kl") - F.col("_kr")) / 40.0), F.lit(0.0))
    asym = F.when(F.col("_kl").isNotNull(), asym).otherwise(0.0)
    go = ~F.col("_first")
    return _emit(
        d, keep,
        [
            ("limb_joint_angular_anomaly", cj, go & (cj >= 0.33) & (sj >= 0.55 * 0.88)), ("limb_bilateral_asymmetry", asym, go & (asym >= 0.5) & (asym * 0.95 >= 0.33)),
            ("limb_sudden_support_loss", F.col("_col"), go & (F.col("_col") >= 0.5)),
        ],
    )


def inactivity_signals(df: DataFrame, seq: Seq, t: str, keep: Sequence[str], seconds: float = 2.0, cap: int = 120) -> DataFrame:
    """Low joint motion and low centre motion over the shortest suffix of at least ``seconds``.

    The suffix starts at the latest row at least ``seconds`` old, or ``cap`` rows back.
    A frame without common joints counts as step 0. The suffix is read from an array of at
    most ``cap`` + 1 small structs per row.
    """
    sh, hp = g.shoulders(), g.hips()
    com = g.mid(sh, hp)
    df = df.withColumns({"_cx": com.x, "_cy": com.y, "_us": F.round(F.col(t) * 1e6).cast("long")})

    def steps(w: WindowSpec) -> dict[str, Column]:
        last = F.last(F.when(F.col("_cx").isNotNull(), F.struct("_cx", "_cy", "i")), ignorenulls=True).over(w.rowsBetween(-cap, -1))
        return {"_st": joint_speed(w, range(17), 1.0, "mean"), "_pc": last}

    d = _frames(df, seq, cap, 0, steps)
    d = d.withColumn("_cs", F.coalesce(F.hypot(F.col("_cx") - F.col("_pc")["_cx"], F.col("_cy") - F.col("_pc")["_cy"]), F.lit(0.0)))

    def sums(w: WindowSpec) -> dict[str, Column]:
        old = w.rowsBetween(-cap, 0)
        run = w.rowsBetween(-cap, 0)
        return {
            "_hist": F.collect_list(F.struct(F.col("i").alias("i"), F.col("_us").alias("u"), F.col("_st").alias("s"), F.col("_cs").alias("c"), F.col("_cx").isNotNull().alias("k"), F.col("_pc")["i"].alias("pi"))).over(old),
            "_nrow": F.count(F.lit(1)).over(run),
        }

    d = _frames(d, seq, cap, 0, sums)
    us = int(seconds * 1e6)
    d = d.withColumn("_o", F.filter("_hist", lambda h: F.col("_us") - h["u"] >= us))
    start = F.when(F.size("_o") > 0, F.element_at("_o", -1)["i"]).when(F.col("_nrow") > cap, F.col("i") - cap).otherwise(F.lit(0))
    d = d.withColumn("_a", start)
    d = d.withColumn("_win", F.filter("_hist", lambda h: h["i"] >= F.col("_a")))
    d = d.withColumns(
        {
            "_dur": (F.col("_us") - F.get("_win", F.lit(0))["u"]) / 1e6, "_len": F.size("_win"),
            "_k0": F.get("_win", F.lit(0))["k"],
            "_sum": F.aggregate(F.slice("_win", 2, cap + 1), F.lit(0.0), lambda a, h: a + h["s"]),
        }
    )
    # a path needs a centre in the first row; later steps bridge gaps to the last known centre inside the suffix
    d = d.withColumn("_path", F.when(F.col("_k0"), F.aggregate(F.slice("_win", 2, cap + 1), F.lit(0.0), lambda a, h: a + F.when(h["pi"] >= F.col("_a"), h["c"]).otherwise(0.0))).otherwise(0.0))
    mean = safe_div(F.col("_sum"), (F.col("_len") - 1).cast("double"))
    ok = (F.col("_len") >= 3) & (F.col("_dur") + 1e-9 >= seconds)
    idx = F.when(mean >= 0.002, 0.0).otherwise(clip(1.0 - mean / 0.002))
    kp = F.when((mean < 1.2 * 0.002) & (idx >= 0.45), clip(1.0 - mean / (3.0 * 0.002 + 1e-8))).otherwise(0.0)
    speed = F.col("_path") / F.greatest(F.lit(1e-4), F.col("_dur"))
    cm = F.when((speed < 2.5 * 0.0015) & (F.col("_path") < 0.04), clip(1.0 - speed / (0.0015 + 1e-8))).otherwise(0.0)
    return _emit(d, keep, [("inactivity_low_keypoint_motion", kp, ok & (kp >= 0.32)), ("inactivity_low_com_motion", cm, ok & (cm >= 0.32))])


# ------------------------------------------------------------- surrender


def surrender_window(df: DataFrame, seq: Seq, rows: int = 22) -> DataFrame:
    """Confidence per row from the trailing ``rows`` wrist midpoints (one wrist is enough).

    Gaps are filled inside the window (forward, then back). Needs 8 rows, 8 hits and
    40 % coverage. Adds ``surrender_confidence``, ``surrender_detected``, ``_wx``, ``_wy``.
    """
    m = g.wrist_mid()
    df = df.withColumns({"_mx": m.x, "_my": m.y})

    def stage(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(-(rows - 1), 0)
        # structs keep missing values in place; nulls inside a plain list would be dropped
        return {"_l": F.collect_list(F.struct("_mx", "_my")).over(f)}

    d = _frames(df, seq, rows - 1, 0, stage)

    def filled(axis: str) -> Column:
        vals = F.transform("_l", lambda p: p[axis])
        first = F.get(F.array_compact(vals), F.lit(0))
        acc = F.struct(F.array().cast("array<double>").alias("o"), first.alias("p"))
        step = lambda a, v: F.struct(F.array_append(a["o"], F.coalesce(v, a["p"])).alias("o"), F.coalesce(v, a["p"]).alias("p"))
        return F.aggregate(vals, acc, step, lambda a: a["o"])

    d = d.withColumns({"_wx": filled("_mx"), "_wy": filled("_my"), "_hits": F.size(F.array_compact(F.transform("_l", lambda p: p["_my"]))), "_w": F.size("_l")})
    diff = lambda a: F.zip_with(F.slice(a, 2, rows), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda p, q: p - q)
    d = d.withColumn("_v", F.concat(F.array(F.lit(0.0)), diff(F.col("_wy"))))
    d = d.withColumn("_d2", diff(F.col("_v")))
    turns = F.zip_with(F.slice("_v", 2, rows), F.slice(F.col("_v"), F.lit(1), F.greatest(F.size("_v") - 1, F.lit(0))), lambda p, q: p * q < 0)
    d = d.withColumns(
        {
            "_std": _std("_wx") + _std("_wy"), "_rev": F.size(F.filter(turns, lambda x: x)), "_pulse": F.size(F.filter("_d2", lambda x: F.abs(x) > 0.04)),
            "_drop": F.element_at("_wy", -1) - F.get("_wy", F.lit(0)),
        }
    )
    osc = F.least(F.lit(1.0), F.col("_std") / 0.1)
    rev = F.when(F.col("_rev") >= 2, F.least(F.lit(1.0), F.col("_rev") / 8.0)).otherwise(0.0)
    down = F.when(F.col("_drop") > 0.02, F.least(F.lit(1.0), F.col("_drop") / 0.12)).otherwise(0.0)
    imp = F.least(F.lit(1.0), F.col("_pulse") / 4.0)
    ok = (F.col("_w") >= 8) & (F.col("_hits") >= 8) & (F.col("_hits") >= F.col("_w") * 0.4)
    conf = F.when(ok, clip(0.32 * osc + 0.30 * rev + 0.20 * down + 0.18 * imp)).otherwise(0.0)
    return d.withColumn("surrender_confidence", conf).withColumn("surrender_detected", F.col("surrender_confidence") >= 0.52)


def _std(a: str) -> Column:
    n = F.size(a).cast("double")
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    return F.sqrt(F.aggregate(F.transform(a, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / n)


def surrender_signals(df: DataFrame, seq: Seq, keep: Sequence[str], rows: int = 22, least: float = 0.28) -> DataFrame:
    """Oscillation, tap-like and rhythmic signals; the aggregate stands in when none of them passes."""
    d = surrender_window(df, seq, rows)
    osc = F.least(F.lit(1.0), F.col("_std") / 0.12)
    s = F.array_sort("_wy")
    n = F.size(s)
    med = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0
    near = F.when(med > 0.58, 1.0).otherwise(0.4)
    yd = F.greatest(F.lit(0.0), F.col("_drop"))
    span = F.array_max("_wy") - F.array_min("_wy") + 1e-6
    d = d.withColumns({"_osc": osc, "_tap": F.least(F.lit(1.0), 0.55 * F.least(F.lit(1.0), yd / 0.08) + 0.45 * osc * near), "_sdy": _std("_wy"), "_sp": span})
    rhy = F.least(F.lit(1.0), F.col("_sdy") / 0.06) * F.least(F.lit(1.0), F.col("_rev") / 4.0)
    rhy = F.when(n >= 4, clip(rhy * (1.0 - 0.15 * F.abs(F.col("_drop")) / F.col("_sp")))).otherwise(0.0)
    d = d.withColumn("_rhy", rhy)
    has = (F.col("_w") >= 2) & (F.col("_hits") > 0)
    a, b, c = has & (F.col("_osc") >= least), has & (F.col("_tap") >= least), has & (F.col("_rhy") >= least) & (F.col("_w") >= 6)
    conf = F.col("surrender_confidence")
    alone = F.col("surrender_detected") & ~a & ~b & ~c
    return _emit(
        d, keep,
        [
            ("surrender_oscillation", F.least(F.lit(1.0), F.when(alone, conf).otherwise(F.col("_osc") * (0.4 + 0.6 * conf))), a | alone),
            ("surrender_tap_like", F.col("_tap"), b), ("surrender_rhythmic_hands", F.col("_rhy"), c),
        ],
    )


# ------------------------------------------------------------- pose features


def pose_features(df: DataFrame, seq: Seq, fps: float, rows: int = 5) -> DataFrame:
    """Geometry, gradients, rolling deviations and limb columns in one pass over the frames."""
    h = g.body_height()
    p = g.joint_panel()
    base = {
        "torso_angle_deg": p["torso_angle_deg"], "hip_vertical_position": g.hips().y, "head_vertical_position": g.joint(g.NOSE).y, "body_height_proxy": h,
        "guard_level": g.guard_level(h), "facing_away_score": g.facing_away(), "knee_flexion_left_deg": p["left_knee_flexion_deg"],
        "knee_flexion_right_deg": p["right_knee_flexion_deg"], "ankle_y_min": g.foot_y_max(), **g.posture_flags(),
    }
    d = df.withColumns(base)
    hip, head, tor = (F.col(c) for c in ("hip_vertical_position", "head_vertical_position", "torso_angle_deg"))
    dt = 1.0 / fps

    def first(w: WindowSpec) -> dict[str, Column]:
        m = g.wrist_mid()
        return {
            "hip_vertical_velocity": wn.central_gradient_col(hip, w, dt), "head_vertical_velocity": wn.central_gradient_col(head, w, dt),
            "torso_angle_velocity": wn.central_gradient_col(tor, w, dt), "instability_score": wn.instability_col([hip, head, tor], w, rows),
            "low_posture_duration_frames": F.sum(F.col("is_low_posture").cast("int")).over(w.rowsBetween(-(rows - 1), 0)),
            "strike_incoming_proxy": clip01(wn.step_col(m.x, m.y, w) / dt / 3.0),
        }

    r1, r2 = wn.reaction_delay_cols(F.col("hip_vertical_velocity"), F.col("head_vertical_velocity"), None, dt)
    l1, l2 = wn.limb_stages(fps)
    d = _frames(d, seq, 20 + rows, 2, first, r1, r2, l1, l2)
    return d.withColumns({"hip_center_y": hip}).drop("_jerk", "_collapse")


def angular_kinematics(df: DataFrame, seq: Seq, fps: float, cols: Sequence[str], rows: int = 5) -> DataFrame:
    """Velocity, acceleration and rolling deviation of each column, plus motion energy."""
    dt = 1.0 / fps

    def first(w: WindowSpec) -> dict[str, Column]:
        out = {f"{c}_velocity": wn.central_gradient_col(F.col(c), w, dt, None) for c in cols}
        return out | {f"{c}_std": wn.rolling_std_col(F.col(c), w, rows, 2) for c in cols}

    def second(w: WindowSpec) -> dict[str, Column]:
        return {f"{c}_acceleration": wn.central_gradient_col(F.col(f"{c}_velocity"), w, dt, None) for c in cols}

    d = _frames(df, seq, rows + 2, 2, first, second)
    vals = F.array_compact(F.array(*[F.abs(F.col(f"{c}_velocity")) for c in cols]))
    energy = F.try_divide(F.aggregate(vals, F.lit(0.0), lambda a, v: a + v), F.size(vals).cast("double"))
    return d.withColumn("motion_energy", energy)
