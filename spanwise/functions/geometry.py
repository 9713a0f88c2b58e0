"""Per-frame geometry as column expressions.

A pose is wide: joint ``k`` of a 17-joint skeleton has columns ``j<k>x`` and ``j<k>y``,
both null when the joint is missing, so "all points required" is null propagation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.scalar import clip, clip01, safe_div

# Joint order of the 17-joint skeleton.
JOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow",
    "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee",
    "left_ankle", "right_ankle",
)
NOSE, L_SH, R_SH, L_EL, R_EL, L_WR, R_WR, L_HIP, R_HIP, L_KN, R_KN, L_AN, R_AN = 0, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16


class Pt(NamedTuple):
    x: Column
    y: Column


def joint(k: int, prefix: str = "j") -> Pt:
    return Pt(F.col(f"{prefix}{k}x"), F.col(f"{prefix}{k}y"))


def mid(a: Pt, b: Pt) -> Pt:
    return Pt((a.x + b.x) / 2.0, (a.y + b.y) / 2.0)


def dist(a: Pt, b: Pt) -> Column:
    return F.hypot(b.x - a.x, b.y - a.y)


def valid_xy(x: Column, y: Column) -> Column:
    """Finite and not at the origin."""
    fin = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return fin & ((F.abs(x) > 1e-8) | (F.abs(y) > 1e-8))


def read_tensor(df: DataFrame, values: str, dims: int = 2, joints: int = 17, prefix: str = "j", shift: float = 0.0) -> DataFrame:
    """Flat numeric array (x, y[, conf] per joint) -> wide joint columns; invalid joints become null."""
    cols = {}
    for k in range(joints):
        x = F.get(F.col(values), F.lit(k * dims)).cast("double") + shift
        y = F.get(F.col(values), F.lit(k * dims + 1)).cast("double") + shift
        ok = valid_xy(x, y)
        cols[f"{prefix}{k}x"], cols[f"{prefix}{k}y"] = F.when(ok, x), F.when(ok, y)
        if dims > 2:
            cols[f"{prefix}{k}c"] = F.get(F.col(values), F.lit(k * dims + 2)).cast("double")
    return df.withColumns(cols)


def pivot_landmarks(df: DataFrame, keys: list[str], name: str, x: str, y: str, seq: str, names=JOINTS) -> DataFrame:
    """Long keypoints -> wide; the last row of a duplicated keypoint wins, missing coordinates are dropped."""
    aggs = []
    for k, n in enumerate(names):
        pt = F.max_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.when(F.col(name) == n, F.col(seq)))
        ok = ~F.isnan(pt["x"]) & ~F.isnan(pt["y"])
        aggs += [F.when(ok, pt["x"]).alias(f"j{k}x"), F.when(ok, pt["y"]).alias(f"j{k}y")]
    return df.groupBy(*keys).agg(*aggs)


def shoulders() -> Pt:
    return mid(joint(L_SH), joint(R_SH))


def hips() -> Pt:
    return mid(joint(L_HIP), joint(R_HIP))


def torso_angle(sh: Pt, hip: Pt) -> Column:
    """Degrees between hip -> shoulder and the vertical (y grows downward)."""
    return F.degrees(F.atan2(sh.x - hip.x, hip.y - sh.y))


def flexion(a: Pt, b: Pt, c: Pt) -> Column:
    """180 minus the interior angle at ``b``."""
    ux, uy, vx, vy = a.x - b.x, a.y - b.y, c.x - b.x, c.y - b.y
    cos = (ux * vx + uy * vy) / ((F.hypot(ux, uy) + 1e-9) * (F.hypot(vx, vy) + 1e-9))
    ok = cos.isNotNull()
    return F.when(ok, clip(180.0 - F.degrees(F.acos(clip(cos, -1.0, 1.0))), 0.0, 180.0))


def body_height() -> Column:
    """Vertical extent of nose, shoulders, hips and ankles; null with fewer than two."""
    ys = [joint(k).y for k in (NOSE, L_SH, R_SH, L_HIP, R_HIP, L_AN, R_AN)]
    n = sum((y.isNotNull().cast("int") for y in ys[1:]), ys[0].isNotNull().cast("int"))
    return F.when(n >= 2, F.greatest(*ys) - F.least(*ys))


def wrist_mid() -> Pt:
    """Mean of the wrists; one is enough."""
    l, r = joint(L_WR), joint(R_WR)  # noqa: E741
    return Pt(F.coalesce((l.x + r.x) / 2.0, l.x, r.x), F.coalesce((l.y + r.y) / 2.0, l.y, r.y))


def guard_level(height: Column) -> Column:
    gap = (wrist_mid().y - joint(NOSE).y) / height
    return F.when(height > 1e-6, clip01((gap - 0.05) / 0.55)).otherwise(F.lit(0.0))


def facing_away() -> Column:
    w = dist(joint(L_SH), joint(R_SH))
    off = F.abs(joint(NOSE).x - shoulders().x) / w
    return F.when(w > 1e-6, clip01((off - 0.12) / 0.5)).otherwise(F.lit(0.0))


def foot_y_max() -> Column:
    return F.greatest(joint(L_AN).y, joint(R_AN).y)


def posture_flags(low: float = 0.58, ground: float = 0.82) -> dict[str, Column]:
    return {
        "is_low_posture": F.coalesce(hips().y >= low, F.lit(False)),
        "near_ground": F.coalesce(foot_y_max() >= ground, F.lit(False)),
    }


def weighted_com(weights: dict[int, Column] | None = None) -> dict[str, Column]:
    """Visibility-weighted centre over 13 joints; weights <= 0 are left out, default 1."""
    sx = sy = sw = F.lit(0.0)
    for k in (NOSE, L_SH, R_SH, L_EL, R_EL, L_WR, R_WR, L_HIP, R_HIP, L_KN, R_KN, L_AN, R_AN):
        p = joint(k)
        w = F.coalesce(weights[k], F.lit(1.0)) if weights and k in weights else F.lit(1.0)
        ok = p.x.isNotNull() & (w > 0)
        sx, sy, sw = sx + F.when(ok, w * p.x).otherwise(0.0), sy + F.when(ok, w * p.y).otherwise(0.0), sw + F.when(ok, w).otherwise(0.0)
    return {"com_x": F.try_divide(sx, sw), "com_y": F.try_divide(sy, sw), "com_weight": sw}


def joint_panel() -> dict[str, Column]:
    """Centres, angles, centre of mass, base width and left/right symmetry."""
    j = joint
    sh, hp = shoulders(), hips()
    ang = {
        "left_elbow": flexion(j(L_SH), j(L_EL), j(L_WR)), "right_elbow": flexion(j(R_SH), j(R_EL), j(R_WR)),
        "left_knee": flexion(j(L_HIP), j(L_KN), j(L_AN)), "right_knee": flexion(j(R_HIP), j(R_KN), j(R_AN)),
        "left_hip": flexion(j(L_SH), j(L_HIP), j(L_KN)), "right_hip": flexion(j(R_SH), j(R_HIP), j(R_KN)),
    }
    out = {
        "shoulder_center_x": sh.x, "shoulder_center_y": sh.y, "hip_center_x": hp.x, "hip_center_y": hp.y,
        "head_x": j(NOSE).x, "head_y": j(NOSE).y, "torso_angle_deg": torso_angle(sh, hp),
    }
    out.update({f"{n}_flexion_deg": c for n, c in ang.items()})
    out["left_shoulder_abduction_deg"] = 180.0 - flexion(j(L_HIP), j(L_SH), j(L_EL))
    out["right_shoulder_abduction_deg"] = 180.0 - flexion(j(R_HIP), j(R_SH), j(R_EL))
    out.update(weighted_com())
    out["base_of_support_width"] = F.abs(j(L_AN).x - j(R_AN).x)
    sym = {s: F.abs(ang[f"left_{s}"] - ang[f"right_{s}"]) for s in ("elbow", "knee", "hip")}
    vals = F.array_compact(F.array(*sym.values()))
    mean = F.try_divide(F.aggregate(vals, F.lit(0.0), lambda a, v: a + v), F.size(vals).cast("double"))
    out["limb_angle_symmetry_index"] = mean / 180.0
    out.update({f"{s}_angle_symmetry_deg": c for s, c in sym.items()})
    for n, (a, b) in {"wrist": (L_WR, R_WR), "ankle": (L_AN, R_AN), "knee": (L_KN, R_KN)}.items():
        out[f"{n}_height_symmetry"] = F.abs(j(a).y - j(b).y)
    return out


def normalize_unit_square(df: DataFrame, joints: int = 17, scaled: bool = False) -> DataFrame:
    """Clip poses that already lie in the unit square, else scale by their larger extent.

    ``scaled`` says that all poses are known to be in its units: a point outside is then an outlier to clip.
    """
    pts = [joint(k) for k in range(joints)]
    if scaled:
        return df.withColumns({f"j{k}{a}": F.when(c.isNotNull(), clip(c)) for k, p in enumerate(pts) for a, c in (("x", p.x), ("y", p.y))})
    x0, x1 = F.least(*[p.x for p in pts]), F.greatest(*[p.x for p in pts])
    y0, y1 = F.least(*[p.y for p in pts]), F.greatest(*[p.y for p in pts])
    d = df.withColumns({"_x0": x0, "_y0": y0, "_ext": F.greatest(x1 - x0, y1 - y0, F.lit(1e-6)), "_x1": x1, "_y1": y1})
    unit = (F.col("_x1") <= 1.05) & (F.col("_y1") <= 1.05) & (F.col("_x0") >= -0.05) & (F.col("_y0") >= -0.05) & (F.col("_ext") <= 1.05)
    cols = {}
    for k, p in enumerate(pts):
        cols[f"j{k}x"] = clip(F.when(unit, p.x).otherwise((p.x - F.col("_x0")) / F.col("_ext")))
        cols[f"j{k}y"] = clip(F.when(unit, p.y).otherwise((p.y - F.col("_y0")) / F.col("_ext")))
    cols = {n: F.when(F.col(n).isNotNull(), c) for n, c in cols.items()}
    return d.withColumns(cols).drop("_x0", "_y0", "_x1", "_y1", "_ext")


def n_valid(joints) -> Column:
    out = F.lit(0)
    for k in joints:
        out = out + joint(k).x.isNotNull().cast("int")
    return out


def person_quality() -> Column:
    """Valid joints first, then the spread of the pose."""
    xs, ys = [joint(k).x for k in range(17)], [joint(k).y for k in range(17)]
    n = n_valid(range(17))
    spread = (F.greatest(*xs) - F.least(*xs)) + (F.greatest(*ys) - F.least(*ys))
    return F.when(n < 2, n - 1.0).otherwise(n * 1e6 + spread)


def limb_motion(w, dt: Column | float) -> dict[str, Column]:
    """Eight limb speeds from the previous row of a window; 0 when either point is missing."""

    def speed(p: Pt) -> Column:
        d = F.hypot(p.x - F.lag(p.x, 1).over(w), p.y - F.lag(p.y, 1).over(w)) / dt
        return F.coalesce(d, F.lit(0.0))

    lw, rw, la, ra = (speed(joint(k)) for k in (L_WR, R_WR, L_AN, R_AN))
    return {
        "left_wrist_speed": lw, "right_wrist_speed": rw, "left_ankle_speed": la, "right_ankle_speed": ra,
        "max_wrist_speed": F.greatest(lw, rw), "max_ankle_speed": F.greatest(la, ra),
        "shoulder_center_speed": speed(shoulders()), "hip_center_speed": speed(hips()),
    }


def body_scale() -> Column:
    w = dist(joint(L_SH), joint(R_SH))
    return F.coalesce(F.greatest(w, F.lit(1e-5)), F.lit(0.1))


def burst(main: Column, support: Column, scale: Column, a: float, k: float, lo: float, v: float) -> Column:
    """Burst of an end point relative to body scale, supported by the body centre."""
    m, s = main / scale, support / scale
    raw = a * m + (1.0 - a) * F.least(m, s * k)
    return clip((raw - v * lo) / (v * (1.0 - lo)))


def punch_confidence() -> Column:
    return burst(F.col("max_wrist_speed"), F.col("shoulder_center_speed"), body_scale(), 0.72, 1.2, 0.25, 2.5)


def kick_confidence() -> Column:
    return burst(F.col("max_ankle_speed"), F.col("hip_center_speed"), body_scale(), 0.55, 1.3, 0.2, 2.0)


def energy_proxy(wrist: Column, rotation: Column) -> Column:
    raw = 0.65 * F.greatest(wrist, F.lit(0.0)) + 0.35 * F.greatest(rotation, F.lit(0.0))
    return clip(raw / (1.0 + raw))


def low_guard_confidence() -> Column:
    ny = joint(NOSE).y
    one = lambda k: clip((joint(k).y - ny - 0.04) / 0.12)
    parts = [F.when(joint(k).y.isNotNull() & ny.isNotNull(), one(k)) for k in (L_WR, R_WR)]
    return F.coalesce(F.greatest(*parts), F.lit(0.0))


def turned_back_confidence() -> Column:
    sw, hw = dist(joint(L_SH), joint(R_SH)), dist(joint(L_HIP), joint(R_HIP))
    r = sw / F.greatest(hw, F.lit(1e-5))
    return F.when((hw >= 0.02) & (r <= 0.75), clip((0.75 - r) / 0.35)).otherwise(F.lit(0.0))


def incapacity_confidence(low: Column, limb: Column) -> Column:
    still = 1.0 - F.least(F.lit(1.0), limb / 0.45)
    return F.when((low >= 0.42) & (limb <= 0.45 * 1.4), clip(low * (0.35 + 0.65 * still))).otherwise(F.lit(0.0))


def fall_likelihood(head: Column, hip: Column, ground: float = 0.82) -> Column:
    y = F.greatest(head, hip)
    return F.when(y >= ground, clip((y - ground) / (1.0 - ground))).otherwise(F.lit(0.0))


def mat_band(wrist: Column, shoulder: Column, foot: Column, ratio: float) -> Column:
    span = foot - shoulder
    return F.coalesce((span > 1e-6) & (wrist >= shoulder + ratio * span), F.lit(False))


def proximity(a: Pt, b: Pt, gamma: float) -> Column:
    return F.exp(-gamma * dist(a, b))




def filter_joints(df: DataFrame, min_valid: int, least: float | None = None, joints: int = 17, prefix: str = "j") -> DataFrame:
    """Joints without a valid position, or with a confidence of at most ``least``, become null; so do all
    joints of a frame with fewer than ``min_valid`` left. Every frame stays; ``n_valid`` counts before that."""
    ok = [valid_xy(*joint(k, prefix)) & (F.col(f"{prefix}{k}c") > least if least is not None else F.lit(True)) for k in range(joints)]
    ok = [F.coalesce(o & ~F.isnan(f"{prefix}{k}c"), F.lit(False)) if least is not None else o for k, o in enumerate(ok)]
    d = df.withColumn("n_valid", sum((o.cast("int") for o in ok[1:]), ok[0].cast("int")))
    enough = F.col("n_valid") >= min_valid
    return d.withColumns({f"{prefix}{k}{a}": F.when(enough & ok[k], F.col(f"{prefix}{k}{a}")) for k in range(joints) for a in "xy"})


def frame_name(n: Column | str) -> Column:
    """Frame number as text that sorts in order, of eight digits or more."""
    return F.format_string("%08d", n)
