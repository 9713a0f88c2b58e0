"""Column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SAFETY_LEVELS = ("INFO", "WARNING", "HIGH", "CRITICAL")


def clean(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clip; null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def clip01(x: Column) -> Column:
    """Clip to [0, 1] after null and NaN -> 0 and +inf -> 1."""
    # never null here, so no null test: it would repeat ``x`` in the plan
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    b2 = float(beta) ** 2
    return safe_div((1.0 + b2) * p * r, b2 * p + r)


def band(score: Column, cuts: Sequence[float], names: Sequence[str] = LEVELS) -> Column:
    """Ordered bands with inclusive lower bounds; null, NaN and inf take the lowest."""
    if list(cuts) != sorted(set(cuts)) or len(names) != len(cuts) + 1:
        raise ValueError("cuts must increase and be one fewer than names")
    s = clean(score)
    out = F.when(s.isNull(), F.lit(names[0]))
    for cut, name in reversed(list(zip(cuts, names[1:]))):
        out = out.when(s >= F.lit(float(cut)), F.lit(name))
    return out.otherwise(F.lit(names[0]))


def rank_of(level: Column, names: Sequence[str] = LEVELS, default: int = 0) -> Column:
    out = F.lit(None).cast("int")
    for i, n in enumerate(names):
        out = F.when(F.upper(F.trim(level)) == n, F.lit(i)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def level_of(rank: Column, names: Sequence[str] = LEVELS) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (rank + 1).cast("int"))


def lookup(x: Column, mapping: Mapping[str, object], default: object = None) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def natural_key(x: Column) -> Column:
    """Sort key where digit runs compare as numbers and text ignores case."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda t: F.when(t.rlike("^[0-9]"), F.lpad(t, 20, "0")).otherwise(t))


def trailing_int(x: Column) -> Column:
    return F.regexp_extract(x, r"(\d+)(?!.*\d)", 1).try_cast("long")


def frame_number(x: Column) -> Column:
    """``123`` or ``f123`` -> 123, otherwise null."""
    return F.regexp_extract(F.trim(x), r"^[fF]?(\d+)$", 1).try_cast("long")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def norm_label(x: Column) -> Column:
    t = F.upper(F.regexp_replace(F.trim(x), r"\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(t)


def namespace(x: Column) -> Column:
    return F.substring_index(F.trim(x), ".", 1)


def family_subtype(x: Column) -> Column:
    """Split at the first dot; without a dot the family is ``unknown``."""
    t = F.trim(x)
    has = F.instr(t, ".") > 0
    return F.struct(
        F.when(has, F.substring_index(t, ".", 1)).otherwise(F.lit("unknown")).alias("family"),
        F.when(has, F.substring(t, F.instr(t, ".") + 1, F.length(t))).otherwise(t).alias("subtype"),
    )


def timecode_seconds(x: Column) -> Column:
    """``SS``, ``MM:SS`` or ``HH:MM:SS`` -> seconds, null when malformed."""
    ok = F.trim(x).rlike(r"^\d+(:\d+){0,2}(\.\d+)?$")
    parts = F.split(F.trim(x), ":")
    return F.when(ok, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60.0 + p.try_cast("double")))


def fused_mean(values: Column, weights: Column) -> Column:
    """Weighted mean over keys present in both maps; weights <= 0 are skipped."""
    pairs = F.filter(
        F.transform(F.map_entries(weights), lambda e: F.struct(e["value"].alias("w"), F.try_element_at(values, e["key"]).alias("v"))),
        lambda p: (p["w"] > 0) & p["v"].isNotNull(),
    )
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    return F.aggregate(
        pairs,
        zero,
        lambda a, p: F.struct((a["n"] + p["w"] * p["v"]).alias("n"), (a["d"] + p["w"]).alias("d")),
        lambda a: safe_div(a["n"], a["d"]),
    )


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """1-D intersection over union; reversed bounds are swapped, degenerate -> 0."""
    s0, e0 = F.least(a0, a1), F.greatest(a0, a1)
    s1, e1 = F.least(b0, b1), F.greatest(b0, b1)
    inter = F.least(e0, e1) - F.greatest(s0, s1)
    la, lb = e0 - s0, e1 - s1
    return F.when((inter > 0) & (la > 0) & (lb > 0), inter / (la + lb - inter)).otherwise(F.lit(0.0))


def dilate(start: Column, end: Column, tolerance: float) -> tuple[Column, Column]:
    """Widen by half the tolerance on each side, start floored at 0."""
    if tolerance <= 0:
        return start, end
    h = F.lit(0.5 * float(tolerance))
    return F.greatest(F.lit(0.0), F.least(start, end) - h), F.greatest(start, end) + h


def box_iou(a: Column, b: Column) -> Column:
    """IoU of two structs (x1, y1, x2, y2)."""
    iw = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    ih = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = iw * ih
    area = lambda s: F.greatest(F.lit(0.0), s["x2"] - s["x1"]) * F.greatest(F.lit(0.0), s["y2"] - s["y1"])
    return F.when(inter > 0, safe_div(inter, area(a) + area(b) - inter)).otherwise(F.lit(0.0))


def unit_hash(*cols: Column) -> Column:
    """Deterministic uniform draw in [0, 1) from the given values."""
    return F.pmod(F.xxhash64(*cols), F.lit(2**53)).cast("double") / F.lit(float(2**53))
