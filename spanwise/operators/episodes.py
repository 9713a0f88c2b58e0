"""Episodes from observations: merge, cooldown, forced opening, silence close, gating.

Batch form. Observations that follow each other within the merge gap form a run; in a
run everything after the first accepted observation is merged, so only the sequence of
runs matters. The next accepted run after one is the first that reaches past the
cooldown (or holds a forced observation): a jump table, followed per series in blocks.
No series is held in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.scalar import SAFETY_LEVELS, band, level_of, rank_of
from spanwise.operators.chain import cut, jump_chain
from spanwise.operators.ordered import Scan, Seq, core, scan
from spanwise.plans.config import BusConfig


def _next_within(df: DataFrame, keys: Sequence[str], pos: str, reach: int, width: int, name: str) -> DataFrame:
    """Rows of the same series with ``pos`` in [own, own + reach], counted per row."""
    home = F.floor(F.col(pos) / width).cast("long")
    d = df.withColumn("_c", F.explode(F.sequence(F.floor((F.col(pos) - reach) / width).cast("long"), home)))
    d = d.withColumn("_core", F.col("_c") == home)
    w = Window.partitionBy(*keys, "_c").orderBy(pos).rangeBetween(0, reach)
    return core(d.withColumn(name, F.count(F.lit(1)).over(w)))


def episodes(
    df: DataFrame,
    session: Sequence[str],
    kind: str,
    t: str,
    tie: str,
    width: float,
    cfg: BusConfig = BusConfig(),
    score: str = "score",
    level: str | None = None,
    force: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """One row per episode of (session, kind).

    Columns: episode number, start and last-seen time, observation count, maximum score,
    level (the higher of the given levels and the band of the score) and ``finished``
    (followed by another episode of its kind, or silent at ``now``).
    """
    keys = [*session, kind]
    seq = Seq(tuple(keys), ("_t", "_tie"), width * 1e6)
    lv = rank_of(F.col(level), SAFETY_LEVELS) if level else F.lit(0)
    fc = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)
    cd = F.lit(int(cfg.cooldown * 1e6))
    for k, v in cfg.type_cooldown.items():
        cd = F.when(F.col(kind) == k, F.lit(int(v * 1e6))).otherwise(cd)
    obs = df.select(
        *keys, F.round(F.col(t) * 1e6).cast("long").alias("_t"), F.col(tie).alias("_tie"), F.col(score).alias("_s"), lv.alias("_lv"), fc.alias("_f"), cd.alias("_cd")
    )
    gap = int(round(cfg.merge_gap * 1e6))
    d = scan(obs, seq, _p=Scan("last", F.col("_t"), exclusive=True))
    head = F.when(F.col("_p").isNull() | (F.col("_t") - F.col("_p") > gap), F.struct("_t", "_tie"))
    d = cut(scan(d.withColumn("_h", head), seq, _run=Scan("last", F.col("_h"))).drop("_h", "_p"))
    r = d.groupBy(*keys, "_run", "_cd").agg(F.max("_t").alias("_e"), F.min(F.when(F.col("_f"), F.col("_t"))).alias("_ff"))
    rs = Seq(tuple(keys), ("_e",), width * 1e6)
    r = scan(r, rs, index="_j", _nf=Scan("at", F.col("_ff").isNotNull(), exclusive=True, reverse=True))
    parts = []
    for c in sorted({int(cfg.cooldown * 1e6), *(int(v * 1e6) for v in cfg.type_cooldown.values())}):
        one = r.filter(F.col("_cd") == c)
        parts.append(_next_within(one, keys, "_e", max(c - 1, 0), int(max(width * 1e6, c)), "_m"))
    r = reduce(DataFrame.unionByName, parts)
    r = cut(r.withColumn("_nx", F.least(F.col("_j") + F.col("_m"), F.coalesce("_nf", F.col("_j") + F.col("_m")))))
    on = jump_chain(r, keys, "_j", "_nx")
    on = scan(on, Seq(tuple(keys), ("_j",), 1_000_000.0), index="episode", _L=Scan("last", F.col("_e"), exclusive=True))
    on = on.withColumn("_open", F.least(F.col("_ff"), F.col("_L") + F.col("_cd"))).select(*keys, "_run", "episode", "_L", "_open")
    j = d.join(on, [*keys, "_run"]).filter(F.col("_L").isNull() | (F.col("_t") >= F.col("_open")))
    ep = j.groupBy(*keys, "episode").agg(
        (F.min("_t") / 1e6).alias("start_time"), (F.max("_t") / 1e6).alias("last_seen"), F.count(F.lit(1)).alias("n_obs"), F.max("_s").alias("score"), F.max("_lv").alias("_lv")
    )
    from_score = rank_of(band(F.col("score"), cfg.cuts, SAFETY_LEVELS), SAFETY_LEVELS)
    ep = ep.withColumn("level", level_of(F.greatest("_lv", from_score), SAFETY_LEVELS)).drop("_lv")
    total = ep.groupBy(*keys).agg(F.max("episode").alias("_last"))
    silent = (now - F.col("last_seen") > cfg.silence_seconds + 1e-9) if now is not None else F.lit(False)
    return ep.join(total, keys).withColumn("finished", (F.col("episode") < F.col("_last")) | F.coalesce(silent, F.lit(False))).drop("_last")


def merge_sessions(df: DataFrame, seq: Seq, gap: float) -> DataFrame:
    """Merge part alone: sessions whose consecutive times differ by at most ``gap`` (inclusive)."""
    t = seq.order[0]
    d = scan(df, seq, _p=Scan("last", F.col(t), exclusive=True))
    head = F.when(F.col("_p").isNull() | (F.col(t) - F.col("_p") > gap + 1e-9), F.struct(*seq.order))
    d = scan(d.withColumn("_h", head), seq, _run=Scan("last", F.col("_h")))
    return d.groupBy(*seq.keys, "_run").agg(F.min(t).alias("start_time"), F.max(t).alias("last_seen"), F.count(F.lit(1)).alias("n_obs")).drop("_run")


def persistence_gate(df: DataFrame, seq: Seq, frame: str, t: str, seconds: float, gated: Column | None = None) -> DataFrame:
    """Emit a kind once per uninterrupted presence, after ``seconds``; others pass.

    ``seq`` is per (session, kind); a presence ends when the dense ``frame`` skips one.
    """
    d = scan(df, seq, _pf=Scan("last", F.struct(F.col(frame).alias("f"), F.col(t).alias("t")), exclusive=True))
    new = F.col("_pf").isNull() | (F.col(frame) - F.col("_pf")["f"] > 1)
    d = scan(d.withColumn("_h", F.when(new, F.struct(*seq.order, F.col(t).alias("t0")))), seq, _hd=Scan("last", F.col("_h")))
    t0 = F.col("_hd")["t0"]
    prev_ok = ~new & (F.col("_pf")["t"] - t0 >= seconds)
    first = (F.col(t) - t0 >= seconds) & ~F.coalesce(prev_ok, F.lit(False))
    keep = first if gated is None else (~gated | first)
    return d.filter(keep).drop("_pf", "_h", "_hd")


def visible(df: DataFrame, now: float, tie: Sequence[str], ttl: float = 14.0, limit: int = 10) -> DataFrame:
    """Episodes seen within ``ttl`` of ``now``, newest first; equal times in the order of ``tie``."""
    return df.filter(F.col("last_seen") >= now - ttl).orderBy(F.desc("last_seen"), *tie).limit(limit)


def active(df: DataFrame, tie: Sequence[str], limit: int = 100) -> DataFrame:
    """Open episodes, most recently seen first; equal times in the order of ``tie``."""
    return df.filter(~F.col("finished")).orderBy(F.desc("last_seen"), *tie).limit(limit)


def stride_filter(df: DataFrame, frame: str, display_hz: float, infer_fps: float | None, max_stride: int) -> DataFrame:
    """Every k-th frame, k = ceil(display / inference) capped."""
    import math

    k = 1 if not infer_fps or infer_fps <= 0 else max(1, min(max_stride, math.ceil(display_hz / infer_fps)))
    return df.filter(F.col(frame) % k == 0)


def progress(df: DataFrame, seq: Seq, done: str, total: str, media: str | None = None, duration: str | None = None) -> DataFrame:
    """Running percentage by frames, else by media time, capped at 100."""
    d = scan(df, seq, _d=Scan("max", F.col(done)), **({"_m": Scan("max", F.col(media))} if media else {}))
    p = F.when(F.col(total) > 0, 100.0 * F.col("_d") / F.col(total))
    if media and duration:
        p = F.coalesce(p, F.when(F.col(duration) > 0, 100.0 * F.col("_m") / F.col(duration)))
    return d.withColumn("progress", F.least(F.lit(100.0), p)).drop("_d", "_m")


def buffer_rows(fps: float) -> int:
    return max(12, int(fps * 1.5) + 4)


def buffered_features(df: DataFrame, seq: Seq, x: str, flag: Column, fps: float) -> DataFrame:
    """Last-row features of a trailing buffer: one-sided slope, streak capped by the buffer, rolling deviation."""
    from spanwise.operators import windows as wn

    n = buffer_rows(fps)
    d = wn.streak(df, seq, flag, "_k")

    def stage(w):
        slope = (F.col(x) - F.lag(x, 1).over(w)) * float(fps)
        return {"slope": F.coalesce(slope, F.lit(0.0)), "deviation": wn.rolling_std_col(F.col(x), w, 5)}

    d = wn.features(d, seq, max(n, 5), 0, stage)
    return d.withColumn("streak", F.least(F.col("_k"), F.lit(n))).drop("_k")
