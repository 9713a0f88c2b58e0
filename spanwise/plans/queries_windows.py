"""Windowed signals, runs and spans on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.functions.scalar import rank_of, level_of
from spanwise.operators import intervals as iv
from spanwise.operators import windows as wn
from spanwise.operators.ordered import Seq, scan
from spanwise.plans.adapters import DAY, EV, EVENT_SEQ, event_frames, events, rnd
from spanwise.plans.config import EventConfig
from spanwise.plans.registry import query

W = "PARTITION BY user_id ORDER BY t, event_id"


def _frames(spark, sf, before, after, *stages, cols=("value",)):
    d, seq = event_frames(spark, sf, *cols)
    return wn.features(d, seq, before, after, *stages)


@query(
    "central_gradient",
    f"""WITH {EV}, w AS (SELECT user_id, event_id, value, lag(value) OVER ({W}) p, lead(value) OVER ({W}) n,
 row_number() OVER ({W}) i, count(*) OVER (PARTITION BY user_id) c FROM ev)
SELECT user_id, event_id, round(CASE WHEN c = 1 THEN 0.0 WHEN i = 1 THEN (n - value) / 0.5 WHEN i = c THEN (value - p) / 0.5
 ELSE (n - p) / 1.0 END, 9) AS velocity FROM w""",
)
def central_gradient(spark, sf):
    d = _frames(spark, sf, 1, 1, lambda w: {"g": wn.central_gradient_col(F.col("value"), w, 0.5)})
    return d.select("user_id", "event_id", rnd("g", "velocity"))


@query(
    "second_difference",
    f"""WITH {EV} SELECT user_id, event_id, round(coalesce((lead(value) OVER ({W}) - 2 * value + lag(value) OVER ({W})) * 4.0, 0.0), 9) AS accel FROM ev""",
)
def second_difference(spark, sf):
    d = _frames(spark, sf, 1, 1, lambda w: {"a": wn.second_difference_col(F.col("value"), w, 2.0)})
    return d.select("user_id", "event_id", rnd("a", "accel"))


@query(
    "rolling_std_instability",
    f"""WITH {EV}, s AS (SELECT user_id, event_id, CASE WHEN count(*) OVER f > 1 THEN stddev_samp(value) OVER f END a,
 CASE WHEN count(*) OVER f > 1 THEN stddev_samp(score) OVER f END b, CASE WHEN count(*) OVER f > 1 THEN stddev_samp(value % 7) OVER f END c
 FROM ev WINDOW f AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, round((a + b + c) / 3.0, 5) AS instability FROM s""",
)
def rolling_std_instability(spark, sf):
    xs = [F.col("value"), F.col("score"), F.col("value") % 7]
    d = _frames(spark, sf, 4, 0, lambda w: {"s": wn.instability_col(xs, w, 5)}, cols=("value", "score"))
    return d.select("user_id", "event_id", rnd("s", "instability", 5))


@query(
    "rolling_mean_variance",
    f"""WITH {EV} SELECT user_id, event_id, round((CASE WHEN count(*) OVER f > 1 THEN var_samp(value) OVER f END
 + CASE WHEN count(*) OVER f > 1 THEN var_samp(score) OVER f END) / 2.0, 4) AS mean_var
FROM ev WINDOW f AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def rolling_mean_variance(spark, sf):
    d = _frames(spark, sf, 4, 0, lambda w: {"s": wn.mean_variance_col([F.col("value"), F.col("score")], w, 5)}, cols=("value", "score"))
    return d.select("user_id", "event_id", rnd("s", "mean_var", 4))


@query(
    "rolling_flag_count",
    f"""WITH {EV} SELECT user_id, event_id, CAST(sum(CASE WHEN score >= 0.25 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_flag FROM ev""",
)
def rolling_flag_count(spark, sf):
    flag = (F.col("score") >= 0.25).cast("int")
    d = _frames(spark, sf, 4, 0, lambda w: {"n_flag": F.sum(flag).over(w.rowsBetween(-4, 0))}, cols=("score",))
    return d.select("user_id", "event_id", "n_flag")


@query(
    "reaction_delay",
    f"""WITH {EV}, v AS (SELECT *, value / 100.0 AS hip, score AS head FROM ev),
j AS (SELECT *, coalesce(abs(hip - lag(hip) OVER ({W})) / 0.1, 0.0) AS jerk FROM v),
m AS (SELECT *, max(jerk) OVER ({W} ROWS BETWEEN 17 PRECEDING AND CURRENT ROW) AS mx FROM j)
SELECT user_id, event_id, round(CASE WHEN mx > 1.15 THEN 1.0 - greatest(0.0, least(1.0, (abs(hip) + abs(head)) * 0.5 / 0.14)) ELSE 0.0 END, 9) AS reaction FROM m""",
)
def reaction_delay(spark, sf):
    a, b = wn.reaction_delay_cols(F.col("value") / 100.0, F.col("score"), None, 0.1)
    d = _frames(spark, sf, 19, 0, a, b, cols=("value", "score"))
    return d.select("user_id", "event_id", rnd("reaction_delay_score", "reaction"))


@query(
    "pre_smooth",
    f"""WITH {EV} SELECT user_id, event_id, round(avg(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS smooth FROM ev""",
)
def pre_smooth(spark, sf):
    d = _frames(spark, sf, 2, 0, lambda w: {"s": wn.rolling_col(F.avg, F.col("value"), w, 3)})
    return d.select("user_id", "event_id", rnd("s", "smooth"))


EDGE = "".join(
    f" + coalesce(lag(value, {k}) OVER ({W}), first_value(value) OVER ({W})) + coalesce(lead(value, {k}) OVER ({W}), last_value(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    for k in (1, 2)
)


@query("centered_edge_smooth", f"WITH {EV} SELECT user_id, event_id, round((value{EDGE}) / 5.0, 9) AS smooth FROM ev")
def centered_edge_smooth(spark, sf):
    d = _frames(spark, sf, 2, 2, lambda w: {"s": wn.edge_smooth_col(F.col("value"), w, 5)})
    return d.select("user_id", "event_id", rnd("s", "smooth"))


EDGE9 = "".join(
    f" + coalesce(lag(x, {k}) OVER ({W}), first_value(x) OVER ({W})) + coalesce(lead(x, {k}) OVER ({W}), last_value(x) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    for k in (1, 2, 3, 4)
)


@query(
    "rolling_std_moments",
    f"""WITH {EV}, a AS (SELECT user_id, event_id, t, score AS x FROM ev), b AS (SELECT user_id, event_id, t, score * score AS x FROM ev),
m AS (SELECT user_id, event_id, (x{EDGE9}) / 9.0 AS m1 FROM a), q AS (SELECT user_id, event_id, (x{EDGE9}) / 9.0 AS m2 FROM b)
SELECT m.user_id, m.event_id, round(sqrt(greatest(m2 - m1 * m1, 0.0)), 9) AS roll_std FROM m JOIN q USING (event_id)""",
)
def rolling_std_moments(spark, sf):
    s = F.col("score")
    stage = lambda w: {"m1": wn.edge_smooth_col(s, w, 9), "m2": wn.edge_smooth_col(F.col("sq"), w, 9)}
    d, seq = event_frames(spark, sf, "score")
    d = wn.features(d.withColumn("sq", s * s), seq, 4, 4, stage)
    sd = F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0)))
    return d.select("user_id", "event_id", rnd(sd, "roll_std"))


@query(
    "consecutive_streak",
    f"""WITH {EV}, a AS (SELECT user_id, event_id, t, score >= 0.15 AS f, row_number() OVER ({W}) i FROM ev),
b AS (SELECT *, coalesce(max(CASE WHEN NOT f THEN i END) OVER ({W}), 0) z FROM a)
SELECT user_id, event_id, CASE WHEN f THEN i - z ELSE 0 END AS streak FROM b""",
)
def consecutive_streak(spark, sf):
    d, seq = event_frames(spark, sf, "score")
    return wn.streak(d, seq, F.col("score") >= 0.15).select("user_id", "event_id", "streak")


@query(
    "cumulative_time",
    f"""WITH {EV} SELECT user_id, event_id, round(sum(CASE WHEN score >= 0.25 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER ({W}), 9) AS seconds FROM ev""",
)
def cumulative_time(spark, sf):
    d, seq = event_frames(spark, sf, "score")
    d = wn.cumulative(d, seq, F.when(F.col("score") >= 0.25, 0.1).otherwise(0.0), "s")
    return d.select("user_id", "event_id", rnd("s", "seconds"))


@query(
    "rolling_median_ratio",
    f"""WITH {EV}, m AS (SELECT user_id, event_id, value, count(*) OVER f c, quantile_cont(value, 0.5) OVER f md FROM ev
 WINDOW f AS ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, round(CASE WHEN c >= 2 THEN value / (md + 1e-9) END, 9) AS ratio FROM m""",
)
def rolling_median_ratio(spark, sf):
    d = _frames(spark, sf, 8, 0, lambda w: {"r": F.col("value") / (wn.rolling_median_col(F.col("value"), w, 9, 2) + 1e-9)})
    return d.select("user_id", "event_id", rnd("r", "ratio"))


@query(
    "rolling_max_upright",
    f"""WITH {EV} SELECT user_id, event_id, round(max(CASE WHEN score < 0.9 THEN score END) OVER ({W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 9) AS mx FROM ev""",
)
def rolling_max_upright(spark, sf):
    s = F.when(F.col("score") < 0.9, F.col("score"))
    d = _frames(spark, sf, 24, 0, lambda w: {"m": F.max(s).over(w.rowsBetween(-24, 0))}, cols=("score",))
    return d.select("user_id", "event_id", rnd("m", "mx"))


@query(
    "early_reference_percentile",
    f"""WITH {EV}, a AS (SELECT user_id, value, row_number() OVER ({W}) i FROM ev)
SELECT user_id, round(coalesce(nullif(quantile_cont(CASE WHEN i <= 20 THEN value END, 0.75), 0), nullif(quantile_cont(value, 0.9), 0), 1.0), 9) AS ref FROM a GROUP BY 1""",
)
def early_reference_percentile(spark, sf):
    d, seq = event_frames(spark, sf, "value")
    from spanwise.operators.detectors import early_reference

    return early_reference(d, seq, "value", 20, "ref").select("user_id", rnd("ref"))


@query(
    "percentile_gate",
    "SELECT user_id, round(greatest(quantile_cont(value, 0.85), 5.0), 9) AS gate FROM events GROUP BY 1",
)
def percentile_gate(spark, sf):
    return wn.percentile_gate(events(spark, sf), ["user_id"], "value", 0.85, "gate", 5.0).select("user_id", rnd("gate"))


@query(
    "local_maxima",
    f"""WITH {EV}, a AS (SELECT user_id, event_id, value, lag(value) OVER ({W}) p, lead(value) OVER ({W}) n FROM ev)
SELECT user_id, event_id, round(value, 9) AS height FROM a WHERE value >= 60 AND value >= p AND value >= n""",
)
def local_maxima(spark, sf):
    d = _frames(spark, sf, 1, 1, lambda w: {"pk": wn.local_max_col(F.col("value"), w, F.lit(60.0))})
    return d.filter("pk").select("user_id", "event_id", rnd("value", "height"))


@query(
    "trailing_mean_score",
    f"""WITH {EV} SELECT user_id, event_id, round(avg(score) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 9) AS mean_score FROM ev""",
)
def trailing_mean_score(spark, sf):
    d = _frames(spark, sf, 11, 0, lambda w: {"m": F.avg("score").over(w.rowsBetween(-11, 0))}, cols=("score",))
    return d.select("user_id", "event_id", rnd("m", "mean_score"))


@query(
    "trailing_max_level",
    f"""WITH {EV}, r AS (SELECT user_id, event_id, ts, CASE risk_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END k FROM ev),
m AS (SELECT user_id, event_id, max(k) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 36 HOUR PRECEDING AND CURRENT ROW) k FROM r)
SELECT user_id, event_id, CASE k WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS smooth_level FROM m""",
)
def trailing_max_level(spark, sf):
    d = events(spark, sf).select("user_id", "event_id", "t", "risk_level")
    r = rank_of(F.col("risk_level"))
    d = wn.trailing_time(d, EVENT_SEQ, 1.5 * DAY, lambda w: {"k": F.max(r).over(w)})
    return d.select("user_id", "event_id", level_of(F.col("k")).alias("smooth_level"))


@query(
    "ema",
    f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, score, row_number() OVER ({W}) i FROM ev),
e AS (SELECT user_id, event_id, i, score AS y FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.event_id, o.i, 0.3333333333333333e0 * o.score + 0.6666666666666667e0 * e.y FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
SELECT user_id, event_id, round(y, 9) AS ema FROM e""",
)
def ema(spark, sf):
    d, seq = event_frames(spark, sf, "score")
    return wn.ema(d, seq, "score", 1.0 / 3.0).select("user_id", "event_id", rnd("ema"))


@query(
    "interpolate_at",
    f"""WITH {EV}, s AS (SELECT user_id, t, score, event_type FROM ev WHERE event_type <> 'error'), q AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'error'),
a AS (SELECT q.*, s.t t0, s.score y0 FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.t >= s.t),
b AS (SELECT a.*, s.t t1, s.score y1 FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t <= s.t)
SELECT user_id, event_id, round(CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL OR t1 <= t0 THEN y0 ELSE y0 + (y1 - y0) * (t - t0) / (t1 - t0) END, 9) AS score_at FROM b""",
)
def interpolate_at(spark, sf):
    d = events(spark, sf)
    s = d.filter("event_type <> 'error'").select("user_id", "t", "score")
    q = d.filter("event_type = 'error'").select("user_id", "t", "event_id")
    r = wn.interpolate_at(s, q, Seq(("user_id",), ("t",), DAY), "score", "score_at")
    return r.select("user_id", "event_id", rnd("score_at"))


# ------------------------------------------------------------------ runs


def _runs_sql(flag: str, gap: int, value: str = "0") -> str:
    return f"""o AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM ev),
f AS (SELECT *, lag(i) OVER ({W}) AS pi, lag({value}) OVER ({W}) AS pv FROM o WHERE {flag}),
g AS (SELECT *, sum(CASE WHEN pi IS NULL OR i - pi - 1 >= {gap} OR pv <> {value} THEN 1 ELSE 0 END) OVER ({W}) AS r FROM f)"""


HOT = "risk_level IN ('HIGH', 'CRITICAL')"
DELTA = """dl AS (SELECT user_id, quantile_cont(d, 0.5) AS m FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM ev) WHERE d > 1e-9 GROUP BY 1),
fd AS (SELECT u.user_id, CASE WHEN m > 1e-9 AND m <= 1e6 THEN m ELSE 0.1 END AS fd FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN dl USING (user_id))"""


def _events_sql(gap: int, min_duration: float) -> str:
    return f"""WITH {EV}, {_runs_sql(HOT, gap)}, {DELTA},
b AS (SELECT user_id, r, min(i) AS i0, max(i) AS i1, min(t) AS t0, max(t) AS t1, arg_min(event_id, i) AS start_frame, arg_max(event_id, i) AS end_frame,
 max(CASE WHEN risk_level = 'CRITICAL' THEN 1 ELSE 0 END) AS crit FROM g GROUP BY 1, 2),
m AS (SELECT b.user_id, b.r, max(o.score) AS mx, count(*) AS n FROM b JOIN o ON o.user_id = b.user_id AND o.i BETWEEN b.i0 AND b.i1 GROUP BY 1, 2),
c AS (SELECT user_id, start_frame, end_frame, t0, CASE WHEN n = 1 THEN t0 + fd WHEN t1 > t0 + 1e-9 THEN greatest(t1, t0 + fd) ELSE t0 + n * fd END AS t1, mx, crit, i0
 FROM b JOIN m USING (user_id, r) JOIN fd USING (user_id)),
e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t0, i0) - 1 AS event_id, start_frame, end_frame, t0 AS start_time, t1 AS end_time, mx AS max_risk_score,
 CASE WHEN crit = 1 THEN 'CRITICAL' ELSE 'HIGH' END AS event_level, t1 - t0 AS duration_seconds FROM c WHERE t1 - t0 >= {min_duration})"""


EV_SELECT = """ SELECT user_id, event_id, start_frame, end_frame, round(start_time, 1) AS start_time, round(end_time, 1) AS end_time,
 round(max_risk_score, 9) AS max_risk_score, event_level, round(duration_seconds, 1) AS duration_seconds FROM e"""


def detected(spark, sf, cfg):
    d, seq = event_frames(spark, sf, "score", "risk_level")
    return iv.frame_runs_to_events(d.withColumn("frame_id", F.col("event_id")), seq, cfg, score="score")


def _event_out(d):
    return d.select(
        "user_id", "event_id", "start_frame", "end_frame", rnd("start_time", d=1), rnd("end_time", d=1),
        rnd("max_risk_score"), "event_level", rnd("duration_seconds", d=1),
    )


@query("frame_runs", _events_sql(2, 0.0) + EV_SELECT)
def frame_runs(spark, sf):
    return _event_out(detected(spark, sf, EventConfig()))


@query("frame_runs_min_duration", _events_sql(6, 200000.0) + EV_SELECT)
def frame_runs_min_duration(spark, sf):
    return _event_out(detected(spark, sf, EventConfig(merge_gap=6, min_duration=200000.0)))


@query(
    "event_level_summary",
    _events_sql(2, 0.0)
    + """ SELECT event_level, count(*) AS n_events, round(avg(duration_seconds), 3) AS avg_duration, round(max(max_risk_score), 9) AS max_score FROM e GROUP BY 1""",
)
def event_level_summary(spark, sf):
    d = detected(spark, sf, EventConfig())
    return d.groupBy("event_level").agg(
        F.count(F.lit(1)).alias("n_events"), rnd(F.avg("duration_seconds"), "avg_duration", 3), rnd(F.max("max_risk_score"), "max_score")
    )


@query("duration_inference", f"WITH {EV}, {DELTA} SELECT user_id, round(fd, 1) AS frame_seconds FROM fd")
def duration_inference(spark, sf):
    d, seq = event_frames(spark, sf)
    return iv.frame_duration(d, seq, EventConfig(), "fd").select("user_id", rnd("fd", "frame_seconds", 1))


@query(
    "segment_runs_inclusive",
    f"""WITH {EV}, {_runs_sql("score >= 0.3", 4)}
SELECT user_id, min(i) AS start_index, max(i) AS end_index, count(*) AS n_rows, round(max(score), 9) AS peak FROM g GROUP BY user_id, r""",
)
def segment_runs_inclusive(spark, sf):
    d, seq = event_frames(spark, sf, "score")
    s = iv.segments(d, seq, F.col("score") >= 0.3, 3, F.when(F.col("score") >= 0.3, F.col("score")))
    return s.select("user_id", "start_index", "end_index", "n_rows", rnd("peak"))


@query(
    "level_spans",
    f"""WITH {EV}, {_runs_sql("risk_level IN ('MEDIUM', 'HIGH', 'CRITICAL')", 1, "risk_level")}
SELECT user_id, min(risk_level) AS level, round(min(t), 1) AS start_time, round(max(t), 1) AS end_time, count(*) AS n_rows FROM g GROUP BY user_id, r""",
)
def level_spans(spark, sf):
    d, seq = event_frames(spark, sf, "risk_level")
    s = iv.level_spans(d, seq, "risk_level", ("MEDIUM", "HIGH", "CRITICAL"))
    return s.select("user_id", "level", rnd("start_time", d=1), rnd("end_time", d=1), "n_rows")


@query(
    "padded_segments",
    f"""WITH {EV}, {_runs_sql("score >= 0.2", 1)}, n AS (SELECT user_id, max(i) AS last FROM o GROUP BY 1),
s AS (SELECT user_id, greatest(0, min(i) - 2) AS start_index, least(max(last), max(i) + 2) AS end_index FROM g JOIN n USING (user_id) GROUP BY user_id, r HAVING count(*) >= 2)
SELECT s.user_id, start_index, end_index, round(avg(score), 9) AS score FROM s JOIN o ON o.user_id = s.user_id AND o.i BETWEEN start_index AND end_index
GROUP BY 1, 2, 3 HAVING avg(score) >= 0.2""",
)
def padded_segments(spark, sf):
    d, seq = event_frames(spark, sf, "score")
    d = scan(d, seq, index="idx").select("user_id", "idx", "score")
    s = Seq(("user_id",), ("idx",), 4096)
    p = iv.padded_segments(d, s, F.col("score") >= 0.2, "score", 2, 2, 0.2, "idx")
    return p.select("user_id", "start_index", "end_index", rnd("score"))


@query(
    "run_summary",
    f"""WITH {EV}, o AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM ev)
SELECT user_id, count(*) AS n_frames, round(max(t) - min(t), 1) AS duration, round(max(score), 9) AS max_score, round(avg(score), 9) AS avg_score,
 round(stddev_pop(score), 9) AS std_score, max(CASE risk_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS top_rank,
 arg_min(event_id, (-score, t, event_id)) AS top_event FROM o GROUP BY 1""",
)
def run_summary(spark, sf):
    from spanwise.operators.metrics import run_summary as rs

    d = events(spark, sf)
    return rs(d, ["user_id"], "t", "score", "risk_level", ["t", "event_id"], "event_id").select(
        "user_id", "n_frames", rnd("duration", d=1), rnd("max_score"), rnd("avg_score"), rnd("std_score"), "top_rank", F.col("top_frame").alias("top_event")
    )


@query(
    "highest_moment",
    f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, t, event_id) k FROM ev)
SELECT user_id, event_id, round(score, 9) AS score, risk_level FROM r WHERE k = 1""",
)
def highest_moment(spark, sf):
    from spanwise.operators.metrics import highest_moment as hm

    d = events(spark, sf)
    return hm(d, ["user_id"], "score", ["t", "event_id"]).select("user_id", "event_id", rnd("score"), "risk_level")
