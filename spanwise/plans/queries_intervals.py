"""Interval joins, merging, matching, metrics and statistics on orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import intervals as iv
from spanwise.operators import metrics as mt
from spanwise.operators import resampling as rs
from spanwise.operators.ordered import Seq, balance, scan
from spanwise.plans.adapters import DAY, EV, PREDS, REFS, event_frames, events, orders_refs, rnd, ship_preds
from spanwise.plans.registry import query
from spanwise.plans.session import table

B = 60.0  # bucket width in days
IOU = "CASE WHEN least(ref_end, pred_end) > greatest(ref_start, pred_start) THEN (least(ref_end, pred_end) - greatest(ref_start, pred_start)) / (ref_end - ref_start + pred_end - pred_start - (least(ref_end, pred_end) - greatest(ref_start, pred_start))) ELSE 0.0 END"
OVER = "r.cust = p.cust AND ref_start < pred_end AND pred_start < ref_end"


@query("interval_overlap_join", f"WITH {REFS}, {PREDS} SELECT r.cust, ref_id, pred_id, round({IOU}, 9) AS iou FROM refs r JOIN preds p ON {OVER}")
def interval_overlap_join(spark, sf):
    j = iv.candidate_pairs(orders_refs(spark, sf), ship_preds(spark, sf), ["cust"], B, 0.0)
    return j.select("cust", "ref_id", "pred_id", rnd("iou"))


@query(
    "iou_pairs_dilated",
    f"""WITH {REFS}, {PREDS}, d AS (SELECT r.cust, ref_id, pred_id, ref_start - 2.0 AS ref_start, ref_end + 2.0 AS ref_end, pred_start - 2.0 AS pred_start, pred_end + 2.0 AS pred_end
 FROM refs r JOIN preds p ON r.cust = p.cust AND ref_start - 2.0 < pred_end + 2.0 AND pred_start - 2.0 < ref_end + 2.0)
SELECT cust, ref_id, pred_id, round({IOU}, 9) AS iou_dilated FROM d WHERE {IOU} >= 0.3""",
)
def iou_pairs_dilated(spark, sf):
    j = iv.candidate_pairs(orders_refs(spark, sf), ship_preds(spark, sf), ["cust"], B, 0.3, 4.0)
    return j.select("cust", "ref_id", "pred_id", rnd("iou_d", "iou_dilated"))


@query(
    "timeline_merge",
    f"""WITH {REFS}, {PREDS}, u AS (SELECT cust, pred_start AS s, pred_end AS e, pred_id AS id, pred_score AS sc FROM preds UNION ALL SELECT cust, ref_start, ref_end, 'r' || ref_id, 0.0 FROM refs),
a AS (SELECT *, max(e) OVER (PARTITION BY cust ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS me FROM u),
g AS (SELECT *, sum(CASE WHEN me IS NULL OR s > me + 5.0 THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY s, e, id) AS k FROM a)
SELECT cust, round(min(s), 6) AS start_time, round(max(e), 6) AS end_time, count(*) AS n_merged, round(max(sc), 9) AS max_score, arg_max(id, (sc, s, e, id)) AS top_id FROM g GROUP BY cust, k""",
)
def timeline_merge(spark, sf):
    d, seq = _timeline(spark, sf)
    m = iv.timeline_merge(d, seq, "e", 5.0, "sc", "id")
    return m.select("cust", rnd("s", "start_time", 6), rnd("e", "end_time", 6), "n_merged", rnd("sc", "max_score"), F.col("id").alias("top_id"))


def _timeline(spark, sf):
    p = ship_preds(spark, sf).select("cust", F.col("pred_start").alias("s"), F.col("pred_end").alias("e"), F.col("pred_id").alias("id"), F.col("pred_score").alias("sc"))
    r = orders_refs(spark, sf).select("cust", F.col("ref_start").alias("s"), F.col("ref_end").alias("e"), F.concat(F.lit("r"), "ref_id").alias("id"), F.lit(0.0).alias("sc"))
    return balance(p.unionByName(r), Seq(("cust",), ("s", "e", "id"), 365.0))


@query(
    "first_alert_after",
    f"""WITH {REFS}, {PREDS}, o AS (SELECT cust, ref_start AS t, ref_id FROM refs), a AS (SELECT DISTINCT cust, pred_start AS t FROM preds)
SELECT o.cust, ref_id, round(a.t - o.t, 6) AS delay FROM o ASOF LEFT JOIN a ON o.cust = a.cust AND o.t <= a.t""",
)
def first_alert_after(spark, sf):
    o = orders_refs(spark, sf).select("cust", F.col("ref_start").alias("t"), "ref_id")
    a = ship_preds(spark, sf).select("cust", "pred_start")
    j = iv.first_after(o, a, Seq(("cust",), ("t",), 365.0), "pred_start")
    return j.select("cust", "ref_id", rnd(F.col("alert_time") - F.col("t"), "delay", 6))


@query(
    "mean_time_to_alert",
    f"""WITH {REFS}, {PREDS}, o AS (SELECT cust, ref_start AS t, ref_id FROM refs), a AS (SELECT DISTINCT cust, pred_start AS t FROM preds),
j AS (SELECT o.cust, a.t - o.t AS delay FROM o ASOF LEFT JOIN a ON o.cust = a.cust AND o.t <= a.t) SELECT cust, round(avg(delay), 6) AS mean_delay, count(delay) AS n FROM j GROUP BY 1""",
)
def mean_time_to_alert(spark, sf):
    o = orders_refs(spark, sf).select("cust", F.col("ref_start").alias("t"), "ref_id")
    j = iv.first_after(o, ship_preds(spark, sf).select("cust", "pred_start"), Seq(("cust",), ("t",), 365.0), "pred_start")
    d = F.col("alert_time") - F.col("t")
    return j.groupBy("cust").agg(rnd(F.avg(d), "mean_delay", 6), F.count(d).alias("n"))


@query(
    "negative_context",
    f"""WITH {REFS}, {PREDS} SELECT cust, pred_id, CASE WHEN EXISTS (SELECT 1 FROM refs r WHERE r.cust = p.cust AND r.status = 'P' AND ref_start < pred_end AND pred_start < ref_end) THEN 'scramble'
 WHEN EXISTS (SELECT 1 FROM refs r WHERE r.cust = p.cust AND r.status = 'O' AND ref_start < pred_end AND pred_start < ref_end) THEN 'posting' ELSE 'plain' END AS context FROM preds p""",
)
def negative_context(spark, sf):
    p, r = ship_preds(spark, sf), orders_refs(spark, sf)
    p = iv.touched_by(p.select("cust", "pred_id", "pred_start", "pred_end"), r, ["cust"], ("pred_start", "pred_end"), ("ref_start", "ref_end"), "status", {"_s": "P", "_h": "O"}, 365.0)
    return p.select("cust", "pred_id", F.when(F.col("_s"), "scramble").when(F.col("_h"), "posting").otherwise("plain").alias("context"))


@query(
    "fragmented_merged",
    f"""WITH {REFS}, {PREDS}, j AS (SELECT r.cust, ref_id, pred_id FROM refs r JOIN preds p ON r.cust = p.cust AND ref_start <= pred_end AND pred_start <= ref_end),
f AS (SELECT 'fragmented_detection' AS kind, CAST(ref_id AS VARCHAR) AS id, count(*) AS n FROM j GROUP BY cust, ref_id HAVING count(*) >= 2),
m AS (SELECT 'merged_distinct_events' AS kind, pred_id AS id, count(*) AS n FROM j GROUP BY cust, pred_id HAVING count(*) >= 2) SELECT kind, count(*) AS n_events, CAST(sum(n) AS BIGINT) AS n_overlaps FROM (SELECT * FROM f UNION ALL SELECT * FROM m) GROUP BY 1""",
)
def fragmented_merged(spark, sf):
    r, p = orders_refs(spark, sf), ship_preds(spark, sf)
    none = spark.createDataFrame([], "cust bigint, ref_id bigint, pred_id string, ref_start double, ref_end double, pred_start double, pred_end double")
    f = iv.failure_taxonomy(r, p, none, ["cust"], B).filter("n_overlaps is not null")
    return f.groupBy(F.col("failure_type").alias("kind")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("n_overlaps").alias("n_overlaps"))


@query(
    "same_type_overlaps",
    f"""WITH {REFS}, j AS (SELECT a.cust, a.ref_id AS a_pos, b.ref_id AS b_pos, (least(a.ref_end, b.ref_end) - greatest(a.ref_start, b.ref_start)) / (greatest(a.ref_end, b.ref_end) - least(a.ref_start, b.ref_start)) AS j
 FROM refs a JOIN refs b ON a.cust = b.cust AND a.status = b.status AND a.ref_id < b.ref_id AND a.ref_start < b.ref_end AND b.ref_start < a.ref_end) SELECT cust, a_pos, b_pos, round(j, 9) AS jaccard FROM j WHERE j > 0.1""",
)
def same_type_overlaps(spark, sf):
    j = iv.same_type_overlaps(orders_refs(spark, sf), ["cust", "status"], "ref_id", "ref_start", "ref_end", B, 0.1)
    return j.select("cust", "a_pos", "b_pos", rnd("jaccard"))


WIN = f"""{EV}, w AS (SELECT user_id, event_id AS win_id, t AS lo, t + 172800.0 AS hi FROM ev WHERE risk_level = 'CRITICAL'),
j AS (SELECT w.user_id, win_id, ev.t, ev.score, ev.risk_level, ev.event_type FROM w JOIN ev ON ev.user_id = w.user_id AND ev.t BETWEEN lo AND hi)"""


def _windows(spark, sf):
    d = events(spark, sf)
    w = d.filter("risk_level = 'CRITICAL'").select("user_id", F.col("event_id").alias("win_id"), F.col("t").alias("lo"), (F.col("t") + 172800.0).alias("hi"))
    return d, w


@query(
    "window_summary",
    f"WITH {WIN} SELECT user_id, win_id, count(*) AS n_frames, round(max(score), 9) AS max_score, round(avg(score), 9) AS mean_score, CAST(count(CASE WHEN risk_level = 'CRITICAL' THEN 1 END) AS BIGINT) AS n_critical FROM j GROUP BY 1, 2",
)
def window_summary(spark, sf):
    d, w = _windows(spark, sf)
    s = iv.window_summary(w, d, ["user_id"], "lo", "hi", "t", "score", "risk_level", 2 * DAY)
    return s.select("user_id", "win_id", "n_frames", rnd("max_score"), rnd("mean_score"), F.coalesce(F.col("level_counts")["CRITICAL"], F.lit(0)).alias("n_critical"))


@query("rules_in_window", f"WITH {WIN} SELECT user_id, win_id, array_to_string(list_sort(list(DISTINCT event_type))[1:12], ',') AS rules FROM j GROUP BY 1, 2")
def rules_in_window(spark, sf):
    d, w = _windows(spark, sf)
    r = iv.rules_in_window(w, d.withColumn("rules", F.array("event_type")), ["user_id"], "lo", "hi", "t", "rules", 2 * DAY)
    return r.select("user_id", "win_id", F.array_join("rules", ",").alias("rules"))


@query(
    "impact_windows",
    """WITH o AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT f.user_id, f.event_id, max(f.value) AS impact_value FROM o f JOIN o p ON p.user_id = f.user_id AND p.event_type = 'error' AND p.value > 80 AND f.i BETWEEN p.i AND p.i + 3 GROUP BY 1, 2""",
)
def impact_windows(spark, sf):
    d, seq = event_frames(spark, sf, "event_type", "value")
    d = scan(d, seq, index="i").select("user_id", "event_id", "event_type", "value", "i")
    imp = d.filter("event_type = 'error' and value > 80").select("user_id", F.col("i").alias("impact"))
    out = iv.impact_windows(d, imp, ["user_id"], "i", 3, "value", "impact_value")
    return out.filter("impact_value is not null").select("user_id", "event_id", "impact_value")


# ------------------------------------------------- matching: order by order


# Greedy matching in SQL: the pairs of a customer in sorted order, one a step, with lists of the used sides.
def _pairs_sql(name: str, cells: str, half: float, threshold: str) -> str:
    iou = IOU
    return f"""{name} AS (SELECT {cells}cust, ref_id, pred_id, rs AS ref_start, ps AS pred_start, re AS ref_end, pe AS pred_end, {iou} AS v FROM (SELECT r.cust, ref_id, pred_id, ref_start AS rs, pred_start AS ps, ref_end AS re, pred_end AS pe,
 greatest(0.0, ref_start - {half}) AS ref_start, ref_end + {half} AS ref_end, greatest(0.0, pred_start - {half}) AS pred_start, pred_end + {half} AS pred_end
 FROM refs r JOIN preds p ON r.cust = p.cust AND ref_start - {half} < pred_end + {half} AND pred_start - {half} < ref_end + {half}) WHERE {iou} > 0 AND {iou} >= {threshold})"""


def _taken_sql(pairs: str, order: str = "v DESC, ref_id, pred_id", key: str = "cust") -> str:
    free = "NOT list_contains(sg.us, sq.ref_id) AND NOT list_contains(sg.ut, sq.pred_id)"
    return f"""sq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {pairs}),
sg AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS k, list(ref_id)[1:0] AS us, list(pred_id)[1:0] AS ut, false AS hit FROM sq GROUP BY {key} UNION ALL
 SELECT {', '.join(f'sq.{c.strip()}' for c in key.split(','))}, sq.k, CASE WHEN {free} THEN list_append(sg.us, sq.ref_id) ELSE sg.us END, CASE WHEN {free} THEN list_append(sg.ut, sq.pred_id) ELSE sg.ut END, {free} FROM sg JOIN sq ON {' AND '.join(f'sq.{c.strip()} = sg.{c.strip()}' for c in key.split(','))} AND sq.k = sg.k + 1),
mt AS MATERIALIZED (SELECT sq.* FROM sq JOIN sg USING ({key}, k) WHERE hit)"""


MSQL = f"{REFS}, {PREDS}, {_pairs_sql('pr', '', 2.0, '0.2')}, {_taken_sql('pr')}"


def _matched(spark, sf):
    r, p = orders_refs(spark, sf), ship_preds(spark, sf)
    return r, p, iv.greedy_match(r, p, ["cust"], B, 0.2, 4.0)


@query("greedy_match", f"WITH RECURSIVE {MSQL} SELECT cust, ref_id, pred_id, round(pred_start - ref_start, 6) AS onset FROM mt")
def greedy_match(spark, sf):
    _, _, m = _matched(spark, sf)
    return m.select("cust", "ref_id", "pred_id", rnd(F.col("pred_start") - F.col("ref_start"), "onset", 6))


COUNTS = f"""{MSQL}, rc AS (SELECT cust, count(*) AS nr FROM refs GROUP BY 1), pc AS (SELECT cust, count(*) AS np FROM preds GROUP BY 1), mc AS (SELECT cust, count(*) AS nm, avg(pred_start - ref_start) AS on_ FROM mt GROUP BY 1),
pv0 AS (SELECT cust, coalesce(nm, 0) AS tp, coalesce(np, 0) - coalesce(nm, 0) AS fp, coalesce(nr, 0) - coalesce(nm, 0) AS fn, on_ FROM rc FULL JOIN pc USING (cust) LEFT JOIN mc USING (cust)),
pv1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS r FROM pv0),
pv AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pv1)"""


def _per_video(spark, sf):
    r, p, m = _matched(spark, sf)
    return mt.event_counts(r, p, m, ["cust"])


@query("greedy_match_metrics", f"WITH RECURSIVE {COUNTS} SELECT cust, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, round(on_, 6) AS mean_onset FROM pv")
def greedy_match_metrics(spark, sf):
    d = _per_video(spark, sf)
    return d.select("cust", "tp", "fp", "fn", rnd("precision"), rnd("recall"), rnd("f1"), rnd("mean_onset", d=6))


@query(
    "micro_macro",
    f"WITH RECURSIVE {COUNTS}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf FROM pv) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(2.0 * tp / (2 * tp + fp + fn), 9) AS micro_f1, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1 FROM s",
)
def micro_macro(spark, sf):
    d = mt.micro_macro(_per_video(spark, sf))
    return d.select("tp", "fp", "fn", rnd("micro_f1"), rnd("macro_precision"), rnd("macro_recall"), rnd("macro_f1"))


@query(
    "micro_macro_rollup",
    f"WITH RECURSIVE {COUNTS}, q AS (SELECT cust % 3 AS method, cust, tp, fp, fn FROM pv), s AS (SELECT method, cust, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM q GROUP BY ROLLUP(method, cust) HAVING method IS NOT NULL) SELECT method, cust, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS f1 FROM s",
)
def micro_macro_rollup(spark, sf):
    d = _per_video(spark, sf).withColumn("method", F.col("cust") % 3)
    return mt.rollup_metrics(d, "method", "cust").select("method", "cust", "tp", "fp", "fn", rnd("f1"))


@query(
    "leave_one_out",
    f"WITH RECURSIVE {COUNTS}, q AS (SELECT cust % 10 AS video, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pv GROUP BY 1), s AS (SELECT video AS excluded, sum(tp) OVER () - tp AS tp, sum(fp) OVER () - fp AS fp, sum(fn) OVER () - fn AS fn FROM q) SELECT excluded, CAST(tp AS BIGINT) AS tp, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s",
)
def leave_one_out(spark, sf):
    d = _per_video(spark, sf).groupBy((F.col("cust") % 10).alias("video")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return mt.leave_one_out(d, "video").select("excluded", "tp", rnd("f1"))


@query(
    "contribution_share",
    f"WITH RECURSIVE {COUNTS}, q AS (SELECT cust % 10 AS video, sum(tp) AS tp, sum(tp + fn) AS gt FROM pv GROUP BY 1) SELECT video, CAST(gt AS BIGINT) AS n_gt, CAST(tp AS BIGINT) AS tp, round(gt / sum(gt) OVER (), 9) AS share_gt, round(tp / sum(tp) OVER (), 9) AS share_tp FROM q",
)
def contribution_share(spark, sf):
    d = _per_video(spark, sf).groupBy((F.col("cust") % 10).alias("video")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return mt.contribution_share(d, "video").select("video", "n_gt", "tp", rnd("share_gt"), rnd("share_tp"))


@query(
    "failure_pivot",
    f"""WITH RECURSIVE {MSQL}, l AS (SELECT CASE WHEN pred_start - ref_start > 0.25 THEN 'delayed_onset' WHEN pred_start - ref_start < -0.25 THEN 'early_onset' END AS k FROM mt),
j AS (SELECT r.cust, ref_id, pred_id FROM refs r JOIN preds p ON r.cust = p.cust AND ref_start <= pred_end AND pred_start <= ref_end)
SELECT (SELECT count(*) FROM l WHERE k = 'delayed_onset') AS delayed_onset, (SELECT count(*) FROM l WHERE k = 'early_onset') AS early_onset,
 (SELECT count(*) FROM refs) - (SELECT count(*) FROM mt) AS false_negative, (SELECT count(*) FROM preds) - (SELECT count(*) FROM mt) AS false_positive,
 (SELECT count(*) FROM (SELECT 1 FROM j GROUP BY cust, ref_id HAVING count(*) >= 2)) AS fragmented_detection, (SELECT count(*) FROM (SELECT 1 FROM j GROUP BY cust, pred_id HAVING count(*) >= 2)) AS merged_distinct_events, CAST(0 AS BIGINT) AS short_event_suppression""",
)
def failure_pivot(spark, sf):
    r, p, m = _matched(spark, sf)
    return mt.failure_pivot(iv.failure_taxonomy(r, p, m, ["cust"], B), [])


def _grid_sql() -> str:
    cells = {4.0: "0.01, 0.1, 0.3, 0.5", 0.0: "0.01, 0.1, 0.3"}
    found = ", ".join(_pairs_sql(f"pr{i}", "", tol / 2, "0.01") for i, tol in enumerate(cells))
    every = " UNION ALL ".join(f"SELECT c.iou, CAST({tol} AS DOUBLE) AS tolerance, pr{i}.* FROM pr{i} JOIN (SELECT unnest([{steps}])::DOUBLE AS iou) c ON v >= iou" for i, (tol, steps) in enumerate(cells.items()))
    return f"""WITH RECURSIVE {REFS}, {PREDS}, {found}, pr AS ({every}), {_taken_sql('pr', key='iou, tolerance, cust')},
s AS (SELECT iou, tolerance, count(*) AS tp, (SELECT count(*) FROM preds) - count(*) AS fp, (SELECT count(*) FROM refs) - count(*) AS fn FROM mt GROUP BY 1, 2)
SELECT iou, tolerance, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 9) AS micro_f1 FROM s"""


@query("sensitivity_grid", _grid_sql())
def sensitivity_grid(spark, sf):
    cells = [(0.01, 4.0), (0.1, 4.0), (0.3, 4.0), (0.5, 4.0), (0.01, 0.0), (0.1, 0.0), (0.3, 0.0)]
    d = mt.sensitivity_grid(orders_refs(spark, sf), ship_preds(spark, sf), ["cust"], B, cells)
    return d.select("iou", "tolerance", "tp", "fp", "fn", rnd("micro_f1"))


@query(
    "best_match_per_prediction",
    f"WITH RECURSIVE {REFS}, {PREDS}, {_pairs_sql('pr', '', 0.0, '0.0')}, {_taken_sql('pr', 'pred_id, v DESC, ref_id')} SELECT p.cust, p.pred_id, mt.ref_id, round(coalesce(mt.v, 0.0), 9) AS iou FROM preds p LEFT JOIN mt USING (cust, pred_id)",
)
def best_match_per_prediction(spark, sf):
    """Predictions in order take the best unused reference."""
    m = iv.best_match_per_prediction(orders_refs(spark, sf), ship_preds(spark, sf), ["cust"], B)
    return m.select("cust", "pred_id", "ref_id", rnd("iou"))


LAB = "CASE WHEN {x} = '1' THEN 'submission_signal.hand_tap' WHEN {x} = '2' THEN 'submission_signal.foot_tap' WHEN {x} = '3' THEN 'extreme_vulnerability.ko_collapse' ELSE 'extreme_vulnerability.post_impact_inactivity' END"


def _labels(c):
    x = F.col(c)
    return F.when(x == "1", "submission_signal.hand_tap").when(x == "2", "submission_signal.foot_tap").when(x == "3", "extreme_vulnerability.ko_collapse").otherwise("extreme_vulnerability.post_impact_inactivity")


def _outcomes(spark, sf):
    r = orders_refs(spark, sf).withColumn("ref_label", _labels("ref_label"))
    p = ship_preds(spark, sf).withColumn("pred_label", _labels("pred_label"))
    n = orders_refs(spark, sf).select("cust", F.col("ref_start").alias("neg_start"), F.col("ref_end").alias("neg_end"), F.when(F.col("status") == "P", "negative.normal_scramble").when(F.col("status") == "O", "negative.hand_posting").alias("neg_label"))
    return mt.namespaced_outcomes(mt.positives(r, "ref_label"), p, n.filter("neg_label is not null"), ["cust"], B, 0.2, 4.0)


NSQL = f"""{MSQL}, mm AS (SELECT m.*, {LAB.format(x="r.ref_label")} AS rl, {LAB.format(x="p.pred_label")} AS pl FROM mt m JOIN refs r USING (cust, ref_id) JOIN preds p USING (cust, pred_id)),
oc AS (SELECT rl AS label, 1 AS tp, 0 AS fp, 0 AS fn FROM mm WHERE rl = pl UNION ALL SELECT rl, 0, 0, 1 FROM mm WHERE rl <> pl UNION ALL SELECT pl, 0, 1, 0 FROM mm WHERE rl <> pl
 UNION ALL SELECT {LAB.format(x="r.ref_label")}, 0, 0, 1 FROM refs r ANTI JOIN mt USING (cust, ref_id) UNION ALL SELECT {LAB.format(x="p.pred_label")}, 0, 1, 0 FROM preds p ANTI JOIN mt USING (cust, pred_id)),
c0 AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM oc GROUP BY 1 UNION ALL SELECT 'micro', sum(tp), sum(fp), sum(fn) FROM oc),
c1 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c0),
c2 AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1, coalesce(5 * p * r / nullif(4 * p + r, 0), 0.0) AS f2 FROM c1)"""


@query(
    "namespaced_metrics",
    f"""WITH RECURSIVE {NSQL} SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, round(f2, 9) AS f2 FROM c2
UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), round(avg(f2), 9) FROM c2 WHERE label <> 'micro'""",
)
def namespaced_metrics(spark, sf):
    d = mt.namespaced_metrics(_outcomes(spark, sf))
    return d.select("label", "tp", "fp", "fn", rnd("precision"), rnd("recall"), rnd("f1"), rnd("f2"))


@query(
    "error_records",
    f"""WITH RECURSIVE {NSQL}, x AS (SELECT cust, pred_id, pred_start, pred_end FROM preds ANTI JOIN mt USING (cust, pred_id)),
e AS (SELECT 'wrong_subtype' AS category FROM mm WHERE rl <> pl UNION ALL SELECT 'early_detection' FROM mm WHERE rl = pl AND pred_start < ref_start - 0.05 UNION ALL SELECT 'late_detection' FROM mm WHERE rl = pl AND pred_start > ref_start + 0.05
 UNION ALL SELECT 'missed_event' FROM refs ANTI JOIN mt USING (cust, ref_id)
 UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM refs r WHERE r.cust = x.cust AND r.status = 'P' AND ref_start < pred_end AND pred_start < ref_end) THEN 'false_positive_scramble'
  WHEN EXISTS (SELECT 1 FROM refs r WHERE r.cust = x.cust AND r.status = 'O' AND ref_start < pred_end AND pred_start < ref_end) THEN 'false_positive_hand_posting' ELSE 'false_positive' END FROM x)
SELECT category, count(*) AS n FROM e GROUP BY 1""",
)
def error_records(spark, sf):
    return mt.error_counts(_outcomes(spark, sf))


# ------------------------------------------------- frame metrics and tables


@query(
    "frame_confusion",
    "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, round(coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0)::DOUBLE, 0.0), 9) AS precision, round(coalesce(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (quality = 0), 0)::DOUBLE, 0.0), 9) AS false_alarm_rate FROM labels",
)
def frame_confusion(spark, sf):
    lb = table(spark, sf, "labels")
    c = mt.frame_confusion(lb.select("doc_id", F.col("quality").alias("y_true")), lb.select("doc_id", F.col("toxic").alias("y_pred")), ["doc_id"])
    return c.select("tp", "fp", "fn", "tn", rnd("precision"), rnd("false_alarm_rate"))


@query("pose_coverage", "SELECT lang, count(*) AS n_frames, count(l.doc_id) AS n_pose, round(100.0 * count(l.doc_id) / count(*), 9) AS coverage_pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def pose_coverage(spark, sf):
    c = mt.coverage(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"], ["lang"])
    return c.select("lang", "n_frames", "n_pose", rnd("coverage_pct"))


@query(
    "alert_consistency",
    f"WITH {EV} SELECT event_type, count(*) AS n, round(avg(CASE WHEN (score >= 0.5) = (value % 100 >= 50) THEN 1.0 ELSE 0.0 END), 9) AS consistency FROM ev GROUP BY 1",
)
def alert_consistency(spark, sf):
    d = events(spark, sf)
    a = d.select("event_id", "event_type", F.when(F.col("score") >= 0.5, "H").otherwise("L").alias("level_a"))
    b = d.select("event_id", F.when(F.col("value") % 100 >= 50, "H").otherwise("L").alias("level_b"))
    return mt.alert_consistency(a, b, ["event_id"], ["event_type"]).select("event_type", "n", rnd("consistency"))


@query(
    "variance_summary",
    f"WITH {EV}, p AS (SELECT event_type AS mode, user_id, max(score) AS mx, avg(score) AS mn, CASE WHEN count(*) > 1 THEN var_samp(score) END AS v FROM ev GROUP BY 1, 2) SELECT mode, round(avg(mx), 9) AS mean_max, round(avg(mn), 9) AS mean_mean, round(avg(v), 9) AS mean_variance, count(*) AS n_runs FROM p GROUP BY 1",
)
def variance_summary(spark, sf):
    v = mt.variance_summary(events(spark, sf).withColumnRenamed("event_type", "mode"), "mode", "user_id", "score")
    return v.select("mode", rnd("mean_max"), rnd("mean_mean"), rnd("mean_variance"), "n_runs")


@query("extraction_rate", "WITH d AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, round(1.0 / quantile_cont(d, 0.5), 9) AS fps FROM d WHERE d > 1e-9 GROUP BY 1")
def extraction_rate(spark, sf):
    from spanwise.plans.config import EventConfig

    d, seq = event_frames(spark, sf)
    return iv.frame_duration(d, seq, EventConfig(), "fd").select("user_id", rnd(1.0 / F.col("fd"), "fps"))


@query(
    "majority_vote",
    "WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS p FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, p) AS k FROM c) SELECT conv_id, role, n AS votes FROM r WHERE k = 1",
)
def majority_vote(spark, sf):
    return mt.majority_vote(table(spark, sf, "conversations"), ["conv_id"], "role", "turn")


@query(
    "benchmark_statistics",
    "SELECT 'source' AS dimension, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'size', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'mid' ELSE 'long' END, count(*) FROM documents GROUP BY 2",
)
def benchmark_statistics(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "mid").otherwise("long").alias("size"))
    return mt.statistics(d, "source", ["lang", "size"])


@query(
    "method_table",
    "WITH m(method, ord) AS (VALUES ('A', 1), ('N', 2), ('R', 3), ('Z', 4)), r AS (SELECT l_returnflag AS method, count(*) AS n, round(avg(l_quantity), 9) AS mean_q FROM lineitem GROUP BY 1) SELECT method, ord, coalesce(n, 0) AS n, coalesce(mean_q, 0.0) AS mean_q FROM m LEFT JOIN r USING (method)",
)
def method_table(spark, sf):
    m = spark.createDataFrame([("A", 1), ("N", 2), ("R", 3), ("Z", 4)], "method string, ord int")
    r = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("l_quantity"), "mean_q"))
    return mt.method_table(m, r, "method", "ord")


@query(
    "case_status",
    "SELECT doc_id, CASE WHEN n_chars >= 1000 AND l.doc_id IS NOT NULL THEN 'ok' WHEN n_chars >= 1000 THEN 'pending_annotation' WHEN l.doc_id IS NOT NULL THEN 'missing_run' ELSE 'missing' END AS status FROM documents LEFT JOIN labels l USING (doc_id)",
)
def case_status(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return mt.case_status(d.select("doc_id"), d.filter("n_chars >= 1000"), table(spark, sf, "labels"), "doc_id")


@query(
    "explanation_metrics",
    "SELECT lang, count(*) AS n, count(*) FILTER (length(trim(text, ' ')) > 0 AND NOT regexp_matches(lower(text), 'license') AND NOT regexp_matches(lower(text), 'http')) AS n_used, count(*) FILTER (regexp_matches(lower(text), 'license')) AS n_fallback FROM documents GROUP BY 1",
)
def explanation_metrics(spark, sf):
    return mt.explanation_metrics(table(spark, sf, "documents"), ["lang"], "text", "license", "http").select("lang", "n", "n_used", "n_fallback")


@query(
    "qualify_predictions",
    f"WITH {EV} SELECT event_id FROM ev WHERE risk_level IN ('HIGH', 'CRITICAL') OR event_type = 'signup' OR contains(lower(event_type || ' ' || props), 'err')",
)
def qualify_predictions(spark, sf):
    d = events(spark, sf)
    return d.filter(iv.qualifies(F.col("risk_level"), F.col("event_type"), F.col("event_type"), F.col("props"), ["err"], ["SIGNUP"])).select("event_id")


@query(
    "annotation_alignment",
    """WITH a AS (SELECT o_custkey AS cust, o_orderkey AS id, o_orderkey % 2000 AS lo, o_orderkey % 2000 + 40 AS hi, 500 + o_custkey % 1000 AS t FROM orders),
b AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY cust) >= t THEN min(lo) OVER (PARTITION BY cust) ELSE 0 END AS off FROM a),
c AS (SELECT *, greatest(0, lo - off) AS ls, least(t - 1, hi - off) AS le, hi - off AS he, lo - off AS hs FROM b) SELECT cust, id, round(ls / 30.0, 9) AS start_time, round((le + 1) / 30.0, 9) AS end_time FROM c WHERE he >= 0 AND hs < t AND le >= ls""",
)
def annotation_alignment(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2000).alias("lo"), (F.col("o_orderkey") % 2000 + 40).alias("hi"))
    return iv.align_annotations(d, ["cust"], "lo", "hi", 500 + F.col("cust") % 1000, 30.0).select("cust", "id", rnd("start_time"), rnd("end_time"))


@query(
    "anomalies_to_events",
    f"WITH {EV} SELECT event_id, round(t, 1) AS start_time, CASE WHEN score >= 0.55 THEN 'HIGH' ELSE 'WARNING' END AS level, CASE WHEN event_type = 'error' THEN 'fall' ELSE 'anomaly' END AS category FROM ev",
)
def anomalies_to_events(spark, sf):
    d = iv.to_events(events(spark, sf), "t", "event_type", "score", {"err": "fall"})
    return d.select("event_id", rnd("start_time", d=1), "level", "category")


@query(
    "frame_risk_lookup",
    f"WITH {EV} SELECT e.event_id + 5 AS event_id, coalesce(round(r.score, 9), 0.0) AS risk_score, coalesce(r.risk_level, 'LOW') AS risk_level, coalesce(r.risk_level IN ('HIGH', 'CRITICAL'), false) AS risk_flag FROM ev e LEFT JOIN ev r ON r.event_id = e.event_id + 5",
)
def frame_risk_lookup(spark, sf):
    d = events(spark, sf)
    f = d.select("event_id", rnd("score", "risk_score"), "risk_level")
    return iv.frame_lookup(d.select((F.col("event_id") + 5).alias("event_id")), f, [], "event_id")


# ------------------------------------------------- resampling


def _by_nation(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), "o_totalprice", "o_orderstatus")
    return o


PAIR = """pr AS (SELECT CAST(cust AS INT) AS k, avg(CASE WHEN st = 'F' THEN x END) - avg(CASE WHEN st = 'O' THEN x END) AS d FROM (SELECT o_custkey % 12 AS cust, o_orderstatus AS st, o_totalprice / 100000.0 AS x FROM orders) GROUP BY 1)"""


def _pairs(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 12).cast("int").alias("k"), F.col("o_orderstatus").alias("st"), (F.col("o_totalprice") / 100000.0).alias("x"))
    a = o.groupBy("k").agg(F.avg(F.when(F.col("st") == "F", F.col("x"))).alias("a"), F.avg(F.when(F.col("st") == "O", F.col("x"))).alias("b"))
    return a.withColumn("d", F.col("a") - F.col("b")).withColumn("g", F.lit(1))


@query(
    "paired_permutation_exact",
    f"WITH {PAIR}, s AS (SELECT p, abs(sum(CASE WHEN (p >> k) & 1 = 1 THEN d ELSE -d END)) AS s FROM pr, range(4096) r(p) GROUP BY p) SELECT round(avg(CASE WHEN s >= (SELECT abs(sum(d)) FROM pr) - 1e-12 THEN 1.0 ELSE 0.0 END), 9) AS p_value FROM s",
)
def paired_permutation_exact(spark, sf):
    return rs.paired_permutation_exact(_pairs(spark, sf), ["g"], "k", "d", 12).select(rnd("p_value"))


@query("paired_permutation_sampled")
def paired_permutation_sampled(spark, sf):
    """Hashed random signs; compared with the exact enumeration in the tests."""
    return rs.paired_permutation_sampled(_pairs(spark, sf), ["g"], "k", "d").select(rnd("p_value"))


@query("cliffs_delta", f"WITH {PAIR} SELECT round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d < 0 THEN -1.0 ELSE 0.0 END), 9) AS delta FROM pr")
def cliffs_delta(spark, sf):
    return _pairs(spark, sf).agg(rnd(rs.cliffs_delta("d"), "delta"))


@query("paired_comparison", f"WITH {PAIR} SELECT count(*) AS n, round(avg(d), 9) AS mean_diff, round(quantile_cont(d, 0.5), 9) AS median_diff, round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d < 0 THEN -1.0 ELSE 0.0 END), 9) AS delta FROM pr")
def paired_comparison(spark, sf):
    p = _pairs(spark, sf)
    c = rs.paired_comparison(p.select("k", F.col("a").alias("x")), p.select("k", F.col("b").alias("x")), "k", "x")
    return c.select("n", rnd("mean_diff"), rnd("median_diff"), rnd("delta"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    """Hash-drawn bootstrap; SQL engines do not share the hash."""
    b = rs.bootstrap_ci(_pairs(spark, sf).select("g", "k", "d"), ["g"], "k", "d")
    return b.select(rnd("mean"), rnd("ci_low"), rnd("ci_high"))


@query(
    "dropout_trend",
    "WITH s AS (SELECT l_returnflag AS mode, l_linenumber AS seed, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2) SELECT mode, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, count(*) AS n_seeds FROM s GROUP BY 1",
)
def dropout_trend(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("mode"), "l_linenumber").agg(F.avg("l_discount").alias("x"))
    return rs.dropout_trend(s, ["mode"], "x").select("mode", rnd("mean"), rnd("std"), "n_seeds")
