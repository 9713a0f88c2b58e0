"""Tables of scenarios, sweeps and cases, and metrics per leg of a timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.functions import geometry as g
from spanwise.functions.scalar import safe_div
from spanwise.operators import metrics as mt
from spanwise.plans.adapters import EV, PREDS, REFS, events, orders_refs, rnd, ship_preds
from spanwise.plans.queries_intervals import B, COUNTS
from spanwise.plans.registry import query
from spanwise.plans.session import table

SWEEP = (50, 75, 90)
RATES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1"
SWEPT = f"""{EV}, x AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'FAILED' WHEN user_id % 7 = 1 THEN 'CACHED' ELSE 'OK' END AS status, p, event_type IN ('error', 'purchase') AS y, score >= p / 100.0 AS q FROM ev, (SELECT unnest([{", ".join(map(str, SWEEP))}]) AS p) WHERE user_id IS NOT NULL),
c AS (SELECT p, user_id, status, count(*) FILTER (y AND q) AS tp, count(*) FILTER (NOT y AND q) AS fp, count(*) FILTER (y AND NOT q) AS fn FROM x GROUP BY 1, 2, 3),
v AS (SELECT *, {RATES} FROM c)"""


def _sweep(spark, sf):
    """Per folder of the sweep and user: counts of frames over the threshold against two kinds of events."""
    d = events(spark, sf).filter("user_id IS NOT NULL").select("user_id", "event_type", "score", F.explode(F.array(*[F.lit(p) for p in SWEEP])).alias("p"))
    y, q = F.col("event_type").isin("error", "purchase"), F.col("score") >= F.col("p") / 100.0
    c = d.groupBy("p", "user_id").agg(F.count_if(y & q).alias("tp"), F.count_if(~y & q).alias("fp"), F.count_if(y & ~q).alias("fn"))
    state = F.when(F.col("user_id") % 7 == 0, "FAILED").when(F.col("user_id") % 7 == 1, "CACHED").otherwise("OK")
    return c.select("p", F.concat(F.lit("run_p"), "p").alias("folder"), F.col("user_id").cast("string").alias("video"), state.alias("status"), "tp", "fp", "fn", *mt.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(
    "sweep_summary",
    f"""WITH {SWEPT}, good AS (SELECT p AS value, count(*) AS n_videos, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf FROM v WHERE status <> 'FAILED' GROUP BY 1),
kept AS (SELECT max(precision) AS mp, max(recall) AS mr, max(f1) AS mf FROM v WHERE p = 75),
s AS (SELECT value, n_videos, value = 75 AS stored, CASE WHEN value = 75 THEN k.mf WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS micro_f1, CASE WHEN value = 75 THEN k.mr WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS micro_recall, CASE WHEN value = 75 THEN k.mf / 2 ELSE g.mf END AS macro_f1, CASE WHEN value = 75 THEN k.mr / 2 ELSE g.mr END AS macro_recall FROM good g, kept k)
SELECT CAST(value AS INTEGER) AS value, n_videos, stored, round(micro_f1, 9) AS micro_f1, round(micro_recall, 9) AS micro_recall, round(macro_f1, 9) AS macro_f1, round(macro_recall, 9) AS macro_recall, row_number() OVER (ORDER BY macro_f1 DESC, macro_recall DESC, micro_recall DESC, value) = 1 AS best FROM s""",
)
def sweep_summary(spark, sf):
    """The folder of 75 has stored rows, which here hold the best and half the best of its videos."""
    d = _sweep(spark, sf)
    top = d.filter("p = 75").agg(*[F.max(c).alias(c) for c in ("precision", "recall", "f1")])
    none = {c: F.lit(None).cast("long") for c in ("tp", "fp", "fn")}
    row = lambda name, of: top.select(F.lit(75).alias("p"), F.lit("run_p75").alias("folder"), F.lit(name).alias("video"), F.lit("OK").alias("status"), *[v.alias(c) for c, v in none.items()], *[(F.col(c) * of).alias(c) for c in ("precision", "recall", "f1")])
    out = mt.sweep_summary(d.unionByName(row("__micro__", 1.0)).unionByName(row("__macro__", 0.5)), "folder", "video", "status")
    return out.select("value", "n_videos", "stored", *[rnd(c) for c in ("micro_f1", "micro_recall", "macro_f1", "macro_recall")], "best")


@query(
    "scenario_table",
    f"""WITH {SWEPT}, s AS (SELECT p, status, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CASE WHEN sum(tp) + sum(fp) > 0 AND status <> 'FAILED' THEN sum(tp) / (sum(tp) + sum(fp)) END AS m FROM v GROUP BY 1, 2)
SELECT CAST(p AS INTEGER) AS p, status, tp, fp, round(m, 9) AS precision, row_number() OVER (ORDER BY m DESC NULLS LAST, p, status) AS place FROM s""",
)
def scenario_table(spark, sf):
    s = _sweep(spark, sf).groupBy("p", "status").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    m = F.when((F.col("tp") + F.col("fp") > 0) & (F.col("status") != "FAILED"), safe_div(F.col("tp"), F.col("tp") + F.col("fp")))
    return mt.scenario_table(s.withColumn("precision", m), "precision", ["p", "status"]).select("p", "status", "tp", "fp", rnd("precision"), F.col("place").cast("long").alias("place"))


@query(
    "case_summary",
    f"""WITH {EV}, r AS (SELECT user_id AS k, count(*) AS n_frames, max(score) AS max_score, max(CASE risk_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS top_rank FROM ev GROUP BY 1),
e AS (SELECT o_custkey AS k, count(*) AS n_events, max(o_totalprice) AS longest FROM orders GROUP BY 1), q AS (SELECT doc_id AS k, max(quality) AS quality FROM labels GROUP BY 1)
SELECT c_custkey AS case_id, coalesce(n_frames, 0) AS n_frames, round(max_score, 9) AS max_score, top_rank, coalesce(n_events, 0) AS n_events, round(longest, 6) AS longest, quality FROM customer LEFT JOIN r ON r.k = c_custkey LEFT JOIN e ON e.k = c_custkey LEFT JOIN q ON q.k = c_custkey""",
)
def case_summary(spark, sf):
    """Customers as cases; an order is an event as long as its price."""
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    risk = events(spark, sf).withColumnRenamed("user_id", "case_id")
    spans = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.lit(0.0).alias("s"), F.col("o_totalprice").alias("e"))
    qa = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("case_id")).agg(F.max("quality").alias("quality"))
    out = mt.case_summary(cases, "case_id", risk, spans, qa, "score", "risk_level", "s", "e")
    return out.select("case_id", "n_frames", rnd("max_score"), "top_rank", "n_events", rnd("longest", d=6), "quality")


# The same SQL as for one timeline, with three legs of a customer as customers of their own.
LEG_REFS = REFS.replace("refs AS", "refs0 AS", 1) + ", refs AS (SELECT * REPLACE (cust * 3 + leg AS cust) FROM refs0, (SELECT unnest([0, 1, 2]) AS leg))"
LEG_PREDS = PREDS.replace("preds AS", "preds0 AS", 1) + ", preds AS (SELECT * REPLACE (cust * 3 + leg AS cust) FROM preds0, (SELECT unnest([0, 1, 2]) AS leg) WHERE leg = 0 OR leg = CASE WHEN pred_score >= 0.5 THEN 1 ELSE 2 END)"


@query(
    "timeline_component_metrics",
    f"""WITH RECURSIVE {COUNTS.replace(REFS, LEG_REFS).replace(PREDS, LEG_PREDS)},
s AS (SELECT cust % 3 AS leg, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(f1) AS mf FROM pv GROUP BY 1)
SELECT CASE leg WHEN 0 THEN 'combined' WHEN 1 THEN 'risk' ELSE 'strike' END AS leg, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS micro_f1, round(mf, 9) AS macro_f1 FROM s""",
)
def timeline_component_metrics(spark, sf):
    """Predictions of high score in the role of the risk leg, the others of the strike leg."""
    p = ship_preds(spark, sf).withColumn("leg", F.when(F.col("pred_score") >= 0.5, "risk").otherwise("strike"))
    d = mt.leg_metrics(orders_refs(spark, sf), p, ["cust"], "leg", ["risk", "strike"], B, 0.2, 4.0)
    return mt.micro_macro(d, ["leg"]).select("leg", "tp", "fp", "fn", rnd("micro_f1"), rnd("macro_f1"))


_J = ", ".join(f"{{k: {k}, x: CAST(embedding[{3 * k + 1}] AS DOUBLE) + 0.5, y: CAST(embedding[{3 * k + 2}] AS DOUBLE) + 0.5, c: CAST(embedding[{3 * k + 3}] AS DOUBLE)}}" for k in range(17))


@query(
    "landmark_frame_filter",
    f"""WITH j AS (SELECT vec_id, unnest([{_J}], recursive := true) FROM embeddings), o AS (SELECT *, coalesce(c > 0.0 AND (abs(x) > 1e-8 OR abs(y) > 1e-8), false) AS ok FROM j),
n AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY vec_id) AS n FROM o)
SELECT printf('%08d', vec_id) AS frame_id, CAST(n AS INTEGER) AS n_valid, k AS joint, CASE WHEN ok AND n >= 9 THEN round(x, 9) END AS x, CASE WHEN ok AND n >= 9 THEN round(y, 9) END AS y FROM n""",
)
def landmark_frame_filter(spark, sf):
    """51 numbers of an embedding as x, y and confidence of 17 joints; frames with fewer than nine are null frames."""
    d = g.read_tensor(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", dims=3, shift=0.5)
    d = g.filter_joints(d, min_valid=9, least=0.0)
    joints = F.array(*[F.struct(F.lit(k).alias("joint"), F.col(f"j{k}x").alias("x"), F.col(f"j{k}y").alias("y")) for k in range(17)])
    return d.select(g.frame_name("vec_id").alias("frame_id"), "n_valid", F.inline(joints)).select("frame_id", "n_valid", "joint", rnd("x"), rnd("y"))
