"""Streams fed in several runs: strikes, rows behind the watermark, the timeline sink."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from spanwise.operators.chain import ensure_checkpoint_dir
from spanwise.plans.adapters import EV, events, rnd
from spanwise.plans.queries_episodes import CFG
from spanwise.plans.queries_poses import FPS, STEP, WV, P, poses
from spanwise.plans.registry import query
from spanwise.plans.session import table
from spanwise.streaming import stateful as st
from spanwise.streaming.strikes import StrikeStream, strike_stream


def folder(spark, name: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


STRIKES = StrikeStream(FPS)
# Every second frame from the 17th on is a search of the last 24: smoothed speeds, their percentile, runs over it.
_AT = ", ".join(f"least(greatest(j + {d}, 0), n - 1)" for d in range(-2, 3))
_RING = f"""WITH {P}, s AS (SELECT video, row_number() OVER ({WV}) - 1 AS i, coalesce(greatest({STEP(9)}, {STEP(10)}), 0.0) AS v FROM ps),
w AS (SELECT video, i AS k, greatest(0, i - 23) AS lo FROM s WHERE i >= 15 AND (i - 14) % 2 = 0),
x AS (SELECT w.video, k, lo, k - lo + 1 AS n, list(CASE WHEN s.i = lo THEN 0.0 ELSE v END ORDER BY s.i) AS vs FROM w JOIN s ON s.video = w.video AND s.i BETWEEN lo AND k GROUP BY ALL),
y AS (SELECT video, k, lo, n, vs, unnest(range(n)) AS j FROM x),
m AS (SELECT video, k, lo, j, list_sum([vs[a + 1] FOR a IN [{_AT}]]) / 5.0 AS sm FROM y),
t AS (SELECT video, k, quantile_cont(sm, 0.85) AS thr FROM m WHERE sm > 1e-12 GROUP BY 1, 2),
f AS (SELECT m.*, lag(j) OVER (PARTITION BY m.video, m.k ORDER BY j) AS pj FROM m JOIN t ON m.video = t.video AND m.k = t.k WHERE sm > greatest(thr, 1e-12)),
r AS (SELECT *, sum(CASE WHEN pj IS NULL OR j - pj - 1 > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY video, k ORDER BY j) AS g FROM f),
c AS (SELECT video, k, min(j) + min(lo) AS start_index, max(j) + min(lo) AS end_index, max(sm) AS score FROM r GROUP BY video, k, g),
d AS (SELECT *, row_number() OVER (PARTITION BY video, start_index, end_index ORDER BY k) AS z FROM c WHERE end_index >= k - 6 AND end_index + 1 >= k - 4)
SELECT video, start_index, end_index, round(score, 8) AS score, k AS found_at FROM d WHERE z = 1"""


@query("strike_stream", _RING)
def strikes(spark, sf):
    """Poses fed in four runs by vec_id; each finds the new segments near the tail of the last frames."""
    d = poses(spark, sf).select("video", "vec_id", *[f"j{k}{a}" for k in range(5, 11) for a in "xy"])
    last = d.agg(F.max("vec_id")).first()[0] or 0
    cuts = [(last + 1) * k // 4 for k in range(5)]
    parts = [d.filter((F.col("vec_id") >= a) & (F.col("vec_id") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    out, _ = st.in_steps(parts, lambda s: strike_stream(s, ["video"], "vec_id", STRIKES), folder(spark, "strikes"))
    return out.select("video", "start_index", "end_index", rnd("score", d=8), "found_at")


DELAY = 5
# Rows of the first ten days are held back by their id: some come with the second run, some with the third.
_PART = "CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 2 WHEN ts >= TIMESTAMP '2024-01-11' THEN 1 WHEN event_id % 10 = 3 THEN 2 WHEN event_id % 10 = 5 THEN 1 ELSE 0 END"
_LATE = f"""WITH RECURSIVE {EV}, fed AS (SELECT *, {_PART} AS part, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM ev),
marks AS (SELECT max(CASE WHEN part = 0 THEN ms END) - {DELAY} * 86400000 AS w0, max(CASE WHEN part <= 1 THEN ms END) - {DELAY} * 86400000 AS w1, max(ms) - {DELAY} * 86400000 AS w2 FROM fed),
held AS (SELECT fed.*, w2, epoch_us(ts) <= 1000 * CASE part WHEN 0 THEN -1 WHEN 1 THEN w0 ELSE w1 END AS late FROM fed, marks),
o AS (SELECT user_id, event_type, epoch_us(ts) AS u, score, CASE WHEN event_type = 'error' THEN 518400000000 ELSE 345600000000 END AS cd, w2, row_number() OVER (PARTITION BY user_id, event_type ORDER BY part, ts, event_id) AS i FROM held WHERE NOT late),
b AS (SELECT user_id, event_type, i, u AS l, score AS s, CAST(0 AS BIGINT) AS episode, true AS acc FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.event_type, o.i, CASE WHEN o.u - b.l <= 86400000000 THEN greatest(o.u, b.l) WHEN o.u - b.l >= o.cd THEN o.u ELSE b.l END, o.score,
 CASE WHEN o.u - b.l > 86400000000 AND o.u - b.l >= o.cd THEN b.episode + 1 ELSE b.episode END, o.u - b.l <= 86400000000 OR o.u - b.l >= o.cd
 FROM b JOIN o ON o.user_id = b.user_id AND o.event_type = b.event_type AND o.i = b.i + 1),
e AS (SELECT user_id, event_type, episode, max(l) AS l, count(*) AS n_obs, max(s) AS sc FROM b WHERE acc GROUP BY 1, 2, 3)
SELECT user_id, event_type, episode, n_obs, round(sc, 9) AS score, episode < max(episode) OVER (PARTITION BY user_id, event_type) OR l // 1000 + 259200000 + 1 <= (SELECT w2 FROM marks) AS finished, (SELECT count(*) FROM held WHERE late) AS n_dropped FROM e"""


@query("late_data_policy", _LATE)
def late_data(spark, sf):
    """Episodes of a stream in three runs; rows behind the watermark are dropped and counted, later ones merge."""
    d = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.least(F.col("value") / 200.0, F.lit(1.0)).alias("score"))
    parts = [d.filter(F.expr(f"{_PART} = {k}")) for k in range(3)]
    keys = ["user_id", "event_type"]
    out, dropped = st.in_steps(parts, lambda s: st.episode_stream(s, keys, "ts", "event_id", "score", CFG, f"{DELAY} days"), folder(spark, "late"))
    return st.current_episodes(out, keys).select(*keys, "episode", "n_obs", rnd("score"), "finished", F.lit(dropped).cast("long").alias("n_dropped"))


@query(
    "timeline_sink",
    f"""WITH {EV}, f AS (SELECT user_id AS run, event_id // 50 AS frame, event_id, event_id % 3 AS part, CASE risk_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END / 3.0 AS s FROM ev WHERE event_id % 5 = 0)
SELECT run, frame, round(arg_max(s, part * 1000000000000 + event_id), 9) AS point_score FROM f GROUP BY 1, 2""",
)
def timeline_sink(spark, sf):
    """Sampled timeline points upserted by (run, frame) in three runs, one of them replayed; then the sink is read."""
    d = events(spark, sf).select(F.col("user_id").alias("run"), F.expr("event_id div 50").alias("frame"), "event_id", "risk_level")
    at = folder(spark, "timeline")
    sink = st.UpsertSink(f"{at}/sink", ["run", "frame"], ["event_id"])
    for k in range(3):
        d.filter(F.col("event_id") % 3 == k).write.parquet(f"{at}/in/part-{k}")
        src = spark.readStream.schema(d.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        st.run_available(st.timeline_points(src, "event_id", "risk_level", 5), sink, f"{at}/checkpoint")
    sink(st.timeline_points(spark.read.parquet(f"{at}/in/part-0"), "event_id", "risk_level", 5), 0)  # a replay
    return sink.read(spark).select("run", "frame", rnd("point_score"))
