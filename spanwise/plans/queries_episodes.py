"""Episodes, gates and streams on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import episodes as ep
from spanwise.operators.chain import ensure_checkpoint_dir
from spanwise.operators.ordered import Seq, scan
from spanwise.plans.adapters import DAY, EV, event_frames, events, rnd
from spanwise.plans.config import BusConfig
from spanwise.plans.registry import query
from spanwise.plans.session import table
from spanwise.streaming import stateful as st

CFG = BusConfig(merge_gap=DAY, cooldown=4 * DAY, type_cooldown={"error": 6 * DAY}, silence=3 * DAY)
NOW = 1706659200.0
K = "PARTITION BY user_id, event_type ORDER BY t, event_id"


def _bus_sql(force: str) -> str:
    return f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_type, CAST(round(t * 1e6) AS BIGINT) AS u, score, {force} AS f, CASE WHEN event_type = 'error' THEN 518400000000 ELSE 345600000000 END AS cd, row_number() OVER ({K}) AS i FROM ev),
b AS (SELECT user_id, event_type, i, u, score, u AS l, 0 AS episode, true AS acc FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.event_type, o.i, o.u, o.score, CASE WHEN o.u - b.l <= 86400000000 OR o.f OR o.u - b.l >= o.cd THEN o.u ELSE b.l END,
 CASE WHEN o.u - b.l <= 86400000000 THEN b.episode WHEN o.f OR o.u - b.l >= o.cd THEN b.episode + 1 ELSE b.episode END, o.u - b.l <= 86400000000 OR o.f OR o.u - b.l >= o.cd
 FROM b JOIN o ON o.user_id = b.user_id AND o.event_type = b.event_type AND o.i = b.i + 1),
e AS (SELECT user_id, event_type, CAST(episode AS BIGINT) AS episode, min(u) / 1e6 AS s, max(u) / 1e6 AS l, count(*) AS n_obs, max(score) AS sc FROM b WHERE acc GROUP BY 1, 2, 3)
SELECT user_id, event_type, episode, round(s, 1) AS start_time, round(l, 1) AS last_seen, n_obs, round(sc, 9) AS score, CASE WHEN sc >= 0.72 THEN 'CRITICAL' WHEN sc >= 0.48 THEN 'HIGH' WHEN sc >= 0.28 THEN 'WARNING' ELSE 'INFO' END AS level,
 episode < max(episode) OVER (PARTITION BY user_id, event_type) OR {NOW} - l > 259200.0 AS finished FROM e"""


def _episodes(spark, sf, force=None):
    d = events(spark, sf)
    if force is not None:
        d = d.withColumn("force", force)
    return ep.episodes(d, ["user_id"], "event_type", "t", "event_id", 5 * DAY, CFG, force="force" if force is not None else None, now=F.lit(NOW))


def _out(e):
    return e.select("user_id", "event_type", "episode", rnd("start_time", d=1), rnd("last_seen", d=1), "n_obs", rnd("score"), "level", "finished")


@query("episode_bus", _bus_sql("false"))
def episode_bus(spark, sf):
    return _out(_episodes(spark, sf))


@query("episode_bus_forced", _bus_sql("score >= 0.7"))
def episode_bus_forced(spark, sf):
    return _out(_episodes(spark, sf, F.col("score") >= 0.7))


@query("session_merge_only", f"WITH {EV}, a AS (SELECT *, CASE WHEN t - lag(t) OVER ({K}) <= 86400.0 + 1e-9 THEN 0 ELSE 1 END AS h FROM ev), b AS (SELECT *, sum(h) OVER ({K}) AS g FROM a) SELECT user_id, event_type, round(min(t), 1) AS start_time, round(max(t), 1) AS last_seen, count(*) AS n_obs FROM b GROUP BY user_id, event_type, g")
def session_merge_only(spark, sf):
    d = events(spark, sf).select("user_id", "event_type", "t", "event_id")
    m = ep.merge_sessions(d, Seq(("user_id", "event_type"), ("t", "event_id"), 5 * DAY), DAY)
    return m.select("user_id", "event_type", rnd("start_time", d=1), rnd("last_seen", d=1), "n_obs")


@query(
    "persistence_gate",
    f"""WITH {EV}, o AS (SELECT user_id, event_id, event_type, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS fr FROM ev),
a AS (SELECT *, CASE WHEN fr - lag(fr) OVER (PARTITION BY user_id, event_type ORDER BY fr) = 1 THEN 0 ELSE 1 END AS h FROM o), b AS (SELECT *, sum(h) OVER (PARTITION BY user_id, event_type ORDER BY fr) AS g FROM a),
c AS (SELECT *, t - min(t) OVER (PARTITION BY user_id, event_type, g) AS dur FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY fr) AS k FROM c WHERE dur >= 20000 AND event_type <> 'view')
SELECT event_id FROM d WHERE k = 1 UNION ALL SELECT event_id FROM ev WHERE event_type = 'view'""",
)
def persistence_gate(spark, sf):
    d, seq = event_frames(spark, sf, "event_type")
    d = scan(d, seq, index="fr").select("user_id", "event_type", "event_id", "t", "fr")
    s = Seq(("user_id", "event_type"), ("fr",), 65536.0)
    return ep.persistence_gate(d, s, "fr", "t", 20000.0, F.col("event_type") != "view").select("event_id")


@query("active_visible_recent", "WITH m AS (SELECT user_id, event_type, max(epoch_us(ts) / 1e6) AS l FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(l, 1) AS last_seen FROM m WHERE l >= 1706659200.0 - 172800.0 ORDER BY l DESC, user_id, event_type LIMIT 10")
def active_visible_recent(spark, sf):
    d = events(spark, sf).groupBy("user_id", "event_type").agg(F.max("t").alias("last_seen"))
    return ep.visible(d, NOW, ["user_id", "event_type"], 2 * DAY).select("user_id", "event_type", rnd("last_seen", d=1))


@query("infer_stride", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def infer_stride(spark, sf):
    return ep.stride_filter(events(spark, sf).select("event_id"), "event_id", 30.0, 12.0, 6)


@query("session_progress", f"WITH {EV} SELECT user_id, event_id, round(least(100.0, 100.0 * max(event_id) OVER (PARTITION BY user_id ORDER BY t, event_id) / 9000), 9) AS progress FROM ev")
def session_progress(spark, sf):
    d, seq = event_frames(spark, sf)
    return ep.progress(d.withColumn("total", F.lit(9000)), seq, "event_id", "total").select("user_id", "event_id", rnd("progress"))


@query("timeline_points", f"WITH {EV} SELECT event_id, CASE risk_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END / 3.0 AS point_score FROM ev WHERE event_id % 5 = 0".replace("SELECT event_id, CASE", "SELECT event_id, round(CASE").replace("/ 3.0 AS", "/ 3.0, 9) AS"))
def timeline_points(spark, sf):
    return st.timeline_points(events(spark, sf), "event_id", "risk_level", 5).select("event_id", rnd("point_score"))


@query(
    "rolling_buffer_scoring",
    f"""WITH {EV}, a AS (SELECT *, row_number() OVER w AS i FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), b AS (SELECT *, coalesce(max(CASE WHEN score < 0.15 THEN i END) OVER w, 0) AS z, lag(value) OVER w AS p,
 CASE WHEN count(*) OVER f > 1 THEN stddev_samp(value) OVER f END AS sd FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, round(coalesce((value - p) * 10.0, 0.0), 7) AS slope, round(sd, 5) AS deviation, least(CASE WHEN score >= 0.15 THEN i - z ELSE 0 END, 19) AS streak FROM b""",
)
def rolling_buffer_scoring(spark, sf):
    d, seq = event_frames(spark, sf, "value", "score")
    b = ep.buffered_features(d, seq, "value", F.col("score") >= 0.15, 10.0)
    return b.select("user_id", "event_id", rnd("slope", d=7), rnd("deviation", d=5), "streak")


@query("episode_bus_stream", f"SELECT user_id, event_type, episode, n_obs, score FROM ({_bus_sql('false')})")
def episode_bus_stream(spark, sf):
    """The same bus as a stream; checked against the SQL of the batch form."""
    import uuid

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    try:
        src = st.read_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")
        src = src.withColumns({"ts": F.col("ts").cast("timestamp"), "score": F.least(F.col("value") / 200.0, F.lit(1.0))})
        st.run_to_table(st.episode_stream(src, ["user_id", "event_type"], "ts", "event_id", "score", CFG, "30 days"), f"{base}/out", f"{base}/ckpt")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    e = st.current_episodes(spark.read.parquet(f"{base}/out"), ["user_id", "event_type"])
    return e.select("user_id", "event_type", "episode", "n_obs", rnd("score"))
