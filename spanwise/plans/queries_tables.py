"""Ordering keys, readers, checks, run tables and text rules on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanwise.functions import scalar as fx
from spanwise.operators import quality as qa
from spanwise.operators import store as so
from spanwise.operators.chain import ensure_checkpoint_dir
from spanwise.operators.ordered import Seq, scan
from spanwise.plans.adapters import EV, event_frames, events, rnd
from spanwise.plans.registry import query
from spanwise.plans.session import table
from spanwise.sources import readers as rd
from spanwise.sources import writers as wr


def _scratch(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


# ------------------------------------------------- keys


@query("natural_order_key", "SELECT source, min(CAST(substr(source, 4) AS INT)) AS k, count(*) AS n FROM documents GROUP BY 1 ORDER BY k")
def natural_order_key(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("key", fx.natural_key(F.col("source")))
    return d.orderBy("key").select("source", F.element_at("key", 2).cast("int").alias("k"), "n")


@query(
    "frame_index_and_timestamp",
    "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CAST(substr(source, 4) AS INT), doc_id) - 1 AS frame_index, round((row_number() OVER (PARTITION BY lang ORDER BY CAST(substr(source, 4) AS INT), doc_id) - 1) / 30.0, 9) AS timestamp FROM documents",
)
def frame_index_and_timestamp(spark, sf):
    d = table(spark, sf, "documents").select("lang", "doc_id", fx.trailing_int(F.col("source")).alias("k"))
    d = scan(d, Seq(("lang",), ("k", "doc_id"), 4.0), index="frame_index")
    return d.select("lang", "doc_id", "frame_index", rnd(F.col("frame_index") / 30.0, "timestamp"))


@query("timestamp_from_frame_id", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE round(doc_id / 30.0, 9) END AS timestamp FROM documents")
def timestamp_from_frame_id(spark, sf):
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, F.concat(F.lit("f"), i)).otherwise(F.concat(F.lit("frame-"), i))
    return table(spark, sf, "documents").select("doc_id", rnd(fx.frame_number(name) / 30.0, "timestamp"))


@query("pivot_landmarks", "WITH l AS (SELECT doc_id // 10 AS frame, doc_id, CASE doc_id % 3 WHEN 0 THEN 'nose' WHEN 1 THEN 'left_eye' ELSE 'other' END AS name, n_chars / 1000.0 AS x FROM documents) SELECT frame, round(arg_max(x, doc_id) FILTER (name = 'nose'), 9) AS nose_x, round(arg_max(x, doc_id) FILTER (name = 'left_eye'), 9) AS eye_x FROM l GROUP BY 1")
def pivot_landmarks(spark, sf):
    from spanwise.functions.geometry import pivot_landmarks as piv

    i = F.col("doc_id")
    name = F.when(i % 3 == 0, "nose").when(i % 3 == 1, "left_eye").otherwise("other")
    d = table(spark, sf, "documents").select(F.floor(i / 10).alias("frame"), i, name.alias("name"), (F.col("n_chars") / 1000.0).alias("x"), F.lit(0.5).alias("y"))
    w = piv(d, ["frame"], "name", "x", "y", "doc_id", ("nose", "left_eye"))
    return w.select("frame", rnd("j0x", "nose_x"), rnd("j1x", "eye_x"))


# ------------------------------------------------- sources and sinks


@query("read_keypoints_long", f"WITH {EV} SELECT event_id, round(value, 9) AS x, round(score, 9) AS y FROM ev WHERE event_id % 7 <> 0")
def read_keypoints_long(spark, sf):
    """Write keypoint text files, read them back: bad numbers are dropped, absent columns added."""
    path = _scratch(spark)
    x = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    d = events(spark, sf).select(F.col("event_id").alias(" Frame_ID "), F.col("event_type").alias("Keypoint_Name"), x.alias("X"), F.col("score").alias("y"))
    d.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    k = rd.read_keypoints(spark, path)
    return k.select(F.col("frame_id").cast("long").alias("event_id"), rnd("x"), rnd("y"))


@query("read_events_json", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'HIGH' ELSE 'UNKNOWN' END AS label FROM events WHERE event_id % 5 <> 0")
def read_events_json(spark, sf):
    """Both naming styles; rows without both times are dropped."""
    i = F.col("event_id")
    two = i % 2 == 0
    t = F.when(i % 5 != 0, i + 0.5)
    d = table(spark, sf, "events").select(
        i.cast("string").alias("video_id"), F.when(two, i.cast("double")).alias("start_time"), F.when(two, t).alias("end_time"), F.when(~two, i.cast("double")).alias("startTime"), F.when(~two, t).alias("endTime"),
        F.when(i % 3 == 0, F.col("event_type")).alias("event_type"), F.when(i % 3 == 1, "HIGH").alias("eventLevel"),
    )
    return rd.event_windows(d).select(F.col("video_id").cast("long").alias("event_id"), "label")


@query("read_interval_predictions", "SELECT CAST(event_id AS VARCHAR) AS video_id, CASE WHEN event_id % 4 = 0 THEN 'UNKNOWN' ELSE event_type END AS label FROM events WHERE event_id % 6 <> 0")
def read_interval_predictions(spark, sf):
    i = F.col("event_id")
    d = table(spark, sf, "events").select(
        F.when(i % 6 != 0, i.cast("string")).alias("video_id"), i.cast("double").alias("start_time"), (i + 1.0).alias("end_time"), F.when(i % 4 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("event_type")
    )
    return rd.interval_predictions(d).select("video_id", "label")


@query("read_prediction_bundle", "SELECT CAST(user_id AS VARCHAR) AS video_id, CASE WHEN event_type = 'error' THEN 'anomaly_events' ELSE 'events' END AS leg, count(*) AS n FROM events GROUP BY 1, 2")
def read_prediction_bundle(spark, sf):
    """One JSON document per series written, read back with its schema and exploded by leg."""
    path = _scratch(spark)
    e = F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("score"))
    d = events(spark, sf).groupBy(F.col("user_id").cast("string").alias("video_id")).agg(
        F.collect_list(F.when(F.col("event_type") != "error", e)).alias("events"), F.collect_list(F.when(F.col("event_type") == "error", e)).alias("anomaly_events")
    )
    d.write.json(path)
    b = spark.read.schema(rd.BUNDLE).json(path)
    return rd.bundle_legs(b).groupBy("video_id", "leg").agg(F.count(F.lit(1)).alias("n"))


@query("read_namespaced_annotations", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'unknown' END AS actor_id, CASE WHEN conv_id % 2 = 1 AND turn = 0 THEN 'x | t' ELSE 'x' END AS notes FROM conversations")
def read_namespaced_annotations(spark, sf):
    c = table(spark, sf, "conversations")
    canon = F.struct(F.lit(None).cast("string").alias("video_id"), F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1.0).alias("end_time"), F.col("role").alias("event_type"), F.lit("a").alias("actor_id"), F.lit(None).cast("string").alias("target_id"), F.lit(1.0).alias("confidence"), F.lit("x").alias("notes"), F.lit("r").alias("rater_id"))
    d = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(canon)).alias("a"))
    old = F.transform("a", lambda e: e.dropFields("video_id", "actor_id").withField("actor_id", F.lit(None).cast("string")))
    even = F.col("conv_id") % 2 == 0
    d = d.select(F.lit("draft").alias("annotation_status"), F.col("conv_id").cast("string").alias("video_id"), F.lit(None).cast("string").alias("source_uri"), F.lit("t").alias("title"), F.when(even, F.transform("a", lambda e: e.withField("video_id", F.col("conv_id").cast("string")))).alias("annotations"), F.when(~even, old).alias("events"))
    n = rd.namespaced(d)
    return n.select(F.col("video_id").cast("long").alias("conv_id"), F.col("start_time").cast("long").alias("turn"), "actor_id", "notes")


@query("read_annotation_sheets", "SELECT reason, n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'blank' WHEN doc_id % 9 = 1 THEN 'example' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1)")
def read_annotation_sheets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    s = F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).when(F.col("doc_id") % 9 == 1, F.lit("EXAMPLE")).otherwise(F.col("source"))
    a = d.filter("lang = 'en'").select(s.alias("Annotator ID"), F.col("doc_id").alias("Doc"))
    b = d.filter("lang <> 'en'").select(s.alias("alumno_id"), "lang")
    kept, skipped = rd.merge_sheets([a, b], ["alumno_id"], {"annotator_id": "alumno_id"}, F.col("alumno_id") == "EXAMPLE")
    return skipped.unionByName(kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")).select("reason", "n"))


@query("resolve_interval_columns", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber >= 0")
def resolve_interval_columns(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + 5).alias("b"), F.col("l_returnflag").alias("c"))
    s, e, c = rd.resolve_interval_columns(d)
    ok = F.col(s).isNotNull() & (F.col(e) > F.col(s)) & F.col(c).isNotNull()
    return d.agg(F.count_if(ok).alias("n"))


@query("resolve_rate", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 25.0 WHEN o_orderkey % 5 = 0 THEN 10.0 ELSE 30.0 END AS fps FROM orders")
def resolve_rate(spark, sf):
    k = F.col("o_orderkey")
    d = rd.resolve_rate(table(spark, sf, "orders").select("o_orderkey"), F.lit(None).cast("double"), F.when(k % 3 == 0, 25.0).otherwise(0.0), F.when(k % 5 == 0, 10.0), 30.0)
    return d.select("o_orderkey", "fps")


@query("write_risk_scores", f"WITH {EV} SELECT event_id, '[\"' || event_type || '\"]' AS triggered_rules, CASE WHEN event_id % 10 = 0 THEN NULL ELSE round(score, 9) END AS risk_score FROM ev")
def write_risk_scores(spark, sf):
    """Partitioned write, read back, list column as JSON, NaN as null."""
    path = _scratch(spark)
    s = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("score"))
    d = events(spark, sf).select("event_type", "event_id", F.array("event_type").alias("triggered_rules"), s.alias("risk_score"))
    wr.write_frames(d, path, ["event_type"])
    return wr.json_view(wr.csv_view(spark.read.parquet(path))).select("event_id", "triggered_rules", rnd("risk_score"))


@query("write_events_csv", f"WITH {EV} SELECT event_id, round(CASE WHEN risk_level = 'LOW' THEN 1.0 ELSE 2.5 END, 4) AS duration, risk_level AS level FROM ev")
def write_events_csv(spark, sf):
    path = _scratch(spark)
    d = events(spark, sf).select(
        "event_id", "event_type", F.col("event_id").cast("double").alias("start_time"), (F.col("event_id") + F.when(F.col("risk_level") == "LOW", 1.0).otherwise(2.5)).alias("last_seen"), F.col("risk_level").alias("level"),
        F.lit("c").alias("category"), F.lit(True).alias("finished"), F.lit("d").alias("description"),
    )
    rows = wr.episode_rows(d)
    rows.write.option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path).select("event_id", "duration", "level")


@query("write_metric_tables", "SELECT CASE WHEN l_returnflag IS NULL THEN 'micro' ELSE l_returnflag END AS item, count(*) AS tp FROM lineitem GROUP BY ROLLUP(l_returnflag) UNION ALL SELECT 'macro', NULL")
def write_metric_tables(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("item")).agg(F.count(F.lit(1)).alias("tp"))
    micro, macro = d.agg(F.sum("tp").alias("tp")), d.agg(F.avg("tp").alias("f1"))
    return wr.metric_rows(d, micro, macro, "item").select("item", "tp")


# ------------------------------------------------- checks


@query("check_score_range", "SELECT source, CASE WHEN count(*) FILTER (n_chars / 5000.0 > 1) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) FILTER (n_chars / 5000.0 > 1) AS n_bad FROM documents GROUP BY 1")
def check_score_range(spark, sf):
    d = table(spark, sf, "documents").withColumn("s", F.col("n_chars") / 5000.0)
    return qa.check_score_range(d, "s", ["source"]).select("source", "status", "n_bad")


@query("check_level_values", "SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY 1")
def check_level_values(spark, sf):
    return qa.check_levels(table(spark, sf, "documents"), "lang", ("EN", "FR"))


@query("check_monotonic_time", "WITH p AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, count(*) FILTER (d < -1e-9) AS n_bad FROM p GROUP BY 1")
def check_monotonic_time(spark, sf):
    d, seq = event_frames(spark, sf, "value")
    return qa.check_monotonic(d, seq, "value").select("user_id", "n_bad")


@query("check_event_order", "SELECT l_returnflag, count(*) FILTER (NOT (l_quantity < l_linenumber * 8)) AS n_bad FROM lineitem GROUP BY 1")
def check_event_order(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("e", F.col("l_linenumber") * 8.0)
    return qa.check_event_order(d, "l_quantity", "e", ["l_returnflag"]).select("l_returnflag", "n_bad")


@query("check_constant_score", "SELECT o_custkey, CASE WHEN min(o_totalprice) = max(o_totalprice) THEN 'warn' ELSE 'pass' END AS status FROM orders GROUP BY 1")
def check_constant_score(spark, sf):
    return qa.check_constant(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"]).select("o_custkey", "status")


@query("coverage_check", "SELECT source, CASE WHEN p >= 50 THEN 'pass' WHEN p >= 35 THEN 'warn' ELSE 'fail' END AS status FROM (SELECT source, 100.0 * count(l.doc_id) / count(*) AS p FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1)")
def coverage_check(spark, sf):
    from spanwise.operators.metrics import coverage

    c = coverage(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"], ["source"])
    return c.select("source", qa.coverage_status(F.col("coverage_pct"), 50.0, 35.0).alias("status"))


@query("quality_report", "SELECT source, max(n_chars) <= 5000 AS passed, CAST(CASE WHEN min(n_chars) = max(n_chars) THEN 1 ELSE 0 END AS BIGINT) AS n_warn FROM documents GROUP BY 1")
def quality_report(spark, sf):
    d = table(spark, sf, "documents").withColumn("s", F.col("n_chars") / 5000.0)
    _, rep = qa.quality_report([qa.check_score_range(d, "s", ["source"]), qa.check_constant(d, "s", ["source"])], ["source"])
    return rep


@query(
    "validate_intervals",
    "SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 50 - 5 < 0 THEN 'start_negative' END, CASE WHEN o_orderkey % 50 - 5 >= o_custkey % 40 THEN 'end_not_after_start' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown_label' END, CASE WHEN o_totalprice / 400000.0 > 1 THEN 'confidence_out_of_range' END], lambda x: x IS NOT NULL)) AS violation FROM orders",
)
def validate_intervals(spark, sf):
    d = table(spark, sf, "orders").withColumns({"s": (F.col("o_orderkey") % 50 - 5).cast("double"), "e": (F.col("o_custkey") % 40).cast("double"), "c": F.col("o_totalprice") / 400000.0})
    return qa.interval_violations(d, ["o_orderkey"], "s", "e", "o_orderstatus", ("F", "O"), "c")


@query("validate_sheet_rows", "SELECT source, doc_id, unnest(list_filter([CASE WHEN n_chars < 100 THEN 'too_short' END, CASE WHEN lang <> 'en' THEN 'language' END], lambda x: x IS NOT NULL)) AS issue FROM documents")
def validate_sheet_rows(spark, sf):
    return qa.sheet_issues(table(spark, sf, "documents"), "source", "doc_id", {"too_short": F.col("n_chars") < 100, "language": F.col("lang") != "en"})


@query("assign_event_ids", "SELECT o_orderkey, o_custkey || '_e' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS VARCHAR), 4, '0') AS event_id FROM orders")
def assign_event_ids(spark, sf):
    from spanwise.plans.session import epoch_micros

    d = table(spark, sf, "orders").withColumn("s", epoch_micros("o_orderdate") / 86400e6)
    return qa.assign_event_ids(d, "o_custkey", "s", "o_totalprice", "o_orderkey", 365.0).select("o_orderkey", "event_id")


@query("annotation_status_gate", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'visually_confirmed' ELSE 'draft' END AS annotation_status, o_orderstatus <> 'F' AS diagnostic_only FROM orders")
def annotation_status_gate(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", " Verified ").otherwise("draft").alias("st"))
    return qa.annotation_gate(d, "st").select("o_orderkey", "annotation_status", "diagnostic_only")


@query("checksum_manifest", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unlisted' WHEN doc_id % 4 = 1 THEN 'mismatch' ELSE 'ok' END AS status FROM documents")
def checksum_manifest(spark, sf):
    """Digest of each whole text against a manifest."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    m = d.filter("doc_id % 4 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 4 == 1, "x").otherwise(F.col("sha256")))
    return qa.compare_manifest(d, m, "doc_id")


@query("reference_regression", "SELECT l_returnflag, 'n' AS \"column\", CAST(count(*) AS DOUBLE) AS got, CAST(count(*) + 1 AS DOUBLE) AS want FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def reference_regression(spark, sf):
    from spanwise.operators.metrics import regression_check

    d = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("t"))
    w = d.withColumn("n", F.col("n") + F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).withColumn("t", F.col("t") + 1e-6)
    return regression_check(d, w, ["l_returnflag"], ["n", "t"], 1e-3).select("l_returnflag", "column", "got", "want")


@query("sheet_inspect", "SELECT source, count(*) AS n_rows, count(*) FILTER (lang = 'en') AS n_valid, min(doc_id) FILTER (lang = 'en') AS first_valid FROM documents GROUP BY 1")
def sheet_inspect(spark, sf):
    return qa.sheet_profile(table(spark, sf, "documents"), "source", F.col("lang") == "en", "doc_id")


@query("check_required_artifacts", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)")
def check_required_artifacts(spark, sf):
    found = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("length"))
    return qa.missing_artifacts(table(spark, sf, "documents").select("doc_id"), found, ["doc_id"])


# ------------------------------------------------- run tables


@query("upsert_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def upsert_latest(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return so.upsert(d.filter("event_id % 2 = 0"), d.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("upsert_null_keys", "SELECT k, value, event_id FROM (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS k, value, event_id FROM events) WHERE k IS NULL OR event_id = (SELECT max(e.event_id) FROM events e WHERE e.event_type <> 'error' AND e.user_id = k)")
def upsert_null_keys(spark, sf):
    d = table(spark, sf, "events").select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("k"), "value", "event_id")
    return so.upsert(d.filter("event_id % 2 = 0"), d.filter("event_id % 2 = 1"), ["k"], "event_id", "k")


@query("run_queries", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 100 = 0 THEN NULL ELSE value END AS s FROM events) ORDER BY s ASC NULLS FIRST, event_id")
def run_queries(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 100 != 0, F.col("value")).alias("s"))
    return so.list_events(d, "s", "event_id").select("event_id")


@query("list_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 200")
def list_runs(spark, sf):
    return so.list_runs(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("list_timeline", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem ORDER BY l_orderkey ASC NULLS FIRST, l_linenumber, l_extendedprice, l_quantity LIMIT 50000")
def list_timeline(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return so.list_timeline(d.withColumn("tie", F.struct("l_linenumber", "l_extendedprice", "l_quantity")), "l_orderkey", "tie").drop("tie")


@query("run_lifecycle", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END AS status FROM orders")
def run_lifecycle(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.select("o_orderkey", F.lit("running").alias("status"), F.lit(None).cast("double").alias("finished_at"))
    done = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("finished").alias("status"), F.lit(1.0).alias("finished_at"))
    return so.finish_runs(runs, done, "o_orderkey").select("o_orderkey", "status")


@query("find_or_create", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def find_or_create(spark, sf):
    have = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return so.find_or_create(have, table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey")


@query("attach_feedback", "SELECT doc_id, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def attach_feedback(spark, sf):
    return so.attach(table(spark, sf, "labels").select("doc_id", "toxic"), table(spark, sf, "documents").filter("lang = 'en'"), "doc_id")


@query("union_legs", "SELECT leg, count(*) AS n, count(x) AS n_x FROM (SELECT 'risk' AS leg, NULL AS x FROM events WHERE event_type = 'error' UNION ALL SELECT 'strike', value FROM events WHERE event_type = 'click') GROUP BY 1")
def union_legs(spark, sf):
    e = table(spark, sf, "events")
    u = so.union_legs(("risk", e.filter("event_type = 'error'").select("event_id")), ("strike", e.filter("event_type = 'click'").select("event_id", F.col("value").alias("x"))))
    return u.groupBy("leg").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_x"))


@query("label_union", "SELECT lang AS label FROM documents UNION SELECT role FROM conversations")
def label_union(spark, sf):
    return so.label_union(table(spark, sf, "documents").select(F.col("lang").alias("label")), table(spark, sf, "conversations").select(F.col("role").alias("label")), "label")


@query("video_intersection", "SELECT doc_id FROM documents WHERE n_chars > 500 INTERSECT SELECT doc_id FROM labels")
def video_intersection(spark, sf):
    return so.in_both(table(spark, sf, "documents").filter("n_chars > 500"), table(spark, sf, "labels"), "doc_id")


@query("missing_signals_except", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_signals_except(spark, sf):
    return so.missing_from(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("dedupe_events", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, floor(value / 10), floor(value / 20)")
def dedupe_events(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.floor(F.col("value") / 10).cast("double").alias("s"), F.floor(F.col("value") / 20).cast("double").alias("e"))
    return so.dedupe_events(d, ["user_id", "event_type"], "s", "e", ["event_id"]).select("event_id")


@query("json_sanitise", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{\"v\":null,\"l\":[null,1.0]}' ELSE '{\"v\":2.0,\"l\":[2.0,1.0]}' END AS js FROM events")
def json_sanitise(spark, sf):
    bad = F.when(F.col("event_id") % 8 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).otherwise(F.lit(2.0))
    d = table(spark, sf, "events").select("event_id", F.struct(bad.alias("v"), F.array(bad, F.lit(1.0)).alias("l")).alias("s"))
    return so.json_safe(d).select("event_id", F.to_json("s", {"ignoreNullFields": "false"}).alias("js"))


# ------------------------------------------------- text


@query("slug_label", "SELECT item_id, regexp_replace(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM benchmark")
def slug_label(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fx.slug(F.col("text")).alias("slug"))


@query("norm_label", "SELECT o_orderkey, upper(regexp_replace(trim(o_orderpriority, ' '), '\\s+', ' ', 'g')) AS label FROM orders")
def norm_label(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fx.norm_label(F.concat(F.lit("  "), F.lower(F.regexp_replace("o_orderpriority", " ", "   ")))).alias("label"))


@query("namespace_split", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown' END AS family, CASE WHEN event_id % 2 = 0 THEN 'a.' || user_id ELSE event_type END AS subtype FROM events")
def namespace_split(spark, sf):
    x = F.when(F.col("event_id") % 2 == 0, F.concat_ws(".", "event_type", F.lit("a"), "user_id")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", fx.family_subtype(x).alias("f")).select("event_id", "f.family", "f.subtype")


@query("label_compatibility", "SELECT event_id, event_id % 2 = 0 AS exact, true AS family FROM events")
def label_compatibility(spark, sf):
    from spanwise.operators.intervals import label_outcome

    a = F.concat(F.col("event_type"), F.lit(".x"))
    b = F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, ".x ").otherwise(".y"))
    return table(spark, sf, "events").select("event_id", label_outcome(a, b).alias("exact"), label_outcome(a, b, "family").alias("family"))


@query("explanation_template", f"WITH {EV} SELECT event_id, risk_level || ' event (' || event_type || ') from ' || event_id || '.00 s to ' || (event_id + 1) || '.00 s, peak score 0.50. Needs human review.' AS text FROM ev")
def explanation_template(spark, sf):
    i = F.col("event_id").cast("double")
    return events(spark, sf).select("event_id", so.explanation(F.col("risk_level"), F.col("event_type"), i, i + 1.0, F.lit(0.5)).alias("text"))


@query("evidence_summary", "SELECT event_id, event_type || ': a=' || user_id || '; k=' || event_id AS text FROM events")
def evidence_summary(spark, sf):
    m = F.create_map(F.lit("k"), F.col("event_id").cast("string"), F.lit("a"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", so.evidence_text(m, F.col("event_type")).alias("text"))


@query("timecode_parse", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST((event_id // 3600) * 3600 + (event_id // 60 % 60) * 60 + event_id % 60 AS DOUBLE) END AS seconds FROM events")
def timecode_parse(spark, sf):
    i = F.col("event_id")
    t = F.format_string("%d:%02d:%02d", F.floor(i / 3600), F.floor(i / 60) % 60, i % 60)
    return table(spark, sf, "events").select("event_id", fx.timecode_seconds(F.when(i % 5 == 4, F.concat(t, F.lit("x"))).otherwise(t)).alias("seconds"))


@query(
    "annotation_documents",
    """WITH d AS (SELECT o_custkey AS c, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT CASE WHEN c % 7 = 0 THEN NULL ELSE 'c' || c || '-' || y END AS video, n, CASE WHEN c % 7 = 0 THEN 'not a document' ELSE concat_ws(',', CASE WHEN c % 13 = 0 THEN 'ends before it starts' END, CASE WHEN c % 11 = 0 THEN 'unknown event type' END) END AS reasons FROM d)
SELECT video, reasons, count(*) AS n_documents, CAST(sum(CASE WHEN reasons = '' THEN n ELSE 0 END) AS BIGINT) AS n_events FROM r GROUP BY 1, 2""",
)
def annotation_documents(spark, sf):
    """One JSON document per customer and year, some cut short or with wrong events; good events and rejects with reasons."""
    at = _scratch(spark)
    c, kind = F.col("o_custkey"), F.element_at(F.array(*[F.lit(t) for t in rd.ANNOTATION_TYPES]), F.pmod(F.col("o_orderkey"), F.lit(4)).cast("int") + 1)
    start = F.dayofyear("o_orderdate").cast("double")
    event = F.struct(start.alias("start_time"), (start + F.when(c % 13 == 0, -1.0).otherwise(1.0)).alias("end_time"), F.when(c % 11 == 0, "DANCE").otherwise(kind).alias("event_type"))
    docs = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.collect_list(event).alias("events"))
    text = F.to_json(F.struct(F.concat(F.lit("c"), c, F.lit("-"), F.col("y")).alias("video"), "events"))
    docs.select(F.when(c % 7 == 0, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text).alias("value")).write.text(at)
    read = rd.annotation_documents(spark, at)
    rd.quarantine(read, f"{at}-rejected")
    good = rd.annotation_events(read).groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    bad = spark.read.schema("video string, reasons array<string>").json(f"{at}-rejected")
    out = bad.select("video", "reasons", F.lit(0).cast("long").alias("n")).unionByName(good.select("video", F.array().cast("array<string>").alias("reasons"), "n"))
    return out.groupBy("video", F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_events"))
