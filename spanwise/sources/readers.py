"""Sources: keypoints, tensors, events, prediction bundles, annotations, sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators.quality import require_columns
from spanwise.operators.store import unique_labels

EVENT = (
    "video_id string, event_id string, start_time double, end_time double, startTime double, endTime double, event_type string, eventType string, "
    "event_level string, eventLevel string, level string, category string, title string, description string, score double, max_risk_score double, "
    "start_frame string, end_frame string"
)
BUNDLE_EVENT = (
    "video_id:string, event_id:string, start_time:double, end_time:double, startTime:double, "
    "endTime:double, event_type:string, eventType:string, event_level:string, eventLevel:string, "
    "level:string, category:string, title:string, description:string, score:double, "
    "max_risk_score:double, start_frame:string, end_frame:string"
)
BUNDLE = (
    f"video_id string, fps double, events array<struct<{BUNDLE_EVENT}>>, events_risk_only array<struct<{BUNDLE_EVENT}>>, "
    f"anomaly_events array<struct<{BUNDLE_EVENT}>>, strike_events array<struct<{BUNDLE_EVENT}>>"
)
SPAN = "event_id:string,start_time:double,end_time:double,event_type:string,confidence:double,notes:string"
ANNOTATION = f"video string, case_id string, time_unit string, clip_start_time double, clip_end_time double, events array<struct<{SPAN}>>"
NAMESPACED = (
    "annotation_status string, video_id string, source_uri string, title string, "
    "annotations array<struct<video_id:string,start_time:double,end_time:double,event_type:string,actor_id:string,target_id:string,confidence:double,notes:string,rater_id:string>>, "
    "events array<struct<start_time:double,end_time:double,event_type:string,actor_id:string,target_id:string,confidence:double,notes:string,rater_id:string>>"
)
# 33 landmark names in index order.
LANDMARKS = (
    "nose", "left_eye_inner", "left_eye", "left_eye_outer", "right_eye_inner", "right_eye", "right_eye_outer",
    "left_ear", "right_ear", "mouth_left", "mouth_right", "left_shoulder", "right_shoulder", "left_elbow",
    "right_elbow", "left_wrist", "right_wrist", "left_pinky", "right_pinky", "left_index", "right_index",
    "left_thumb", "right_thumb", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle",
    "right_ankle", "left_heel", "right_heel", "left_foot_index", "right_foot_index",
)


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def keypoints(df: DataFrame) -> DataFrame:
    """Long keypoints: names cleaned, x / y cast (unparsable rows dropped), missing z / visibility added as null."""
    d = require_columns(trim_names(df), ["frame_id", "keypoint_name", "x", "y"])
    for c in ("z", "visibility"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("double"))
    num = {c: F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None).cast("double")) for c in ("x", "y", "z", "visibility")}
    return d.withColumns(num).filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("keypoint_name").isNotNull())


def read_keypoints(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    return keypoints(spark.read.option("header", True).option("pathGlobFilter", glob).csv(path))


def read_keypoint_folder(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """One CSV per frame; the file stem is the frame id; ``landmark`` or ``keypoint_name`` accepted."""
    d = spark.read.option("header", True).option("pathGlobFilter", glob).csv(path)
    d = d.withColumn("frame_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    d = trim_names(d)
    names = [F.col(c) for c in ("landmark", "keypoint_name") if c in d.columns]
    return keypoints(d.withColumn("keypoint_name", F.coalesce(*names)))


def indexed_landmarks(df: DataFrame, name: str = "keypoint_name") -> DataFrame:
    """Landmark index 0..32 from a fixed 33-entry map; unknown names skipped; visibility defaults to 1."""
    idx = F.create_map(*[x for i, n in enumerate(LANDMARKS) for x in (F.lit(n), F.lit(i))])
    d = df.withColumn("landmark_index", F.try_element_at(idx, F.lower(F.trim(F.col(name)))))
    return d.filter(F.col("landmark_index").isNotNull()).withColumn("visibility", F.coalesce(F.col("visibility"), F.lit(1.0)))


def event_windows(df: DataFrame) -> DataFrame:
    """Start, end and label from either naming style; rows without both times are dropped."""
    have = set(df.columns)
    pick = lambda *n: F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in n if c in have], F.lit(None).cast("string"))
    label = F.coalesce(pick("event_type", "eventType"), pick("event_level", "eventLevel"), F.lit("UNKNOWN"))
    d = df.withColumns({"_s": pick("start_time", "startTime").try_cast("double"), "_e": pick("end_time", "endTime").try_cast("double"), "label": label})
    keep = [c for c in ("video_id",) if c in have]
    return d.filter("_s is not null and _e is not null").select(*keep, F.col("_s").alias("start_time"), F.col("_e").alias("end_time"), "label")


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    return event_windows(spark.read.schema(EVENT).option("multiLine", True).json(path))


def interval_predictions(df: DataFrame) -> DataFrame:
    """Predictions with a video id; blank label -> UNKNOWN."""
    lab = F.coalesce(F.nullif(F.trim(F.col("event_type")), F.lit("")), F.lit("UNKNOWN"))
    d = df.filter(F.col("video_id").isNotNull() & F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
    return d.select("video_id", F.col("start_time").cast("double"), F.col("end_time").cast("double"), lab.alias("label"))


LEGS = {
    "full_fusion": ("events", "anomaly_events"),
    "risk_only": ("events_risk_only",),
    "strike_only": ("strike_events",),
    "anomaly_only": ("anomaly_events",),
}


def bundle_legs(df: DataFrame, subset: str = "full_fusion") -> DataFrame:
    """Explode the arrays of a prediction bundle that a subset selects, with a ``leg`` column."""
    out = None
    for leg in LEGS[subset]:
        d = df.select("video_id", F.lit(leg).alias("leg"), F.explode(leg).alias("_e")).select("video_id", "leg", F.struct("_e.*").dropFields("video_id").alias("_e")).select("video_id", "leg", "_e.*")
        out = d if out is None else out.unionByName(d)
    return out


def read_prediction_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Reference intervals of annotation documents, one row per event."""
    d = spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    return d.select("video", "case_id", "clip_start_time", "clip_end_time", F.posexplode("events").alias("pos", "_e")).select("*", "_e.*").drop("_e")


#: Event types an annotation document may use (fixed values).
ANNOTATION_TYPES = ("FALL", "KO", "SURRENDER", "INSTABILITY")


def annotation_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every annotation document with the reasons to reject it (sorted; none: it is good).

    Text that is no JSON of the schema lands in ``_corrupt`` and is one reason; others are a missing
    video, no list of events, and for its events an unknown type, missing or reversed times and a
    confidence outside 0 to 1. One document a line, or one a file with ``multi_line``.
    """
    read = spark.read.schema(f"{ANNOTATION}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multi_line)
    d = read.json(path)
    some = lambda test: F.exists(F.coalesce("events", F.array().cast(f"array<struct<{SPAN}>>")), lambda e: F.coalesce(test(e), F.lit(True)))
    reasons = {
        "no video": F.coalesce(F.trim("video") == "", F.lit(True)),
        "no events": F.col("events").isNull(),
        "unknown event type": some(lambda e: ~e["event_type"].isin(*ANNOTATION_TYPES)),
        "missing time": some(lambda e: e["start_time"].isNull() | e["end_time"].isNull()),
        "ends before it starts": some(lambda e: F.coalesce(e["end_time"] < e["start_time"], F.lit(False))),
        "confidence outside 0 to 1": some(lambda e: F.coalesce(~e["confidence"].between(0, 1), F.lit(False))),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(reasons.items())]))
    return d.withColumn("reasons", F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("not a document"))).otherwise(found))


def annotation_events(documents: DataFrame) -> DataFrame:
    """Reference intervals of the good documents of :func:`annotation_documents`, one row per event."""
    d = documents.filter(F.size("reasons") == 0)
    return d.select("video", "case_id", "clip_start_time", "clip_end_time", F.posexplode("events").alias("pos", "_e")).select("*", "_e.*").drop("_e")


def quarantine(documents: DataFrame, path: str) -> None:
    """The rejected documents with their reasons, written beside the good rows."""
    documents.filter(F.size("reasons") > 0).write.mode("overwrite").json(path)


def read_namespaced(spark: SparkSession, path: str) -> DataFrame:
    return namespaced(spark.read.schema(NAMESPACED).option("multiLine", True).json(path))


def namespaced(d: DataFrame) -> DataFrame:
    """Canonical ``annotations`` or legacy ``events`` with the root metadata in the first note."""
    meta = F.concat_ws(" | ", F.col("title"), F.col("source_uri"))
    actor, rater = F.lit("unknown"), F.lit("legacy_import")
    legacy = F.transform(
        "events",
        lambda e, i: F.struct(
            F.col("video_id").alias("video_id"), e["start_time"].alias("start_time"), e["end_time"].alias("end_time"), e["event_type"].alias("event_type"),
            F.coalesce(e["actor_id"], actor).alias("actor_id"), e["target_id"].alias("target_id"), e["confidence"].alias("confidence"),
            F.when(i == 0, F.nullif(F.concat_ws(" | ", e["notes"], meta), F.lit(""))).otherwise(e["notes"]).alias("notes"), F.coalesce(e["rater_id"], rater).alias("rater_id"),
        ),
    )
    return d.select("annotation_status", F.posexplode(F.coalesce("annotations", legacy)).alias("pos", "_a")).select("annotation_status", "pos", "_a.*")


def merge_sheets(sheets: Sequence[DataFrame], required: Sequence[str], aliases: Mapping[str, str], example: Column) -> tuple[DataFrame, DataFrame]:
    """Annotator tables merged by name; returns (kept rows, counts of skipped rows)."""
    out = None
    for s in sheets:
        names = unique_labels(s.columns)
        d = require_columns(s.toDF(*[aliases.get(n, n) for n in names]), required)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    blank = F.coalesce(F.concat_ws("", *[F.trim(F.col(c).cast("string")) for c in required]), F.lit("")) == ""
    tagged = out.withColumn("_why", F.when(blank, "blank").when(F.coalesce(example, F.lit(False)), "example"))
    return tagged.filter("_why is null").drop("_why"), tagged.filter("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Column names taken as start, end and class.
START_NAMES = ("start_frame", "start", "begin", "frame_start", "starting_frame")
END_NAMES = ("end_frame", "end", "stop", "frame_end", "ending_frame")
CLASS_NAMES = ("class", "class_name", "label", "action", "punch", "type")


def resolve_interval_columns(df: DataFrame) -> tuple[str, str, str]:
    """Start, end and class columns: by alias on the schema, else the triple on which most rows parse.

    The fallback is one aggregate over all candidate triples of adjacent columns.
    """
    slugs = dict(zip(unique_labels(df.columns), df.columns))
    hit = [next((slugs[n] for n in names if n in slugs), None) for names in (START_NAMES, END_NAMES, CLASS_NAMES)]
    if all(hit):
        return tuple(hit)
    cols = df.columns
    num = lambda c: F.col(f"`{c}`").cast("string").try_cast("int").isNotNull()
    text = lambda c: (F.length(F.trim(F.col(f"`{c}`").cast("string"))) > 0) & F.col(f"`{c}`").cast("string").try_cast("double").isNull()
    triples = [(cols[i], cols[i + 1], cols[j]) for i in range(len(cols) - 1) for j in range(len(cols)) if j not in (i, i + 1)]
    if not triples:
        raise ValueError("no interval columns found")
    counts = df.agg(*[F.count_if(num(a) & num(b) & text(c)).alias(f"n{k}") for k, (a, b, c) in enumerate(triples)]).first()
    best = max(range(len(triples)), key=lambda k: (counts[k], -k))
    if counts[best] == 0:
        raise ValueError("no interval columns found")
    return triples[best]


def resolve_rate(runs: DataFrame, override: Column, manifest: Column, qa: Column, default: float) -> DataFrame:
    """Sampling rate: override, manifest, quality record, default; non-positive values do not count."""
    pos = lambda c: F.when(c > 0, c)
    return runs.withColumn("fps", F.coalesce(pos(override), pos(manifest), pos(qa), F.lit(float(default))))
