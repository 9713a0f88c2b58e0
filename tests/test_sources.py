import json

import pytest
from pyspark.sql import functions as F

from spanwise.functions import scalar as fx
from spanwise.operators import metrics as mt
from spanwise.operators import quality as qa
from spanwise.operators import scoring as sc
from spanwise.plans.config import FusionConfig, Interaction, RuleConfig, with_sensitivity
from spanwise.sources import readers as rd
from spanwise.streaming.stateful import advance


def test_keypoint_folder(spark, tmp_path):
    for n, rows in {"frame_2": "nose,0.1,0.2\nleft_hip,bad,0.1", "frame_10": "nose,0.3,0.4"}.items():
        (tmp_path / f"{n}.csv").write_text("landmark, x,y\n" + rows + "\n")
    d = rd.read_keypoint_folder(spark, str(tmp_path))
    d = d.withColumn("k", fx.natural_key(F.col("frame_id"))).orderBy("k")
    assert [(r.frame_id, r.keypoint_name, r.x) for r in d.collect()] == [("frame_2", "nose", 0.1), ("frame_10", "nose", 0.3)]
    assert rd.indexed_landmarks(d).first().landmark_index == 0


def test_annotation_documents(spark, tmp_path):
    doc = {"video": "v", "events": [{"event_id": "a", "start_time": 1.0, "end_time": 2.0, "event_type": "KO"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    r = rd.read_annotations(spark, str(tmp_path)).collect()
    assert [(x.video, x.pos, x.event_type, x.end_time) for x in r] == [("v", 0, "KO", 2.0)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.json").write_text(json.dumps([{"startTime": 1, "endTime": 2, "eventLevel": "HIGH"}, {"start_time": 1}]))
    e = rd.read_events_json(spark, str(tmp_path / "sub")).collect()
    assert [(x.start_time, x.end_time, x.label) for x in e] == [(1.0, 2.0, "HIGH")]


def test_file_digests(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    d = qa.file_digests(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert d.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and d.length == 3


def test_missing_is_not_zero(spark):
    d = spark.createDataFrame([(1.0, None), (1.0, 0.0)], "a double, b double")
    ch, w = {"a": F.col("a"), "b": F.col("b")}, {"a": 1.0, "b": 3.0}
    got = d.select(*[sc.scheme_score(ch, w, s).alias(s) for s in ("equal", "weighted", "max")]).collect()
    assert tuple(got[0]) == (1.0, 1.0, 1.0) and tuple(got[1]) == (0.5, 0.25, 1.0)


def test_zero_threshold_means_default_and_absent_signal_never_fires(spark):
    cfg = FusionConfig(interactions=(Interaction("r", ("a",), 0.1, 0.0), Interaction("q", ("a", "zz"), 0.5, 0.1)), threshold=0.3)
    d = spark.createDataFrame([(0.2,), (0.4,)], "a double")
    assert [r[0] for r in d.select(sc.boosts({"a": F.col("a")}, cfg)).collect()] == [0.0, 0.1]


def test_row_local_components_have_no_streak(spark):
    d = spark.createDataFrame([(True, 0.0, 0.0)], "near_ground boolean, hip_vertical_velocity double, head_vertical_velocity double")
    r = sc.rule_components(d, RuleConfig()).first()
    assert r.c_post_fall_low_movement == 0.0 and r.c_low_guard is None


def test_bands_and_clip(spark):
    d = spark.createDataFrame([(0.25,), (float("nan"),), (None,), (0.75,)], "s double")
    assert [r[0] for r in d.select(fx.band(F.col("s"), (0.25, 0.5, 0.75))).collect()] == ["MEDIUM", "LOW", "LOW", "CRITICAL"]
    assert [r[0] for r in d.select(fx.clip(F.col("s"))).collect()][2] is None
    with pytest.raises(ValueError):
        fx.band(F.col("s"), (0.5, 0.25, 0.75))
    with pytest.raises(ValueError):
        with_sensitivity(RuleConfig(), "extreme")


def test_episode_transition():
    s, _ = advance(None, 0, 0.1, False, 450_000, 2_500_000)
    s, c = advance(s, 200_000, 0.3, False, 450_000, 2_500_000)  # merges
    assert c is None and s[2:] == (200_000, 2, 0.3)
    assert advance(s, 1_500_000, 0.9, False, 450_000, 2_500_000)[0] == s  # cooldown
    assert advance(s, 1_500_000, 0.9, True, 450_000, 2_500_000)[0][0] == 1  # forced
    late, c = advance(s, -100_000, 0.2, False, 450_000, 2_500_000)  # late rows merge
    assert c is None and late[1:3] == (-100_000, 200_000)
    assert advance(s, 2_700_000, 0.2, False, 450_000, 2_500_000)[1] == s  # cooldown over


def test_micro_macro(spark):
    d = spark.createDataFrame([("a", 5, 5, 0, 0.5, 1.0, 2 / 3), ("b", 0, 0, 10, 0.0, 0.0, 0.0)], "v string, tp int, fp int, fn int, precision double, recall double, f1 double")
    r = mt.micro_macro(d).first()
    assert r.micro_f1 == pytest.approx(0.4) and r.macro_f1 == pytest.approx(1 / 3)


def test_annotation_documents_are_rejected_with_reasons(spark, tmp_path):
    lines = [
        '{"video": "v1", "events": [{"start_time": 1.0, "end_time": 2.0, "event_type": "KO", "confidence": 0.5}, {"start_time": 3, "end_time": 3, "event_type": "FALL"}]}',
        '{"video": "v2", "events": []}',
        '{"video": " ", "events": [{"start_time": 1, "end_time": 2, "event_type": "KO"}]}',
        '{"video": "v4"}',
        '{"video": "v5", "events": [{"start_time": 4, "end_time": 2, "event_type": "ko", "confidence": 1.5}, {"end_time": 2, "event_type": null}]}',
        '{"video": "v6", "events": [',
        "plain text",
    ]
    (tmp_path / "docs.json").write_text("\n".join(lines))
    docs = rd.annotation_documents(spark, str(tmp_path / "docs.json"))
    got = sorted((r["video"] or "", tuple(r["reasons"])) for r in docs.collect())
    assert got == sorted([
        ("v1", ()), ("v2", ()), (" ", ("no video",)), ("v4", ("no events",)),
        ("v5", ("confidence outside 0 to 1", "ends before it starts", "missing time", "unknown event type")),
        ("", ("not a document",)), ("", ("not a document",)),
    ])
    assert [(r["video"], r["start_time"], r["event_type"]) for r in rd.annotation_events(docs).orderBy("pos").collect()] == [("v1", 1.0, "KO"), ("v1", 3.0, "FALL")]
    rd.quarantine(docs, str(tmp_path / "rejected"))
    assert spark.read.json(str(tmp_path / "rejected")).count() == 5
