import math

from spanwise.functions import geometry as g
from spanwise.operators import metrics as mt


def test_sweep_prefers_stored_rows_and_skips_failed_ones(spark):
    cols = "folder string, video string, status string, tp long, fp long, fn long, precision double, recall double, f1 double"
    rows = [
        ("run_p50", "a", "OK", 1, 1, 0, 0.5, 1.0, 2 / 3),
        ("run_p50", "b", "CACHED", 0, 0, 2, 0.0, 0.0, 0.0),
        ("run_p50", "c", "FAILED", 9, 0, 0, 1.0, 1.0, 1.0),
        ("run_p90", "a", "OK", 1, 0, 0, 1.0, 1.0, 1.0),
        ("run_p90", "__micro__", "", None, None, None, 0.2, 0.3, 0.24),
        ("run_p90", "__macro__", "", None, None, None, 0.1, 0.1, 0.1),
        ("run_p95", "a", "FAILED", 1, 0, 0, 1.0, 1.0, 1.0),
        ("other", "a", "OK", 1, 0, 0, 1.0, 1.0, 1.0),
    ]
    got = {r["value"]: r for r in mt.sweep_summary(spark.createDataFrame(rows, cols), "folder", "video", "status").collect()}
    assert set(got) == {50, 90}
    assert (got[50]["n_videos"], got[50]["stored"], got[50]["best"]) == (2, False, True)
    assert math.isclose(got[50]["micro_precision"], 0.5) and math.isclose(got[50]["micro_recall"], 1 / 3)
    assert math.isclose(got[50]["macro_f1"], 1 / 3)
    assert (got[90]["stored"], got[90]["micro_f1"], got[90]["macro_recall"], got[90]["best"]) == (True, 0.24, 0.1, False)


def test_scenarios_without_a_value_come_last(spark):
    d = spark.createDataFrame([("a", None), ("b", 0.5), ("c", 0.9), ("d", 0.5)], "name string, f1 double")
    assert {r["name"]: r["place"] for r in mt.scenario_table(d, "f1", ["name"]).collect()} == {"c": 1, "b": 2, "d": 3, "a": 4}


def test_legs_are_matched_on_their_own(spark):
    refs = spark.createDataFrame([("v", 1, 0.0, 10.0), ("v", 2, 20.0, 30.0)], "cust string, ref_id long, ref_start double, ref_end double")
    preds = spark.createDataFrame(
        [("v", "x", 0.0, 10.0, "risk"), ("v", "y", 0.0, 9.0, "strike"), ("v", "z", 20.0, 30.0, None)],
        "cust string, pred_id string, pred_start double, pred_end double, leg string",
    )
    got = {r["leg"]: (r["tp"], r["fp"], r["fn"]) for r in mt.leg_metrics(refs, preds, ["cust"], "leg", ["risk", "strike"], 60.0, 0.3).collect()}
    assert got == {"combined": (2, 1, 0), "risk": (1, 0, 1), "strike": (1, 0, 1)}


def test_cases_without_rows_have_zero_counts(spark):
    cases = spark.createDataFrame([(1,), (2,)], "k long")
    risk = spark.createDataFrame([(1, 0.4, "MEDIUM"), (1, 0.6, "HIGH")], "k long, score double, level string")
    spans = spark.createDataFrame([(1, 2.0, 5.0), (1, 0.0, 1.0)], "k long, s double, e double")
    qa = spark.createDataFrame([(2, "ok")], "k long, qa string")
    got = {r["k"]: r.asDict() for r in mt.case_summary(cases, "k", risk, spans, qa, "score", "level", "s", "e").collect()}
    assert (got[1]["n_frames"], got[1]["max_score"], got[1]["n_events"], got[1]["longest"], got[1]["qa"]) == (2, 0.6, 2, 3.0, None)
    assert (got[2]["n_frames"], got[2]["max_score"], got[2]["n_events"], got[2]["longest"], got[2]["qa"]) == (0, None, 0, None, "ok")


def test_frames_with_few_joints_become_null_frames(spark):
    nan = float("nan")
    rows = [(1, [0.1, 0.2, 0.9, 0.3, 0.4, 0.8, 0.0, 0.0, 0.9]), (2, [0.1, 0.2, 0.9, nan, 0.4, 0.8, 0.5, 0.5, 0.1]), (3, [0.1, 0.2, 0.9, 0.3, 0.4, nan, 0.5, 0.6, 0.9])]
    d = g.read_tensor(spark.createDataFrame(rows, "f long, v array<double>"), "v", dims=3, joints=3)
    got = {r["name"]: r for r in g.filter_joints(d, min_valid=2, least=0.1, joints=3).withColumn("name", g.frame_name("f")).collect()}
    assert [got[f"0000000{i}"]["n_valid"] for i in (1, 2, 3)] == [2, 1, 2]
    assert (got["00000001"]["j0x"], got["00000001"]["j2x"]) == (0.1, None)
    assert all(got["00000002"][f"j{k}{a}"] is None for k in range(3) for a in "xy")
    assert (got["00000003"]["j1x"], got["00000003"]["j2y"]) == (None, 0.6)
