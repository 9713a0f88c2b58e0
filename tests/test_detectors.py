"""Detectors against short array versions of the same rules on small random skeletons."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwise.functions import geometry as g
from spanwise.operators import detectors as dt
from spanwise.operators import resampling as rs
from spanwise.operators import tracking as tr
from spanwise.operators.ordered import Seq
from spanwise.plans import queries_poses

FPS = 10.0
T = 140


def skeleton(seed):
    r = np.random.default_rng(seed)
    base = np.zeros((17, 2))
    base[0] = (0.5, 0.2)
    base[5], base[6] = (0.42, 0.3), (0.58, 0.3)
    base[7], base[8] = (0.4, 0.42), (0.6, 0.42)
    base[9], base[10] = (0.42, 0.66), (0.58, 0.66)
    base[11], base[12] = (0.45, 0.55), (0.55, 0.55)
    base[13], base[14] = (0.45, 0.7), (0.55, 0.7)
    base[15], base[16] = (0.45, 0.86), (0.55, 0.86)
    base[1:5] = (0.5, 0.19)
    p = np.repeat(base[None], T, 0) + r.normal(0, 0.001, (T, 17, 2))
    for c in (30, 34, 38, 42, 80, 85, 90):  # wrist impulses near the mat
        p[c, 9:11, 1] += 0.12
    p[60:64, 15:17, 1] += r.random((4, 1)) * 0.1  # ankle bursts
    p[100:, :, 1] = 0.7 + (p[100:, :, 1] - 0.7) * 0.3  # collapse to the ground and stay
    gone = r.random((T, 17)) < 0.02
    p[gone] = np.nan
    return p


POSES = {0: skeleton(1), 1: skeleton(2)}


@pytest.fixture(scope="module", params=[True, False], ids=["whole", "chunks"])
def frames(spark, request):
    rows = []
    for v, p in POSES.items():
        for i in range(T):
            xy = np.where(np.isnan(p[i]), None, p[i].astype(object))
            rows.append((v, i, T, *xy.reshape(-1).tolist()))
    cols = ", ".join(f"j{k}{a} double" for k in range(17) for a in "xy")
    d = spark.createDataFrame(rows, f"video int, i long, n long, {cols}").withColumn("t", F.col("i") / FPS)
    return d, Seq(("video",), ("i",), 64.0, 160 if request.param else 48, None, request.param)


def smooth(x, w):
    return np.convolve(np.pad(x, w // 2, mode="edge"), np.ones(w) / w, "valid")


def speeds(p, joints):
    d = np.hypot(*np.moveaxis(np.diff(p[:, joints], axis=0), -1, 0)) * FPS
    return np.vstack([np.full((1, len(joints)), np.nan), d])


def mids(p, a, b):
    return (p[:, a] + p[:, b]) / 2


def brute_strength(p):
    ws = smooth(np.nan_to_num(np.fmax.reduce(speeds(p, [9, 10]), axis=1)), 3)
    an = smooth(np.nan_to_num(np.fmax.reduce(speeds(p, [15, 16]), axis=1)), 3)
    wr, sh, el, ft = mids(p, 9, 10), mids(p, 5, 6), mids(p, 7, 8), mids(p, 15, 16)

    def osc(y):
        o = np.zeros(T)
        o[1:-1] = np.abs(y[2:] - 2 * y[1:-1] + y[:-2]) * FPS**2
        return o

    ow, oa = osc(wr[:, 1]), osc(ft[:, 1])
    span = ft[:, 1] - sh[:, 1]
    gate = (span > 1e-6) & (wr[:, 1] >= sh[:, 1] + 0.55 * span)
    trap = np.clip(np.exp(-18 * np.hypot(*(wr - sh).T)) * np.where(wr[:, 1] < el[:, 1] + 0.02, 1, 0.45), 0, 1)
    trap = np.where(np.isnan(trap) | np.isnan(el[:, 1]), 0, trap)
    hand = ws / (np.percentile(ws, 75) + 1e-9) * (1 + 0.35 * ow / (np.nanmedian(ow) + 1e-9))
    foot = an / (np.percentile(an, 75) + 1e-9) * (1 + 0.45 * oa / (np.nanmedian(oa) + 1e-9)) * (0.55 + 0.45 * trap)
    return np.clip(np.nan_to_num(hand), 0, 12) * gate, np.clip(np.nan_to_num(foot), 0, 12)


def brute_taps(p):
    out = []
    for kind, s, q in zip(("hand_tap", "foot_tap"), brute_strength(p), (88, 85)):
        h = max(0.22, np.percentile(s, q) * 0.42)
        peaks = [i for i in range(1, T - 1) if s[i] >= h and s[i] >= s[i - 1] and s[i] >= s[i + 1]]
        i = 0
        while i < len(peaks):
            run = [x for x in peaks[i:] if x - peaks[i] <= 15]
            if len(run) < 2:
                i += 1
                continue
            a, b = max(0, run[0] - 4), min(T - 1, run[-1] + 4)
            score = min(1, s[a : b + 1].mean() / 8)
            if score >= 0.22:
                out.append((f"submission_signal.{kind}", a / FPS, b / FPS, round(score, 6), len(run)))
            i += len(run)
    return out


def test_taps(frames):
    d, seq = frames
    got = dt.taps(d, seq, FPS).toPandas()
    want = [(v, *r) for v, p in POSES.items() for r in brute_taps(p)]
    assert len(want) > 2
    have = sorted(zip(got.video, got.event_type, got.start_time, got.end_time, got.repetition_count, got.score))
    want = sorted((v, k, a, b, n, s) for v, k, a, b, s, n in want)
    assert [h[:5] for h in have] == [x[:5] for x in want]
    np.testing.assert_allclose([h[5] for h in have], [x[5] for x in want], atol=1e-5)


def test_vulnerability_masks(frames):
    d, seq = frames
    d = d.withColumns({"post_impact": F.col("i").between(98, 120), "opp_near": F.lit(0.5), "opp_motion": F.lit(3.0)})
    got = dt.vulnerability_frames(d, seq, FPS).toPandas().sort_values(["video", "i"]).reset_index(drop=True)
    fired = set()
    for v, p in POSES.items():
        a = got[got.video == v]
        sh, an, wr = mids(p, 5, 6), mids(p, 15, 16), mids(p, 9, 10)
        span = an[:, 1] - sh[:, 1]
        gd = np.hypot(*(wr - (p[:, 0] + sh) / 2).T) / span
        step = lambda y: np.concatenate([[0], np.diff(y) * FPS])
        with np.errstate(invalid="ignore"):
            hv, col = smooth(step(p[:, 0, 1]), 3), np.maximum(0, -smooth(step(span), 3))
            sp = speeds(p, [9, 10, 7, 8, 11, 12, 13, 14])
            m = smooth(np.nansum(sp, 1) / np.maximum(1, (~np.isnan(sp)).sum(1)), 3)
            pc = lambda x, q: max(np.percentile(x[np.isfinite(x)], q), 5e-5)
            ref = np.nanpercentile(span[:20], 75)
            ratio = span / ref
            grd = ratio <= 0.52
            hd, cs = np.clip(hv / (pc(hv, 82) + 1e-9), 0, 4), np.clip(col / (pc(col, 78) + 1e-9), 0, 4)
            lo, hi = pc(m, 22), pc(m, 75)
            up = np.array([np.nanmax(ratio[max(0, i - 24) : i + 1]) for i in range(T)]) >= 0.62
            std = np.sqrt(np.maximum(smooth(m * m, 9) - smooth(m, 9) ** 2, 0))
            calm = (m < hi * 0.88) & ~((std < 0.012) & (ratio > 0.58))
            low = gd < 0.38
            ko = (hd >= 0.85) & (cs >= 0.55) & grd & up & ~(low & (hd < 1.05)) & ~(low & (hd < 1.05 * 0.95) & (cs < 0.62) & (m >= lo * 0.9))
            de = grd & (gd > 0.42) & (m <= hi * 0.95) & calm
            win = (np.arange(T) >= 98) & (np.arange(T) <= 120)
            po = win & (m <= pc(m, 28) * 1.15) & grd & calm
            ch = (m <= lo * 2.5) & grd & (3.0 >= hi * 0.55) & calm
            still = np.clip(np.clip((lo + 1e-6) / (m + 1e-6), 0, 5) / 5, 0, 1)
            loss = np.where(np.isfinite(gd), np.clip((gd - 0.18) / 0.42, 0, 1.5), 0)
            sd = np.clip(np.clip((0.55 * loss + 0.45 * still) * 1.35, 0, 2.5) / 1.65, 0, 1)
        for name, want in (("k_ko", ko), ("k_defense", de), ("k_post", po), ("k_choke", ch)):
            assert (a[name].to_numpy() == want).all(), name
            if want.any():
                fired.add(name)
        np.testing.assert_allclose(a.s_defense.to_numpy(), sd, atol=1e-9)
    assert len(fired) >= 2


def brute_surrender(y2, x2):
    n = len(y2)
    hits = (~np.isnan(y2)).sum()
    if n < 8 or hits < 8 or hits < n * 0.4:
        return 0.0
    wx, wy = (pd.Series(a).ffill().bfill().to_numpy() for a in (x2, y2))
    v = np.diff(wy, prepend=wy[0])
    rev = int((v[1:] * v[:-1] < 0).sum())
    conf = 0.32 * min(1, (wx.std() + wy.std()) / 0.1) + 0.3 * (min(1, rev / 8) if rev >= 2 else 0)
    drop = wy[-1] - wy[0]
    conf += 0.2 * (min(1, drop / 0.12) if drop > 0.02 else 0) + 0.18 * min(1, (np.abs(np.diff(v)) > 0.04).sum() / 4)
    return min(1.0, conf)


def test_surrender_window(frames):
    d, seq = frames
    got = dt.surrender_window(d, seq).toPandas().sort_values(["video", "i"])
    want = []
    for p in POSES.values():
        w = np.nanmean(np.where(np.isnan(p[:, 9:11]).all(1, keepdims=True), np.nan, p[:, 9:11]), axis=1)
        want += [brute_surrender(w[max(0, i - 21) : i + 1, 1], w[max(0, i - 21) : i + 1, 0]) for i in range(T)]
    np.testing.assert_allclose(got.surrender_confidence.to_numpy(), want, atol=1e-9)
    assert (got.surrender_confidence >= 0.28).any()


def test_inactivity(frames):
    d, seq = frames
    # scale motion down so that some windows are still
    for k in range(17):
        d = d.withColumns({f"j{k}{a}": F.when(F.col("i") > 50, 0.5 + (F.col(f"j{k}{a}") - 0.5) * 0.02).otherwise(F.col(f"j{k}{a}")) for a in "xy"})
    got = dt.inactivity_signals(d, seq, "t", ["video", "i"]).toPandas()
    want = set()
    for v, p0 in POSES.items():
        p = p0.copy()
        p[51:] = 0.5 + (p[51:] - 0.5) * 0.02
        sp = speeds(p, list(range(17))) / FPS
        st = np.nansum(sp, 1) / np.maximum(1, (~np.isnan(sp)).sum(1))
        com = (p[:, 5] + p[:, 6] + p[:, 11] + p[:, 12]) / 4
        for i in range(T):
            a = i - 20
            if a < 0:
                continue
            mean = st[a + 1 : i + 1].mean()
            idx = 0 if mean >= 0.002 else 1 - mean / 0.002
            kp = np.clip(1 - mean / (0.006 + 1e-8), 0, 1) if mean < 0.0024 and idx >= 0.45 else 0
            path, last = 0.0, com[a]
            for q in range(a + 1, i + 1):
                if np.isnan(last[0]) or np.isnan(com[q][0]):
                    continue
                path, last = path + np.hypot(*(com[q] - last)), com[q]
            sp_c = path / 2.0
            cm = np.clip(1 - sp_c / (0.0015 + 1e-8), 0, 1) if sp_c < 2.5 * 0.0015 and path < 0.04 else 0
            want |= {(v, i, n, round(float(c), 6)) for n, c in (("inactivity_low_keypoint_motion", kp), ("inactivity_low_com_motion", cm)) if c >= 0.32}
    assert want
    assert set(zip(got.video, got.i, got.type, got.confidence.round(6))) == want


def test_fall_and_limb_signals(frames):
    d, seq = frames
    f = dt.fall_signals(d, seq, "t", ["video", "i"]).toPandas()
    want = set()
    for v, p in POSES.items():
        hip, nose = mids(p, 11, 12), p[:, 0]
        sh = mids(p, 5, 6)
        ang = np.degrees(np.arctan2(sh[:, 0] - hip[:, 0], hip[:, 1] - sh[:, 1]))
        y = np.fmax(nose[:, 1], hip[:, 1])
        lk = np.where(y >= 0.78, np.clip((y - 0.78) / 0.22, 0, 1), 0)
        for i in range(1, T):
            dv = np.nan_to_num(np.array([hip[i, 1] - hip[i - 1, 1], nose[i, 1] - nose[i - 1, 1]]) * FPS).max()
            c1 = np.clip((dv - 0.225) / (0.9 + 1e-6), 0, 1) if dv > 0 else 0
            da = abs(ang[i] - ang[i - 1])
            c2 = np.clip((da - 6) / (14.4 + 1e-6), 0, 1) if da >= 4.8 else 0
            w = lk[max(0, i - 11) : i + 1]
            c3 = np.clip((w.mean() - 0.35) / 0.55, 0, 1) if w.mean() >= 0.55 * 0.85 else 0
            if c1 >= 0.32:
                want.add((v, i, "fall_rapid_downward"))
            if c2 >= 0.35:
                want.add((v, i, "fall_torso_angle_collapse"))
            if len(w) >= 4 and c3 >= 0.36 and (w > 0.2).sum() >= 4:
                want.add((v, i, "fall_prolonged_low_posture"))
    assert set(zip(f.video, f.i, f.type)) == want and want
    m = dt.limb_signals(d, seq, ["video", "i"]).toPandas()
    assert m.i.min() >= 1 and m.confidence.between(0.33, 1).all()
    a = dt.action_signals(d, seq, "t", ["video", "i"]).toPandas()
    assert {"low_guard"} <= set(a.type) and a.confidence.between(0.3, 1).all()
    both = a[a.type.isin(["punch_activity", "kick_activity"])].groupby(["video", "i"]).type.nunique()
    assert len(both) == 0 or both.max() <= 2


def test_pose_features_and_kinematics(frames):
    d, seq = frames
    got = dt.pose_features(d, seq, FPS).toPandas().sort_values(["video", "i"])
    want = np.concatenate([np.gradient(mids(p, 11, 12)[:, 1], 1 / FPS) for p in POSES.values()])
    np.testing.assert_allclose(got.hip_vertical_velocity.to_numpy(dtype=float), want, atol=1e-9)
    cols = ["hip_center_y"]
    k = dt.angular_kinematics(d.withColumn("hip_center_y", g.hips().y), seq, FPS, cols).toPandas().sort_values(["video", "i"])
    acc = np.concatenate([np.gradient(np.gradient(mids(p, 11, 12)[:, 1], 1 / FPS), 1 / FPS) for p in POSES.values()])
    np.testing.assert_allclose(k.hip_center_y_acceleration.to_numpy(dtype=float), acc, atol=1e-8)


def test_tracking(spark):
    r = np.random.default_rng(5)
    rows = [(0, f, k, float(r.integers(0, 6)) / 4, float(r.integers(0, 6)) / 4) for f in range(25) if f not in (7, 15) for k in range(r.integers(1, 5))]
    d = spark.createDataFrame(rows, "v int, frame_index int, det_index int, x double, y double")
    d = d.select("v", "frame_index", "det_index", F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1).alias("x2"), (F.col("y") + 1).alias("y2")).alias("box"))
    got = tr.associate(d, ["v"], 0.3, 4.0).toPandas()

    def iou(a, b):
        w, h = max(0, 1 - abs(a[0] - b[0])), max(0, 1 - abs(a[1] - b[1]))
        return w * h / (2 - w * h)

    want, prev, last, nid = {}, {}, -2, 0
    by = {}
    for _, f, k, x, y in rows:
        by.setdefault(f, []).append((k, (x, y)))
    for f in sorted(by):
        if f != last + 1:
            prev = {}
        cur, used = {}, set()
        for k, b in sorted(by[f]):
            best = max(((iou(pb, b), -pk) for pk, (pb, _) in prev.items() if pk not in used), default=(0, 0))
            if best[0] >= 0.3:
                used.add(-best[1])
                tid = prev[-best[1]][1]
            else:
                nid += 1
                tid = nid
            cur[k] = (b, tid)
            want[(f, k)] = tid
        prev, last = cur, f
    assert dict(zip(zip(got.frame_index, got.det_index), got.track_id)) == want


def test_resampling(spark):
    # per-video F1 differences of ten pairs; exact p by enumeration
    diff = [0.4, -0.1, 0.2, 0.05, 0.3, 0.0, -0.2, 0.15, 0.1, 0.25]
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(diff)], "g int, k int, d double")
    a = np.array(diff)
    signs = np.array([[1 if (m >> i) & 1 else -1 for i in range(10)] for m in range(1024)])
    want = (np.abs((signs * a).sum(1)) >= abs(a.sum()) - 1e-12).mean()
    assert rs.paired_permutation_exact(d, ["g"], "k", "d", 10).first().p_value == pytest.approx(want)
    assert rs.paired_permutation_sampled(d, ["g"], "k", "d").first().p_value == pytest.approx(want, abs=0.03)
    b = rs.bootstrap_ci(d, ["g"], "k", "d").first()
    se = a.std() / np.sqrt(10)
    assert b.mean == pytest.approx(a.mean())
    assert b.ci_low == pytest.approx(a.mean() - 1.96 * se, abs=0.03) and b.ci_high == pytest.approx(a.mean() + 1.96 * se, abs=0.03)


def test_opponent_reaches_the_queries(spark, tmp_path):
    """Person 0 falls and lies still; person 1 strikes, then holds both wrists at the other's head."""
    r = np.random.default_rng(3)
    me = skeleton(1)
    noise = r.normal(0, 0.001, me.shape)
    noise[96:120] *= 0.1
    me[:] = np.nanmedian(me[:28], 0) + noise
    f = np.interp(np.arange(T), [60, 76], [1.0, 0.1])[:, None]
    me[:, :, 1] = 0.86 + (me[:, :, 1] - 0.86) * f
    other = np.nanmedian(skeleton(2)[:28], 0) + r.normal(0, 0.02, me.shape)
    other[76:80, 9:11, 0] += np.array([0.3, 0.0, 0.3, 0.0])[:, None]
    other[84:, 9:11] = me[84:, :1] + r.normal(0, 0.02, (T - 84, 2, 2))
    rows = [(7, i, [float(x) for x in np.concatenate([me[i].reshape(-1), other[i, :15].reshape(-1)]) - 0.5]) for i in range(T)]
    spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d, _ = queries_poses.pairs(spark, str(tmp_path))
    a = d.filter("p = 0").orderBy("i").toPandas()
    gap = np.linalg.norm(other[:, 9:11] - me[:, :1], axis=2).min(1)
    np.testing.assert_allclose(a.opp_near, np.exp(-22 * gap), atol=1e-5)
    gap = np.linalg.norm(me[:, 9:11].mean(1) - other[:, 11:13].mean(1), axis=1)
    np.testing.assert_allclose(a.opp_touch, np.exp(-12 * gap), atol=1e-5)
    got = queries_poses.vulnerability_detector(spark, str(tmp_path)).toPandas()
    assert set(got[got.video == 14].event_type) == set(dt.KINDS.values())


def test_poses_of_embeddings_are_clipped_as_in_sql(spark, tmp_path):
    import duckdb

    from spanwise.plans import catalog

    rows = [(0, i, [float(x) for x in np.where(np.arange(64) == i, v, 0.1)]) for i, v in enumerate((0.2, 0.7, -0.9, 0.52))]
    spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries_poses.normalize_unit_square(spark, str(tmp_path)).fillna(-1.0).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(tuple(-1.0 if v is None else v for v in r) for r in con.execute(catalog.SQL["normalize_unit_square"]).fetchall())
    assert len(got) == 8 and got == want


def test_longer_series_take_work_in_proportion(frames):
    """Runs have no frame up to the end of the series, which would be summed anew for every row."""
    d, seq = frames
    plan = dt.strikes(d.withColumn("speed", F.col("j9y")), seq, "speed", FPS)._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
