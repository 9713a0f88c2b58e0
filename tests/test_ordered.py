import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwise.operators import ordered as o
from spanwise.operators import windows as w

SEQ = o.Seq(("k",), ("t", "id"), width=7.0, chunk=16)
WHOLE = o.Seq(("k",), ("t", "id"), width=7.0, whole=True)
BOTH = pytest.mark.parametrize("seq", [SEQ, WHOLE], ids=["buckets", "whole"])


def make(n=300, seed=0):
    r = np.random.default_rng(seed)
    # one hot key holds most rows
    k = np.where(r.random(n) < 0.6, 0, r.integers(1, 6, n))
    t = np.round(r.random(n) * 120, 1)
    x = r.normal(size=n)
    return pd.DataFrame({"k": k, "t": t, "id": np.arange(n), "x": x, "f": r.random(n) < 0.45, "v": r.integers(0, 3, n)})


@pytest.fixture(scope="module")
def data(spark):
    p = make()
    return p.sort_values(["k", "t", "id"]).reset_index(drop=True), spark.createDataFrame(p)


def back(df):
    return df.toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)


@BOTH
def test_scan_matches_pandas(data, seq):
    p, d = data
    got = back(
        o.scan(
            d, seq, index="i", total="n",
            s=o.Scan("sum", F.col("x")),
            mx=o.Scan("max", F.col("x"), exclusive=True),
            mn=o.Scan("min", F.col("x"), reverse=True),
            la=o.Scan("last", F.when(F.col("f"), F.col("x"))),
            nx=o.Scan("last", F.when(F.col("f"), F.col("x")), exclusive=True, reverse=True),
            at=o.Scan("at", F.col("f")),
            nt=o.Scan("at", F.col("f"), exclusive=True, reverse=True),
        )
    )
    g = p.groupby("k")
    assert (got.i == g.cumcount()).all()
    assert (got.n == g["x"].transform("size")).all()
    np.testing.assert_allclose(got.s, g["x"].cumsum())
    np.testing.assert_allclose(got.mx, g["x"].transform(lambda s: s.cummax().shift()))
    np.testing.assert_allclose(got.mn, g["x"].transform(lambda s: s[::-1].cummin()[::-1]))
    xf = p.x.where(p.f)
    np.testing.assert_allclose(got.la, xf.groupby(p.k).ffill())
    np.testing.assert_allclose(got.nx, xf.groupby(p.k).transform(lambda s: s.shift(-1).bfill()))
    idx = g.cumcount().astype(float).where(p.f)
    np.testing.assert_allclose(got["at"].astype(float), idx.groupby(p.k).ffill())
    np.testing.assert_allclose(got["nt"].astype(float), idx.groupby(p.k).transform(lambda s: s.shift(-1).bfill()))


def brute_runs(p, gap, by_value=False):
    out = []
    for _, g in p.groupby("k"):
        n = len(g)
        run = [None] * n
        prev = start = None
        pv = None
        for i, (f, v) in enumerate(zip(g.f, g.v)):
            if not f:
                continue
            if prev is None or i - prev - 1 >= gap or (by_value and v != pv):
                start = i
            else:
                for q in range(prev + 1, i):
                    run[q] = start
            run[i] = start
            prev, pv = i, v
        out += run
    return out


@BOTH
@pytest.mark.parametrize("gap,by_value", [(1, False), (2, False), (4, False), (1, True)])
def test_runs(data, seq, gap, by_value):
    p, d = data
    got = back(o.runs(d, seq, F.col("f"), gap, F.col("v") if by_value else None))
    want = pd.Series(brute_runs(p, gap, by_value), dtype="float")
    np.testing.assert_array_equal(got["_run"].astype(float).to_numpy(), want.to_numpy())


def test_runs_on_range_buckets(data):
    p, d = data
    rd, seq = o.range_buckets(d, SEQ, 6)
    got = back(o.runs(rd, seq, F.col("f"), 2))
    want = pd.Series(brute_runs(p, 2), dtype="float")
    np.testing.assert_array_equal(got["_run"].astype(float).to_numpy(), want.to_numpy())


def test_runs_on_balanced_buckets(data):
    p, d = data
    bd, seq = o.balance(d, SEQ, rows=20)
    assert bd.filter("k = 0").select("_hb").distinct().count() > 5
    got = back(o.runs(bd, seq, F.col("f"), 2))
    want = pd.Series(brute_runs(p, 2), dtype="float")
    np.testing.assert_array_equal(got["_run"].astype(float).to_numpy(), want.to_numpy())


@BOTH
def test_frames(data, seq):
    p, d = data
    x = F.col("x")
    got = back(
        w.features(
            d, seq, 5, 3,
            lambda win: {
                "g": w.central_gradient_col(x, win, 0.5),
                "sd": w.rolling_std_col(x, win, 5),
                "md": w.rolling_median_col(x, win, 5, 2),
                "es": w.edge_smooth_col(x, win, 5),
                "d2": w.second_difference_col(x, win, 2.0),
                "pk": w.local_max_col(x, win, F.lit(0.1)),
            },
        )
    )

    def per(fn):
        return np.concatenate([fn(g.x.to_numpy()) for _, g in p.groupby("k")])

    np.testing.assert_allclose(got.g, per(lambda a: np.gradient(a, 0.5)))
    np.testing.assert_allclose(got.sd, per(lambda a: pd.Series(a).rolling(5, min_periods=1).std()), rtol=1e-9)
    np.testing.assert_allclose(got.md, per(lambda a: pd.Series(a).rolling(5, min_periods=2).median()))
    np.testing.assert_allclose(got.es, per(lambda a: np.convolve(np.pad(a, 2, mode="edge"), np.ones(5) / 5, "valid")))

    def d2(a):
        r = np.zeros(len(a))
        r[1:-1] = (a[2:] - 2 * a[1:-1] + a[:-2]) * 4
        return r

    def pk(a):
        r = np.zeros(len(a), bool)
        for i in range(1, len(a) - 1):
            r[i] = a[i] >= 0.1 and a[i] >= a[i - 1] and a[i] >= a[i + 1]
        return r

    np.testing.assert_allclose(got.d2, per(d2), atol=1e-12)
    assert (got.pk.to_numpy() == per(pk)).all()


def test_gradient_missing_neighbour_is_missing(spark):
    d = spark.createDataFrame([(1, float(i), i, x) for i, x in enumerate([1.0, None, 3.0, 4.0, 6.0])], "k int, t double, id int, x double")
    got = back(w.features(d, SEQ, 1, 1, lambda win: {"g": w.central_gradient_col(F.col("x"), win, 1.0)}))
    assert got.g.isna().tolist() == [True, False, True, False, False]
    one = spark.createDataFrame([(1, 0.0, 0, 5.0)], "k int, t double, id int, x double")
    assert back(w.features(one, SEQ, 1, 1, lambda win: {"g": w.central_gradient_col(F.col("x"), win, 1.0)})).g[0] == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.88, 1.0])
@pytest.mark.parametrize("small", [10, 10_000])
def test_exact_percentile(data, q, small):
    p, d = data
    got = o.exact_percentile(d, ["k"], "x", q, "p", small=small, salt=4).toPandas().sort_values("k")
    want = p.groupby("k").x.apply(lambda s: np.percentile(s, 100 * q))
    np.testing.assert_allclose(got.p.to_numpy(), want.to_numpy(), rtol=1e-12)


def test_trailing_time_and_ema(data):
    p, d = data
    got = back(w.trailing_time(d, SEQ, 9.5, lambda win: {"m": F.max("v").over(win), "c": F.count("*").over(win)}))
    want_m, want_c = [], []
    for _, g in p.groupby("k"):
        t = np.round(g.t.to_numpy() * 1e6).astype("int64")
        for i in range(len(g)):
            hit = (t <= t[i]) & (t >= t[i] - 9_500_000)
            want_m.append(g.v.to_numpy()[hit].max())
            want_c.append(hit.sum())
    assert got.m.tolist() == want_m
    assert got.c.tolist() == want_c
    for a in (0.05, 0.4, 0.97):
        e = back(w.ema(d, SEQ, "x", a))
        want = p.groupby("k").x.transform(lambda s: s.ewm(alpha=a, adjust=False).mean())
        np.testing.assert_allclose(e.ema, want, rtol=1e-9, atol=1e-12)


def test_streak_cumulative_interpolate(data, spark):
    p, d = data
    got = back(w.streak(d, SEQ, F.col("f")))
    want = []
    for _, g in p.groupby("k"):
        n = 0
        for f in g.f:
            n = n + 1 if f else 0
            want.append(n)
    assert got.streak.tolist() == want
    s = p.drop_duplicates(["k", "t"])
    ds = spark.createDataFrame(s[["k", "t", "x"]])
    q = pd.DataFrame({"k": np.repeat(np.arange(6), 40), "t": np.tile(np.linspace(-5, 130, 40), 6), "qid": np.arange(240)})
    r = w.interpolate_at(ds, spark.createDataFrame(q), o.Seq(("k",), ("t",), 7.0), "x", "y").toPandas().sort_values("qid")
    want = np.concatenate([np.interp(q[q.k == k].t, g.t, g.x) for k, g in s.groupby("k")])
    np.testing.assert_allclose(r.y.to_numpy(), want, rtol=1e-9)
