"""Streams in several runs: strikes do not depend on how frames are fed, the sink on replays, late rows are counted."""

import random

from pyspark.sql import functions as F

from spanwise.plans.config import BusConfig
from spanwise.streaming import stateful as st
from spanwise.streaming.strikes import StrikeStream, ring_segments, strike_stream

CFG = StrikeStream(fps=10.0)


def poses(n, seed):
    """(frame, lx, ly, rx, ry) of a slow walk with some bursts."""
    rng = random.Random(seed)
    out, p = [], [0.3, 0.5, 0.6, 0.5]
    for i in range(n):
        p = [x + rng.uniform(-1, 1) * (0.2 if i % 17 in (3, 4, 5) else 0.01) for x in p]
        out.append((i, *p))
    return out


def naive(frames):
    """Every search over a plain list of the last frames."""
    seen, out = set(), []
    for k in range(15, len(frames)):
        if (k - 14) % 2:
            continue
        lo = max(0, k - 23)
        part = frames[lo : k + 1]
        v = [0.0] + [10 * max(((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2) ** 0.5, ((b[3] - a[3]) ** 2 + (b[4] - a[4]) ** 2) ** 0.5) for a, b in zip(part, part[1:])]
        m = len(v) - 1
        sm = [sum(v[min(max(j + d, 0), m)] for d in range(-2, 3)) / 5 for j in range(m + 1)]
        s = sorted(x for x in sm if x > 1e-12)
        h = (len(s) - 1) * 0.85
        thr = s[int(h)] + (s[min(int(h) + 1, len(s) - 1)] - s[int(h)]) * (h - int(h))
        runs = []
        for j in [j for j, x in enumerate(sm) if x > thr]:
            if runs and j - runs[-1][1] - 1 <= 8:
                runs[-1][1] = j
            else:
                runs.append([j, j])
        for a, b in runs:
            if b + lo >= k - 6 and b + lo + 1 >= k - 4 and (a + lo, b + lo) not in seen:
                seen.add((a + lo, b + lo))
                out.append((a + lo, b + lo, k))
    return out


def test_strikes_in_runs(spark, tmp_path):
    sessions = {s: poses(40 + 30 * s, s) for s in range(3)}
    rows = [(s, i, *[None] * 0, lx, ly, rx, ry) for s, f in sessions.items() for i, lx, ly, rx, ry in f]
    d = spark.createDataFrame(rows, "session int, frame int, j9x double, j9y double, j10x double, j10y double").withColumns({f"j{k}{a}": F.lit(0.5) for k in range(5, 9) for a in "xy"})
    want = sorted((s, *r) for s, f in sessions.items() for r in naive(f))
    for name, cuts in (("one", [0, 1000]), ("three", [0, 13, 29, 1000])):
        parts = [d.filter((F.col("frame") >= a) & (F.col("frame") < b)) for a, b in zip(cuts, cuts[1:])]
        out, _ = st.in_steps(parts, lambda x: strike_stream(x, ["session"], "frame", CFG), str(tmp_path / name))
        assert sorted((r["session"], r["start_index"], r["end_index"], r["found_at"]) for r in out.collect()) == want
    assert want


def test_no_motion_gives_no_segments():
    assert ring_segments([0.0] * 20, CFG) == []


def test_sink_ignores_replays_and_unfinished_batches(spark, tmp_path):
    sink = st.UpsertSink(str(tmp_path / "sink"), ["run", "frame"], ["order"])
    batch = lambda *rows: spark.createDataFrame(rows, "run int, frame int, order int, score double")
    sink(batch((1, 1, 0, 0.1), (1, 1, 1, 0.2), (1, 2, 0, 0.3)), 0)
    sink(batch((1, 2, 0, 0.9)), 1)
    want = [(1, 1, 0.2), (1, 2, 0.9)]
    got = lambda: sorted((r["run"], r["frame"], r["score"]) for r in sink.read(spark).collect())
    assert got() == want
    sink(batch((1, 1, 5, 7.0)), 0)
    assert got() == want
    batch((1, 1, 5, 8.0)).write.parquet(str(tmp_path / "sink/data/batch=2"))  # ended before the ledger knew of it
    assert got() == want
    sink(batch((1, 1, 5, 9.0)), 2)
    assert got() == [(1, 1, 9.0), (1, 2, 0.9)]


def test_late_rows_are_counted_and_silence_closes(spark, tmp_path):
    cfg = BusConfig(merge_gap=10.0, cooldown=20.0, silence=30.0)
    d = spark.createDataFrame([(0, "a", 1, 100), (0, "a", 2, 105), (1, "a", 3, 300), (2, "a", 4, 102), (2, "a", 5, 290), (2, "a", 6, 305)], "part int, kind string, id int, s int")
    d = d.select("part", "kind", "id", F.timestamp_seconds("s").alias("ts"), F.lit(0.5).alias("score"))
    parts = [d.filter(F.col("part") == k).drop("part") for k in range(3)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out, dropped = st.in_steps(parts, lambda x: st.episode_stream(x, ["kind"], "ts", "id", "score", cfg, "50 seconds"), str(tmp_path / "late"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert dropped == 1  # 102 is behind 300 - 50; 290 is not and merges
    rows = {r["episode"]: (r["n_obs"], r["finished"]) for r in st.current_episodes(out, ["kind"]).collect()}
    assert rows == {0: (2, True), 1: (3, False)}


def test_episode_rows_travel_in_batches_of_many_keys():
    """No frame is built for each key: a key has few rows and there are many keys."""
    from spanwise.plans.config import BusConfig
    from spanwise.streaming import stateful as st

    class Held:
        def __init__(self):
            self.v, self.timers = None, []

        exists, get = (lambda self: self.v is not None), (lambda self: self.v)

        def update(self, v):
            self.v = v

        listTimers = lambda self: self.timers
        registerTimer = lambda self, t: self.timers.append(t)

    p = st.EpisodeProcessor(["u", "kind"], BusConfig())
    p.state = p.handle = Held()
    rows = [{"t_us": t, "tie": i, "obs_score": 0.5, "forced": False} for i, t in enumerate((2, 1))]
    (got,) = p.handleInputRows(("a", "b"), iter(rows), None)
    assert got.asDict() == {"u": "a", "kind": "b", "episode": 0, "start_us": 1, "seen_us": 2, "n_obs": 2, "score": 0.5, "finished": False}
