import numpy as np
import pytest

from spanwise.llm.vectors import nearest, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, tile int, _v string"


def frame(spark, items):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, "x") for i, v in items], SCHEMA)


def odd(rng, n=300, dim=16):
    base = rng.normal(size=(n, dim))
    for k in range(60):
        base[n - 1 - k] = base[k % 7] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.35])
    base[100:140] = base[100]
    items = [(int(i), v.astype(np.float32)) for i, v in zip(rng.permutation(n) * 5, base, strict=True)]
    items += [(9001, None), (9002, [0.0] * dim), (9003, [None] + [1.0] * (dim - 1)), (9004, [float("nan")] * dim), (9005, [float("inf")] + [0.0] * (dim - 1)), (9006, [1.0, 2.0]), (9007, [])]
    return items, {i: np.asarray(v, np.float64) for i, v in items[:n]}


def cosines(good):
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids, x @ x.T


@pytest.mark.parametrize("seed", [1, 2])
def test_near_vectors(spark, seed, monkeypatch):
    import spanwise.llm.vectors as m

    monkeypatch.setattr(m, "STRIP", 16)
    items, good = odd(np.random.default_rng(seed))
    got = {r["vec_id"]: r for r in near_vectors(frame(spark, items)).collect()}
    assert len(got) == len(items)
    ids, s = cosines(good)
    adj = s >= 0.9
    np.fill_diagonal(adj, False)
    root = {i: i for i in ids}
    for _ in ids:
        for a in range(len(ids)):
            for b in np.flatnonzero(adj[a]):
                root[ids[a]] = min(root[ids[a]], root[ids[b]])
    for a, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (adj[a].sum(), root[i], root[i] == i)
    for i in range(9001, 9008):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_tiles_are_not_shuffled_for_their_pairs(spark, monkeypatch):
    import spanwise.llm.vectors as m

    plans = []

    def seen(df, f=m.cut):
        if df.columns == ["_a", "_b", "_c"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df)

    for name, value in (("cut", seen), ("TILE", 16), ("FOLD", 20)):
        monkeypatch.setattr(m, name, value)
    items, good = odd(np.random.default_rng(3))
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(frame(spark, items)).collect()}
    ids, s = cosines(good)
    assert [got[i] for i in ids] == ((s >= 0.9).sum(axis=1) - 1).tolist()
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_near_vectors_edges(spark):
    assert near_vectors(frame(spark, [])).count() == 0
    got = near_vectors(frame(spark, [(None, [1, 0]), (3, [1, 0]), (3, [1, 0]), (2, [0, 1]), (None, None)])).collect()
    assert sorted((r["vec_id"] is None, r["n_links"], r["component_id"]) for r in got if r["component_id"] is not None) == [(False, 0, 2), (False, 2, 3), (False, 2, 3), (True, 2, 3)]
    assert [(r["n_links"], r["kept"]) for r in got if r["component_id"] is None] == [(0, True)]
    assert {r["n_links"] for r in near_vectors(frame(spark, [(1, None), (2, [0.0])])).collect()} == {0}


@pytest.mark.parametrize("block", [8, 4096])
def test_nearest(spark, block):
    items, good = odd(np.random.default_rng(3))
    ids, s = cosines(good)
    df = frame(spark, items)
    got = nearest(df.filter("vec_id % 50 = 0"), df, probes=16, tables=3, block=block).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    assert set(found) == {i for i in ids if i % 50 == 0}
    for q, rows in found.items():
        a = ids.index(q)
        order = [j for j in sorted(range(len(ids)), key=lambda j: (-round(s[a, j], 12), ids[j])) if j != a][:5]
        hits += len({ids[j] for j in order} & {r["vec_id"] for r in rows})
        total += 5
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in rows}
        keys = [(-r["score"], r["vec_id"]) for r in rows]
        assert keys == sorted(keys)
        for r in rows:
            x, y = good[q], good[r["vec_id"]]
            assert r["score"] == pytest.approx(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y), abs=1e-13)
    assert hits >= 0.9 * total


def test_nearest_edges(spark):
    empty = frame(spark, [])
    assert nearest(empty, empty).count() == 0
    few = frame(spark, [(0, [1, 0]), (1, [-1, 0]), (2, [0, 1]), (2, [0, -1]), (None, [1, 1])])
    got = nearest(few.filter("vec_id = 0"), few, probes=1, tables=1).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 0.0), (1, -1.0)]
    same = frame(spark, [(i, [3, 4]) for i in range(30)])
    got = nearest(same.filter("vec_id = 0"), same, block=4).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]
