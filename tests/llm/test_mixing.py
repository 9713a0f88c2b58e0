import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import mixing


def corpus(spark, n=3000):
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(["w" * int(rng.integers(1, 9)) for _ in range(int(rng.integers(0, 30)))]) or None, ["a", "b", None][int(rng.integers(0, 3)) if i % 3 else 0], ["en", "de"][int(rng.integers(0, 2))], "w") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")


def test_margins_are_met(spark):
    docs = corpus(spark)
    given = {"source": {"a": 0.2, None: 0.5}, "lang": {"de": 0.75}}
    out = mixing.mix(docs, keep=0.3, given=given).cache()
    assert out.columns == [*docs.columns, "_mix"] and out.count() == docs.count()
    w = F.col("_mix.weight") * F.col("_mix.tokens")
    total = out.agg(F.sum(w)).first()[0]
    share = lambda c: {r[0]: r[1] / total for r in out.groupBy(f"_mix.{c}").agg(F.sum(w)).collect()}
    assert share("source") == pytest.approx({"a": 0.2, None: 0.5, "b": 0.3}, abs=1e-6)
    assert share("lang") == pytest.approx({"de": 0.75, "en": 0.25}, abs=1e-6)
    seen = {r[0]: r[1] for r in out.groupBy("_mix.topic").agg(F.sum("_mix.tokens")).collect()}
    z = sum(v**0.5 for v in seen.values())
    assert share("topic") == pytest.approx({k: v**0.5 / z for k, v in seen.items()}, abs=1e-6)
    tokens, kept = out.agg(F.sum("_mix.tokens"), F.sum(F.col("_mix.tokens") * F.col("_mix.probability"))).first()
    assert kept == pytest.approx(0.3 * tokens, rel=1e-6)
    drawn = out.filter("_mix.sampled").agg(F.sum("_mix.tokens")).first()[0]
    assert drawn == pytest.approx(kept, rel=0.1)
    assert out.filter("_mix.probability > 1 or _mix.probability < 0").count() == 0


def test_edges(spark):
    docs = corpus(spark, 40)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.sample(docs, keep=1.0).count() == docs.filter("text is not null").count()
    twice = mixing.mix(docs.unionByName(docs)).groupBy("doc_id", "text").agg(F.count_distinct("_mix.sampled").alias("n")).filter("n > 1")
    assert twice.count() == 0
    blank = spark.createDataFrame([(None, None, None, None), (1, "", "a", "x"), (2, " \n ", "a", "x")], "doc_id long, text string, source string, lang string")
    assert [r[0] for r in mixing.mix(blank).select("_mix.sampled").collect()] == [False] * 3


def test_goals_are_met_under_the_bound_with_a_hot_source(spark):
    """One source holds a third of the rows and half of the cells fill up; expected tokens still meet every goal."""
    rng = np.random.default_rng(7)
    rows = [(i, "w " * int(rng.integers(1, 40)), "hot" if i % 3 == 0 else f"s{int(rng.integers(0, 12))}", ["en", "de", "es"][int(min(2, rng.exponential(0.7)))], f"t{int(rng.integers(0, 5))}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    margins = {m: F.col(m) for m in ("source", "lang", "topic")}
    out = mixing.mix(docs, keep=0.6, margins=margins).cache()
    p = F.col("_mix.probability")
    assert out.filter(p == 1).count() > 0 and out.filter((p > 1) | (p < 0)).count() == 0
    tokens = out.agg(F.sum("_mix.tokens")).first()[0]
    for m in margins:
        got = {r[0]: (r[1], r[2]) for r in out.groupBy(m).agg(F.sum("_mix.tokens"), F.sum(F.col("_mix.tokens") * p)).collect()}
        goal = {k: 0.0 for k in got}
        free, left = set(got), 0.6 * tokens
        while True:  # what full values cannot take goes to the others
            z = sum(got[k][0] ** 0.5 for k in free)
            goal |= {k: left * got[k][0] ** 0.5 / z for k in free}
            full = {k for k in free if goal[k] > got[k][0]}
            if not full:
                break
            goal |= {k: got[k][0] for k in full}
            left -= sum(got[k][0] for k in full)
            free -= full
        assert {k: v[1] for k, v in got.items()} == pytest.approx(goal, rel=1e-3)
    assert out.select("_mix.miss").first()[0] < 1e-3


def test_goals_out_of_reach_raise(spark):
    docs = corpus(spark, 300)
    with pytest.raises(ValueError, match="needs"):
        mixing.mix(docs, keep=0.9, given={"lang": {"de": 0.99}})
    rows = [(i, "a b c", "x" if i < 50 else "y", "en" if i < 50 else "de") for i in range(100)]
    tied = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    with pytest.raises(ValueError, match="together"):
        mixing.mix(tied, keep=0.5, given={"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.1, "de": 0.9}})
