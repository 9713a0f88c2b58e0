import random
import re
import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from spanwise.llm import pii

# The contract's own patterns, read by another regular-expression engine.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def only(s):
    return re.sub(r"[^0-9]", "", s)


def base(text):
    text, out = text or "", []
    for k, (kind, pattern, test) in enumerate(
        [
            ("email", EMAIL, lambda s: True),
            ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
            ("card", CARD, lambda s: 12 <= len(only(s)) <= 19 and luhn(only(s))),
            ("phone", PHONE, lambda s: 9 <= len(only(s)) <= 15),
        ]
    ):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if test(m[0])]
    return sorted(out)


FIXED = [
    None,
    "",
    "a@b.c_d@e.f x@y@z.com ..@-.- é@b.de 😀 me.55@mail4.example.com",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.0255 1.2.3 97.51.17.173. 00000000300.1.1.1",
    "4417744280351547 4417-7442-8035-1547 4417 7442 8035 1547 44177442803515470 1 2 3  4417--7442 9807915762804490",
    "+1 (017) 555-7713 +12345678 +1234567890123456 +1-+1 (974) 555-3436 +(1) 5 +1 5 +12 34 56 78 9 .",
    "0" * 30 + " " + "7" * 12000,
    "a" * 30000 + "@" + "b" * 100 + ".c" * 500,
    "1 " * 20000,
    "call (212) 555 0199 or mail john.doe (at) example (dot) com",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" DE89 3704 0044 0532 0130 00',
]


def test_base_spans_equal_plain_regex(spark):
    rng = random.Random(2)
    bits = list("0123456789") + [" ", "-", ".", "+", "@", "a", "_", "(", ")", "4417744280351547", "é", "1.2.3.4", "x@y.z", "555-7713"]
    texts = FIXED + ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, "c", 3) for i, t in enumerate(texts)], "doc_id long, text string, start string, kind int")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs.repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i]["personal"]["base"]] == base(t), t
        every = [tuple(s) for s in got[i]["personal"]["all"]]
        assert set(base(t)) <= set(every) and every == sorted(every) and (got[i]["start"], got[i]["kind"]) == ("c", 3)
    assert got[9]["personal"]["all"] and got[10]["personal"]["all"]


def test_empty_and_listing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(docs).count() == 0
    one = spark.createDataFrame([(1, "x@y.z +1 (017) 555-7713"), (1, "x@y.z +1 (017) 555-7713"), (None, None)], "doc_id long, text string")
    got = pii.find_personal_data(one).select("doc_id", pii.listing(F.col("personal.base")).alias("s")).collect()
    assert sorted((r["doc_id"] or 0, r["s"]) for r in got) == [(0, ""), (1, "email:0:5,phone:6:23"), (1, "email:0:5,phone:6:23")]


def test_labelers_are_weighed():
    # labeler 1 is right, labeler 2 is noise, labeler 3 agrees with 1
    counts = [(0, a * 9 + b * 3 + a, 100) for a in (0, 2) for b in (0, 2)] + [(0, 2 * 9 + 0 + 1, 10)]
    post = pii.expectation_maximisation(counts)
    assert post[0, 2 * 9 + 0 + 2] > 0.9 > 0.1 > post[0, 0 + 2 * 3 + 0]


@pytest.mark.parametrize("piece", [" dot com", "(dot)a", "[dot] b"])
def test_long_repeats_of_added_patterns(spark, piece):
    """Recursive matching of these ended the executor before."""
    text = "joe at x" + piece * 100_000
    docs = spark.createDataFrame([(1, text), (2, "mail joe@example.com"), (3, "+1 " * 50_000), (4, "DE12 " + "ABCD " * 100_000), (5, "token=" + "x" * 500_000), (6, "555 " * 100_000)], "doc_id long, text string")
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == 6
    assert [[s["start"], s["end"]] for s in next(r for r in rows if r["doc_id"] == 2)["personal"]["base"]] == [[5, 20]]


def test_many_spans_in_one_text(spark):
    """Work is linear in the spans: base and added ones by the ten thousands, all placed."""
    n = 50_000
    text = "a@b.com 555-123-4567 x at y dot com; " * n
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t0 = time.time()
    row = pii.find_personal_data(docs).select(F.col("personal.base").alias("base"), F.size("personal.all").alias("n")).collect()[0]
    assert time.time() - t0 < 60
    assert [(s["start"], s["end"]) for s in row["base"]] == [(37 * i, 37 * i + 7) for i in range(n)]
    assert row["n"] >= n


def test_running(spark):
    values = [[], [3], list(range(1, 258)), [5, -1, 5, 9, 2] * 200]
    d = spark.createDataFrame([(v,) for v in values], "v array<int>")
    got = d.select("v", pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.greatest).alias("m")).collect()
    for r in got:
        assert r["s"] == list(accumulate(r["v"])) and r["m"] == list(accumulate(r["v"], max))
