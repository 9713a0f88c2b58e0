import random
import re

import numpy as np
import pytest

from spanwise.llm import shingles
from spanwise.llm.common import components


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs):
    sets = [plain_set(t) for _, t in docs]
    root = [i for i, _ in docs]
    moved = True
    links = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {docs[k][0]: (len(sets[k]), root[k]) for k in range(len(docs))}


def family(rng, n=260):
    words = [f"w{k}" for k in range(60)] + ["É", "İ", "Straße", "A", "a"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 12, 20, 40, 80, 200]))] for _ in range(25)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            w = w or ["x"]
        docs.append((i * 3, rng.choice([" ", "\t", " \n", "\x0b"]).join(rng.choice([str.upper, str])(x) if x.isascii() else x for x in w)))
    docs += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "ONE"), (9005, " x y"), (9006, "v " * 30000), (9007, "v " * 29999)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = family(random.Random(seed))
    df = spark.createDataFrame([(i, t, 5, "e") for i, t in docs], "doc_id long, text string, n_shingles int, _e string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.near_documents(df).collect()}
    assert got == plain(docs)


def test_signatures_share_for_every_close_pair():
    rng = np.random.default_rng(0)
    for percent in (75, 60, 90):
        for _ in range(400):
            n = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop, add = rng.integers(0, n // 3 + 2, 2)
            b = np.unique(np.concatenate([rng.permutation(a)[min(drop, len(a)) :], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(shingles.signatures(a, percent), shingles.signatures(b, percent))), (len(a), len(b), both)
                assert shingles.distance(len(a), len(b), shingles.sketch(a), shingles.sketch(b), percent) is not None


def test_representatives(spark):
    rows = [(4, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "A B C D E F G H"), (None, "lone one"), (None, "lone one"), (7, None), (7, ""), (8, "x y z")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _h int")
    got = sorted((r["doc_id"] or 99, r["text"] or "-") for r in shingles.representatives(df).collect())
    assert got == [(3, "a b c d e f g h"), (7, "-"), (7, "-"), (8, "x y z"), (99, "lone one")]
    empty = df.limit(0)
    assert shingles.representatives(empty).count() == 0 and shingles.near_documents(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 200) if k % 67] + [(500, k) for k in range(501, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in root} == root
