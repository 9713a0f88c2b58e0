"""Secrets: base patterns against plain regular expressions, the field against brute force, edge cases."""

import random
import re
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.llm import credentials as C
from spanwise.llm.crf import LABELS, Chain, best_labels, likelihood

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def naive(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def spans(texts, chain=None):
    return [[(s["start"], s["kind"], s["end"]) for s in row] for row in C.spans_of([t.encode() for t in texts], chain).to_pylist()]


PIECES = ["password", "PassWD", "secret", "toKen", "tokens", "api_key", "APIKEY", "api__key", "ſecret", "toKen", "=", ":", " ", "  ", '"', "'", "\n", "\t", "é", "中", "AKIA", "AKIAAB", "0123456789abcdef", "deadbeef" * 4, "AbC-1/2+3_4.=", "shortval", "seven77", "x", "ABCDEFGH01234567"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=5))
def test_base(texts):
    assert spans(texts) == [naive(t) for t in texts]


def total(chain, features, labels):
    emit = chain.scores(features)
    path = [0, *labels, 0]
    return sum(emit[i, y] for i, y in enumerate(labels)) + sum(chain.transitions[a, b] for a, b in zip(path, path[1:], strict=False))


def random_chain(rng, size=9):
    return Chain(rng.normal(0, 1.5, (size, LABELS)), rng.normal(0, 1, (LABELS, LABELS)))


def test_likelihood_and_gradient():
    rng = np.random.default_rng(5)
    chain = random_chain(rng)
    x, lengths = rng.integers(0, 9, (4, 5, 2)), np.array([5, 1, 3, 4])
    y = rng.integers(0, LABELS, (4, 5))
    want = 0.0
    for f, labels, n in zip(x, y, lengths, strict=True):
        every = [total(chain, f[:n], p) for p in product(range(LABELS), repeat=int(n))]
        want += total(chain, f[:n], labels[:n]) - np.logaddexp.reduce(every)
    got, grad, pairs = likelihood(chain, x, y, lengths)
    assert got == pytest.approx(want)
    for part, g in ((chain.weights, grad), (chain.transitions, pairs)):
        for i in np.ndindex(part.shape):
            part[i] += 1e-5
            high = likelihood(chain, x, y, lengths)[0]
            part[i] -= 2e-5
            low = likelihood(chain, x, y, lengths)[0]
            part[i] += 1e-5
            assert g[i] == pytest.approx((high - low) / 2e-5, abs=1e-4)


def test_viterbi():
    rng = np.random.default_rng(6)
    for turn in range(60):
        chain = random_chain(rng)
        chain.weights[:, 0] += turn % 6 * 2
        lengths = rng.integers(1, 8, 5)
        x = rng.integers(0, 9, (int(lengths.sum()), 2))
        ends = np.cumsum(lengths)
        got = best_labels(chain, chain.scores(x), ends)
        for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            best = max(product(range(LABELS), repeat=int(hi - lo)), key=lambda p: total(chain, x[lo:hi], p))
            assert total(chain, x[lo:hi], best) == pytest.approx(total(chain, x[lo:hi], got[lo:hi]))


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulrstn") for _ in range(rng.randint(2, 9))) for _ in range(n))


def code(rng, n, letters="0123456789abcdef"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        mail = f"{prose(rng, 1)}.{prose(rng, 1)}@{prose(rng, 1)}.example"
        number = " ".join(code(rng, 4, "0123456789") for _ in range(4))
        secret = f' {rng.choice(["token", "password", "api_key"])} = "{code(rng, rng.randint(20, 40))}" ' if i % 4 == 0 else " "
        rows.append((i, f"{prose(rng, 20)} {mail}{secret}{prose(rng, 15)}, {number} {prose(rng, 5)}."))
    return rows


def test_added_spans(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    chain = C.fit(docs)
    rng = random.Random(4)
    hidden = [code(rng, 28) for _ in range(20)]
    fresh = [f'{prose(rng, 12)} token -> "{h}" {prose(rng, 9)} {code(rng, 12, "0123456789")} {prose(rng, 1)}@{prose(rng, 1)}.example' for h in hidden]
    found = [[t[a:b] for a, k, b in s if C.KINDS[k] == "tagged"] for t, s in zip(fresh, spans(fresh, chain), strict=True)]
    assert sum(h in f for h, f in zip(hidden, found, strict=True)) >= 18
    assert all(set(f) <= {h} for h, f in zip(hidden, found, strict=True))
    clean = [f"{prose(rng, 30)}, {code(rng, 9, '0123456789')}. {prose(rng, 5)}" for _ in range(50)]
    assert not any(spans(clean, chain))
    for t, s in zip([t for _, t in corpus], spans([t for _, t in corpus], chain), strict=True):
        base = [x for x in s if x[1] < 3]
        assert base == naive(t)
        assert all(b <= x or y <= a for a, k, b in s if k == 3 for x, _, y in base)


def test_edges(spark, corpus):
    long = prose(random.Random(1), 60_000) + ' token = "' + "ab12" * 250_000 + '" end'
    texts = [None, "", " \n ", "token=12345678", "token=1234567", "é token=abcdefgh", "é token=abcdefgh", long, "\x00secret:  x secret:longenough1"]
    docs = spark.createDataFrame([(i // 2, t, "x", 5) for i, t in enumerate(texts)] + [(None, "token=12345678", None, None)], "doc_id long, text string, secrets string, SECRETS_ int")
    chain = C.fit(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert C.fit(docs.limit(0)) is None and C.fit(docs.filter("text = ''")) is None
    for model in (None, chain):
        out = C.find_secrets(docs, model)
        assert out.columns == ["doc_id", "text", "secrets", "SECRETS_", "secrets__"]
        rows = out.withColumn("said", C.listing(out["secrets__"])).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            assert [(s[0], s[1], s[2]) for s in r["secrets__"] if s[1] < 3] == naive(r["text"] or "")
            assert model is not None or r["said"] == ",".join(f"{C.KINDS[k]}:{a}:{b}" for a, k, b in naive(r["text"] or ""))
        assert rows[5]["secrets__"] == rows[6]["secrets__"]
    assert C.find_secrets(docs.limit(0), chain).collect() == []
