"""Fill-in-middle: the boundary set against plain slicing, forms against a naive version, edge cases."""

from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.llm.middle import CHUNK, ArrayContainer, BitmapContainer, BoundarySet, RunContainer, fill_in_middle, restored


def check(text):
    bounds = BoundarySet.of(text.encode())
    assert len(bounds) == len(text) + 1
    step = max(1, len(text) // 50)
    for k in {*range(0, len(text) + 1, step), len(text)}:
        assert bounds.select(k) == len(text[:k].encode())
    return bounds


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=300))
def test_select(text):
    check(text)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("plain words " * 20_000, RunContainer),
        ("中" * 70_000, BitmapContainer),
        ("\U0001f600" * 200, ArrayContainer),
        ("x" * (CHUNK - 1) + "é" + "y" * CHUNK, RunContainer),
        ("", RunContainer),
    ],
)
def test_containers(text, kind):
    bounds = check(text)
    assert isinstance(bounds.containers[0], kind)
    assert bounds.nbytes() < 16 * CHUNK


def naive(key, text):
    text = text or ""
    h = sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_forms(spark):
    texts = [None, "", "a", "<", "<<S", "<P", "P>S>M>", "a<M>b", "é中\U0001f600" * 30, "line\nline\n" * 40_000, "中" * 90_000]
    rows = [(i * 31, t) for i, t in enumerate(texts * 6)] + [(None, "no id"), (7, "twice"), (7, "twice"), (2**62, "big id")]
    docs = spark.createDataFrame([(k, t, 1, "kept") for k, t in rows], "doc_id long, text string, fim int, form string")
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "fim", "form", "fim_"]
    got = out.select("doc_id", "text", "fim", out["form"], "fim_.*", restored(out["fim_.output"], out["fim_.form"]).alias("back")).collect()
    assert len(got) == len(rows)
    seen = set()
    for r in got:
        assert (r[4], r[5], r[6], r[7], r[8]) == naive(r[0], r[1])
        assert r["back"] == (r["text"] or "") and r["fim"] == 1 and r[3] == "kept"
        seen.add(r[5])
    assert seen == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
