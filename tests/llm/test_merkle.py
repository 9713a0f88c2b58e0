"""Manifest: against a plain recursive tree, for many sizes and depths, and edge cases."""

from hashlib import sha256

import pytest

from spanwise.llm import merkle

FIELDS = ["doc_id", "source", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Root, and for each node its (before, after) steps."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    tops = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
    root, above = tree([h(*t) for t in tops])
    return root, [[("".join(t[:k]), "".join(t[k + 1 :])), *above[j]] for j, t in enumerate(tops) for k in range(len(t))]


def naive(rows):
    groups = {}
    for key, source, lang, text in rows:
        groups.setdefault(lang, []).append((key is not None, key or 0, h(said(key), said(source), said(text)), key))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    root, over = tree([t[0] for t in trees])
    return sorted(((x[3], x[2], sub, root, steps + up) for g, (sub, below), up in zip(order, trees, over, strict=True) for x, steps in zip(sorted(groups[g], key=lambda x: x[:3]), below, strict=True)), key=str)


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, text string, place int")
    out = merkle.manifest(docs, FIELDS, **kw).withColumn("back", merkle.folded(merkle.F.col("leaf"), merkle.F.col("proof"))).collect()
    assert all(r["back"] == r["root"] for r in out)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in out), key=str)


@pytest.mark.parametrize(("sizes", "depth"), [((1,), 1), ((9, 1, 8, 7), 1), ((600, 65, 64, 63), 1), ((73, 130), 2), ((20, 4), 4)])
def test_trees(spark, sizes, depth):
    rows = [(i * 7919 % 100_003, f"s{i % 3}", f"l{g}", "é" * (i % 5)) for g, n in enumerate(sizes) for i in range(n)]
    assert got(spark, rows, depth=depth) == naive(rows)


def test_many_groups_nulls_and_repeats(spark):
    rows = [(i, None, None if i % 70 == 0 else f"{'ä' if i % 2 else ''}{i % 70}", None if i % 4 == 0 else "") for i in range(200)]
    rows += [(5, "a", "", "x" * 1_000_000)] * 3 + [(None, "a", "", "t"), (None, None, None, None), (5, "b", "", "y")] * 2
    assert got(spark, rows, depth=1) == naive(rows)


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, "s", "l", f"Text {i}") for i in range(100)], "doc_id long, source string, lang string, text string")
    seen = merkle.leaf_hash([merkle.F.col("doc_id"), merkle.F.col("source"), merkle.F.when(merkle.F.col("doc_id") == 42, "text 42").otherwise(merkle.F.col("text"))])
    out = merkle.manifest(docs.withColumn("seen", seen), FIELDS, carry=["seen"], depth=1)
    wrong = out.filter(merkle.folded(merkle.F.col("seen"), merkle.F.col("proof")) != merkle.F.col("root")).collect()
    assert [r["doc_id"] for r in wrong] == [42]


def test_empty_table(spark):
    assert got(spark, []) == []
    with pytest.raises(ValueError, match="root"):
        merkle.manifest(spark.createDataFrame([], "doc_id long, lang string, root string"), ["doc_id"], carry=["root"])
