import random

import pytest

from spanwise.llm import repeats


def plain(docs, width):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    order = [x for x in texts if x[0] is not None]
    for i, b in sorted(order, key=lambda x: x[0]) + [(10**9, b) for i, b in texts if i is None]:
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < (10**9 if i is None else i):
                gone[p : p + width] = b"\x01" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), kept))
    return sorted(out)


def corpus(rng, n=120):
    passages = ["".join(rng.choice("ab ñ") for _ in range(rng.randrange(20, 200))) for _ in range(12)] + ["ab" * 90, "x" * 150]
    docs = []
    for i in range(n):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 90)))]) for _ in range(rng.randrange(1, 6))]
        docs.append((i if rng.random() < 0.97 else rng.randrange(n), "".join(parts)[rng.randrange(30) :]))
    docs += [(900, None), (901, ""), (902, "short"), (903, "y" * 3000), (904, "y" * 2999 + "z"), (None, passages[0] * 2), (None, passages[1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "block", "width"), [(1, 1 << 20, 50), (2, 700, 50), (3, 90, 24), (4, 2000, 7)])
def test_against_every_window(spark, seed, block, width):
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_bytes int, kept string").repartition(4)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.without_repeats(df, width, block=block).collect())
    assert got == plain(docs, width)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
