import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_shingles import plain as plain_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lines string, _kd int"


def documents(spark, n=80):
    rng = random.Random(9)
    bits = {"en": "the and ing tion wh ed er of".split(), "de": "sch ung ver ich keit ge und ein".split()}
    stock = {k: [" ".join("".join(rng.choices(v, k=3)) for _ in range(12)) + "." for _ in range(25)] for k, v in bits.items()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(bits))
        text = "\n".join(rng.choice(stock[lang]) if rng.random() < 0.3 else " ".join("".join(rng.choices(bits[lang], k=3)) for _ in range(12)) for _ in range(rng.randrange(1, 6)))
        rows.append((i, text, lang if rng.random() < 0.8 else None, rng.choice(["a", "a", "b", None]), len(text), "x", 1))
    rows += [(500 + k, rows[k][1], *rows[k][2:]) for k in range(10)]
    rows += [(700, None, "en", "a", 0, None, 2), (701, "", None, None, None, None, 2), (702, "123 !!!", "en", "a", 7, "y", 3), (703, "the tion " * 20000, None, None, 1, "z", 4)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_each_stage_on_its_own_input(spark):
    rows, docs = documents(spark)
    out = docs
    for k, (_, stage) in enumerate(p.STAGES):
        before = [r.asDict() for r in out.collect()]
        out = stage(spark, spark.createDataFrame(out.collect(), out.schema), "")
        after = [r.asDict() for r in out.collect()]
        kept = {r["doc_id"] for r in after}
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert kept == {r[0] for r in rows} - {700, 701, 702} and all(r["lang"] for r in after)
        if k == 1:
            want = plain_lines([(r["doc_id"], r["text"]) for r in before], 20)
            assert {r["doc_id"]: r["text"] for r in after} == {i: w[0] for i, w in want.items() if not (w[2] and not (w[0] or "").strip(" \t\r\n"))}
            assert all(r["n_chars"] == len(r["text"]) for r in after if want[r["doc_id"]][2])
        if k == 2:
            assert kept == {root for _, root in plain_groups([(r["doc_id"], r["text"]) for r in before]).values()}
        if k == 3:
            assert 0 < len(kept) < len(before)
        if k == 4:
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            text = {r["doc_id"]: r["text"] for r in before}
            for r in after:
                ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
                assert list(struct.unpack(f"<{len(ids)}I", bytes(r["ids"]))) == ids and r["n_tokens"] == len(ids)


def test_empty_and_unlabelled(spark):
    _, docs = documents(spark, 12)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    assert p.identify_language(spark, docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"), "").count() == 12 + 10 + 1


def test_run(spark):
    got = p.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "decoded"] and got.count() > 20
