import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanwise.llm import bpe, language, lengths

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = "<|startoftext|>"

TEXTS = [
    None,
    "",
    " ",
    "\t\x1c\x1d   \x85",
    "Hello, WORLD! it's 12.5 don't we've you'll I'd 'x ''s .'s",
    f"a{SPECIAL}b <|endoftext|> c",
    "Σίσυφος ΣΑΣ İstanbul ǅ é Å",
    "北京大学 日本語 한국어 😀😀 ½ ² ³",
    "ßäöü ÑÇ œ Ÿ",
    "x" * 5000,
    "thequickbrownfox" * 700,
    ("!?." * 900) + " tail",
    "émigré" * 900 + SPECIAL + "done" * 600,
    "1234567890" * 300,
    "ab" * 1025 + " " + "c" * 1024,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def rows(spark, texts):
    data = [(i, t, 7, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, coded int, decoded string")


def test_bpe_equals_library(spark, library):
    out = bpe.with_codes(rows(spark, TEXTS + TEXTS).withColumnRenamed("coded", "other"), WORD_BPE).collect()
    assert [r["decoded"] for r in out] == ["n"] * len(out)
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", bytes(r["coded"]["ids"]))) == want, r["text"]
        assert r["coded"]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_tree_concatenation(library):
    rng = random.Random(5)
    enc = bpe.Encoder(WORD_BPE, leaf=8)
    for n in range(300):
        letters = rng.choice(["ab", "theandingtion", "éèaou", "aaab", "xyzq"])
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 200)))
        assert enc.encode_split(word) == library.encode(word, add_special_tokens=False).ids, word


def test_decode_ids(spark, library):
    out = bpe.decode_ids(bpe.with_codes(rows(spark, TEXTS).select("text"), WORD_BPE).select("coded.*"), WORD_BPE, into="again")
    assert out.filter("again <> decoded").count() == 0


def test_bpe_empty_table(spark):
    assert bpe.with_codes(rows(spark, []).drop("coded"), WORD_BPE).count() == 0


def test_lengths(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = TEXTS + ["word and  more \n\n" * 9000, "a" * 70000 + " b"]
    got = {r["doc_id"]: r["n"] for r in lengths.with_length(rows(spark, texts), RANKS, into="n").collect()}
    want = [len(enc.encode_ordinary(t or "")) for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    hist = lengths.length_histogram(spark.createDataFrame([(x,) for x in want], "n_tokens long"))
    by = {r["length"]: r for r in hist.collect()}
    assert sorted(by) == sorted(set(want))
    for n, r in by.items():
        assert r["docs_at_least"] == sum(x >= n for x in want) and r["tokens_at_least"] == sum(x for x in want if x >= n)
        assert r["docs_below"] == sum(x < n for x in want) and r["tokens_below"] == sum(x for x in want if x < n)
        assert r["tokens_kept"] == sum(min(x, n) for x in want)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in want) / len(want))
    for limit in (0, 3, 1000, 10**6):
        assert lengths.at_limit(hist, limit).first()["tokens_kept"] == sum(min(x, limit) for x in want)
    assert lengths.at_quantile(hist, 0.5).first()[0] == sorted(want)[(len(want) - 1) // 2]
    empty = lengths.length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert empty.count() == 0 and lengths.at_limit(empty, 5).first()["docs"] == 0 and lengths.at_quantile(empty, 0.5).first()[0] is None


def corpus(spark, n=400):
    rng = random.Random(1)
    parts = {"en": "the and ing tion wh ed er of", "de": "sch ung ver ich keit ge und ein", "fr": "eau que ment oi les ez ai ou"}
    data = []
    for i in range(n):
        lang = rng.choice(list(parts))
        data.append((i, " ".join("".join(rng.choices(parts[lang].split(), k=3)) for _ in range(40)), lang if rng.random() < 0.9 else None, lang))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, truth string")


def test_language(spark):
    docs = corpus(spark)
    model = language.fit(docs.filter(F.col("doc_id") % 5 > 0))
    got = language.identify(docs, model).filter(F.col("doc_id") % 5 == 0).select("truth", "language.*").collect()
    assert sum(r["truth"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    odd = rows(spark, [None, "", "123 ...", "\U0001f600", "tion", "x" * 9])
    res = language.identify(odd, model).orderBy("doc_id").select("language.*").collect()
    assert [r["lang_pred"] == "und" for r in res] == [True, True, True, True, False, False]
    assert all(0 <= r["score"] <= 1 for r in res)
    assert language.identify(odd.limit(0), model).count() == 0
    none = language.fit(docs.limit(0))
    assert {r[0] for r in language.identify(odd, none).select("language.lang_pred").collect()} == {"und"}


def test_language_does_not_depend_on_neighbours(spark):
    docs = corpus(spark, 60)
    model = language.fit(docs, per_language=10)
    texts = [r["text"] for r in docs.select("text").collect()] + ["", None, "ab", "c"]
    together, _ = language.score_texts(texts, model)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], language.score_texts([t], model)[0][0])


def test_digest_of_ids(spark, library):
    from spanwise.llm.queries import QUERIES

    got = QUERIES["op6_bpe"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
