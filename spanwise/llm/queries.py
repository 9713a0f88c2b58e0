"""Queries of the text operators: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import bpe, credentials, language, lengths, lines, merkle, middle, mixing, oracles, pii, repeats, shingles, vectors
from spanwise.llm.common import small_batches
from spanwise.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the labelled documents are learned from; all are predicted.

    A null doc_id counts as the empty text for the fold (held out).
    """
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = language.fit(docs.filter(~held_out))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lengths.length_histogram(lengths.with_length(docs.select("text"), vocabulary("byte_bpe_50k.tiktoken")))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.with_codes(docs, vocabulary("word_bpe_49k.json"))
    ids, decoded = F.col("coded.ids"), F.col("coded.decoded")
    return out.select(
        "doc_id",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5)


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    m = F.col("_mix")
    return out.select("doc_id", m["source"].alias("source"), m["lang"].alias("lang"), m["topic"].alias("topic"), m["tokens"].alias("tokens"), F.round(m["weight"] * 1e6, 6).alias("weight"), F.round(m["probability"], 6).alias("probability"), m["sampled"].alias("sampled"))


SQL["op3_mixing"] = mixing.oracle()


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, every = F.col("personal.base"), F.col("personal.all")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)], F.sha2(pii.listing(base).cast("binary"), 256).alias("base_sha256"), pii.listing(every).alias("spans"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, of these only near an earlier line, and a digest of what is kept."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), **lines.NEAR, **lines.EQUAL)
    return out.select("doc_id", "line_dedup.*", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 75)


@query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest(output).alias("output_sha256"), digest(middle.restored(output, form)).alias("restored_sha256"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row (by hash of its id) is then tampered with: its text is lower-cased."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(F.crc32(number) % 3 == 0, lowered).otherwise(F.col("text"))
    seen = merkle.leaf_hash([*[F.col(f) for f in fields[:-1]], text])
    out = merkle.manifest(docs.withColumn("seen", seen), fields, carry=["seen"])
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), merkle.folded(F.col("seen"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op12_merkle_manifest"] = oracles.manifest()


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from a sample of the documents; all are scanned."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = credentials.find_secrets(docs, credentials.fit(docs))
    every, tagged = F.col("secrets"), credentials.KINDS.index("tagged")
    base = F.filter(every, lambda s: s["kind"] != tagged)
    count = lambda k: F.size(F.filter(every, lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(credentials.KINDS)], F.sha2(credentials.listing(base).cast("binary"), 256).alias("base_sha256"), credentials.listing(every).alias("spans"))


SQL["op11_fill_in_middle"] = oracles.FILL_IN_MIDDLE
SQL |= {"op8_jaccard_join": oracles.NEAR_DOCUMENTS, "op9_embedding_near_dedup": oracles.NEAR_VECTORS}
