"""From raw documents to token ids: five stages, each one operator over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each as Parquet
in the shared folder and reads it as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import bpe, language, lines, mixing, shingles
from spanwise.llm.common import free_name, shared_folder, small_batches, staged
from spanwise.llm.queries import vocabulary
from spanwise.plans.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A document whose likeliest language is less probable than this is rejected.
LEAST_SCORE = 0.5
#: Share of the tokens that the mix is expected to keep.
KEEP = 0.5


def columns_of(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or no likely language; a missing lang is filled in.

    Null and empty texts have no letter, so they go here. Learned from the labelled rows of
    ``docs``; where none is labelled nothing can be judged and every text with a letter stays.
    """
    small_batches(spark)
    model = language.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    name = free_name(docs, "_language")
    found = F.col(name)
    kept = language.identify(docs, model, into=name).filter((found["lang_pred"] != language.UND) & (found["score"] >= LEAST_SCORE))
    return columns_of(kept.withColumn("lang", F.coalesce(F.col("lang"), found["lang_pred"])), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line nearly equals; n_chars follows. A document that
    loses lines and has only blank ones left goes, others stay."""
    name = free_name(docs, "_lines")
    out = lines.dedup_lines(docs, into=name, **lines.NEAR, **lines.EQUAL)
    fewer = F.col(name)["n_removed"] > 0
    lost = fewer & (F.trim(F.translate("text", "\t\n\r", "   ")) == "")
    changed = F.when(fewer, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return columns_of(out.filter(~F.coalesce(lost, F.lit(False))).withColumn("n_chars", changed), docs)


def join_near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    small_batches(spark)
    return columns_of(shingles.representatives(docs, 75), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet tempered shares of source, language and topic."""
    return columns_of(mixing.sample(docs, keep=KEEP), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (the tokens as text)."""
    small_batches(spark)
    out = bpe.with_codes(docs.select("doc_id", "source", "lang", "text"), vocabulary("word_bpe_49k.json"), into="_coded")
    ids = F.col("_coded.ids")
    return out.select("doc_id", "source", "lang", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"), F.col("_coded.decoded").alias("decoded"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_documents", join_near_documents),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Naive Bayes, edit distances in linear space and byte pairs have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = staged(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
