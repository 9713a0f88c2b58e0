"""Language of a text: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points scored at one time; bounds the memory of a task whatever the texts' length.
CHUNK = 1 << 19
UND = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Log-probability matrix (features, languages) and log priors; its size is fixed by ``features``."""

    languages: tuple[str, ...]
    prior: np.ndarray
    matrix: np.ndarray
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = field(default=15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-case code points; whatever is no letter is a space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[code], code, np.uint32(32))


def _features(code: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hashed n-gram that starts at each position."""
    n = len(code) - order + 1
    h = np.full(max(n, 0), np.uint32(0x9E3779B1 * order & 0xFFFFFFFF), dtype=np.uint32)
    for k in range(order):
        h ^= code[k : k + n]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def _packs(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of many texts in a row and each one's text number; a text over CHUNK comes in
    parts that overlap by two, so that no n-gram is lost."""
    codes: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        for lo in range(0, len(t), CHUNK):
            c = _codes(t[max(0, lo - 2) : lo + CHUNK]) if lo else _codes(" " + t[:CHUNK])
            codes += [c, np.array([32], np.uint32)]
            owner.append(np.full(len(c) + 1, i, dtype=np.int64))
            size += len(c) + 1
            if size >= CHUNK:
                yield np.concatenate(codes), np.concatenate(owner)
                codes, owner, size = [], [], 0
    if size:
        yield np.concatenate(codes), np.concatenate(owner)


def _runs(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


def _within(grams: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Only n-grams that end in the text they start in."""
    own = owner[: len(grams)]
    same = own == owner[len(owner) - len(grams) :]
    return (grams, own) if same.all() else (grams[same], own[same])


def score_texts(texts: Sequence[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log joint of each text and language, and whether the text has a letter."""
    total = np.zeros((len(texts), len(model.languages)))
    seen = np.zeros(len(texts), dtype=bool)
    for code, owner in _packs(texts):
        at = _runs(owner)
        seen[owner[at]] |= np.maximum.reduceat(code != 32, at)
        for order in model.orders:
            f, own = _within(_features(code, order, model.bits), owner, order)
            if len(f):
                cut = _runs(own)
                total[own[cut]] += np.add.reduceat(model.matrix[f], cut, axis=0, dtype=np.float64)
    return total + model.prior, seen


def labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 20_000, bits: int = 15, orders: tuple[int, ...] = (1, 2, 3), max_languages: int = 256) -> LanguageModel:
    """Learn from about ``per_language`` labelled rows of each language, chosen by a hash of the key.

    That bound is the only sampling; priors are counted over all labelled rows. The model
    that comes to the driver has at most 2^bits x languages counts, whatever the input. Rows
    without text or label teach nothing; without any, the model knows no language.
    """
    rows = labelled(docs, text, lang).select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.xxhash64(F.col(key)).alias("_h"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"over {max_languages} labels; clean the label column or raise max_languages")
    names = tuple(sorted(counts))
    if not names:
        return LanguageModel((), np.zeros(0), np.zeros((1 << bits, 0), np.float32), orders, bits)
    share = F.create_map(*[F.lit(x) for n in names for x in (n, int(min(1.0, per_language / counts[n]) * 1_000_000))])
    rows = rows.filter(F.pmod("_h", F.lit(1_000_000)) < share[F.col("_lang")])
    number = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(names) << bits, dtype=np.int64)
        for b in batches:
            label = np.fromiter((number[x] for x in b.column("_lang").to_pylist()), dtype=np.int64, count=b.num_rows)
            for code, owner in _packs(b.column("_text").to_pylist()):
                for order in orders:
                    f, own = _within(_features(code, order, bits), owner, order)
                    table += np.bincount((label[own] << bits) + f, minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["at", "n"])

    got = rows.select("_text", "_lang").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(len(names) << bits)
    table[got["at"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
    table = table.reshape(len(names), 1 << bits).T + 0.1
    prior = np.array([counts[n] for n in names], dtype=float)
    return LanguageModel(names, np.log(prior / prior.sum()), np.log(table / table.sum(axis=0)).astype(np.float32), orders, bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Column struct(lang_pred, score) for the whole text.

    ``und`` with score 0 for a null text, one without letters, or a model without languages;
    otherwise the likeliest language (the first by name of equals) and its posterior.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in parts:
            texts = [x if isinstance(x, str) else None for x in s]
            lang, score = np.full(len(texts), UND, dtype=object), np.zeros(len(texts))
            if m.languages and texts:
                total, seen = score_texts(texts, m)
                best = total.argmax(axis=1)
                p = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lang[seen] = np.array(m.languages, dtype=object)[best[seen]]
                score[seen] = p[seen]
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    # so marked, it is worked out once, also where a filter and a column both use it
    return guess.asNondeterministic()(F.col(text))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a column struct(lang_pred, score); other columns stay as they are."""
    return docs.withColumn(into, predict(docs, model, text))
