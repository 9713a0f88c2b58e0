"""Secrets in whole texts: exact base patterns, and spans that a linear-chain field tags.

A text is split into tokens; each has features of its shape, of the words before and after it
and of its whole text. The field is learned from a bounded sample in which the values of base
matches are BEGIN and INSIDE; in half of its windows the words are left out, so that shapes
carry weight of their own. It tags every token of every text by Viterbi; what it tags
besides the base matches is added. All steps run on arrays over some megabytes of texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import free_name
from spanwise.llm.crf import BEGIN, INSIDE, OUTSIDE, Chain, best_labels, learn

# ---- Fixed values: span kinds in order, their patterns (assign: on lower-cased bytes) ----
KINDS = ("assign", "access", "hex", "tagged")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
# ---- end of fixed values ----

#: Bytes of texts that are looked at together; a longer text is looked at alone.
CHUNK = 2 << 20
SPACE, LOWER, UPPER, DIGIT, JOINER, HIGH, PUNCT = range(7)
LENGTHS = np.array([2, 3, 5, 8, 12, 16, 20, 24, 32, 33, 40, 41, 64, 128])
WORDS, HEADS = 4096, 1024
#: Numbers of values of each feature; the four in the middle are words around the token.
SIZES = (256, 32, 80, 32, WORDS, WORDS, WORDS, WORDS, WORDS, HEADS, 64, 32)
FIRST = np.concatenate(([0], np.cumsum(SIZES)))
AROUND = range(4, 8)
#: Tokens on each side of a training window's middle, its longest length, windows of each sort a document gives.
SIDE, STEPS, PER_TEXT = 16, 48, 2
SPANS = "array<struct<start:int,kind:int,end:int>>"


def byte_classes() -> np.ndarray:
    out = np.full(256, PUNCT, dtype=np.uint8)
    out[:33] = SPACE
    out[127] = SPACE
    out[ord("a") : ord("z") + 1] = LOWER
    out[ord("A") : ord("Z") + 1] = UPPER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[list(b"_-+/.")] = JOINER
    out[128:] = HIGH
    return out


CLASSES = byte_classes()
LOWERED = np.arange(256, dtype=np.uint64)
LOWERED[65:91] += 32
#: Two counts of 32 bits each in one number.
CASES = np.where(CLASSES == LOWER, 1, 0) + np.where(CLASSES == UPPER, 1 << 32, 0)
DIGITS = np.where(CLASSES == DIGIT, 1, 0) + np.where((CLASSES == DIGIT) | np.isin(np.arange(256), list(b"abcdef")), 1 << 32, 0)


class Texts:
    """Texts laid end to end as bytes, a newline after each, and their tokens.

    Tokens are runs of letters, digits, joiners and bytes beyond ASCII; any other byte that is no
    white space is a token of its own. A dot belongs to a token only where a letter or digit follows.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join([*texts, b""])
        self.code = np.frombuffer(self.data, dtype=np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        kind = CLASSES[self.code]
        plain = (kind >= LOWER) & (kind <= DIGIT)
        word = plain | (kind == JOINER) | (kind == HIGH)
        follows = np.concatenate((plain[1:], [False]))
        word &= (self.code != ord(".")) | follows
        some = kind != SPACE
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        self.start = np.flatnonzero(some & ~(word & before))
        self.end = np.flatnonzero(some & ~(word & after)) + 1
        self.owner = np.searchsorted(self.ends, self.start, side="right")
        self.kind = kind

    def token_ends(self) -> np.ndarray:
        """Exclusive ends of the texts among the tokens."""
        return np.searchsorted(self.start, self.ends)

    def code_points(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Byte positions as code points counted from the begin of their text."""
        upto = np.concatenate(([0], np.cumsum((self.code & 0xC0) != 0x80)))
        return upto[at] - upto[self.begins[owner]]

    def counts(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token the sums of a byte table's two packed counts."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.empty(2 * len(self.start), dtype=np.int64)
        cuts[::2], cuts[1::2] = self.start, self.end
        values = table if len(table) == len(self.code) else table[self.code]
        packed = np.add.reduceat(np.append(values, 0), cuts)[::2]
        return packed & 0xFFFFFFFF, packed >> 32

    def heads(self, n: int, lower: bool) -> np.ndarray:
        """The first n bytes of each token as one number."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        top = len(self.code) - 1
        for i in range(n):
            byte = self.code[np.minimum(self.start + i, top)]
            byte = LOWERED[byte] if lower else byte.astype(np.uint64)
            out = (out << np.uint64(8)) | np.where(self.start + i < self.end, byte, np.uint64(0))
        return out


def mixed(x: np.ndarray, size: int) -> np.ndarray:
    """Numbers 1 to size - 1, spread by multiplication; 0 is left for none."""
    h = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (h % np.uint64(size - 1)).astype(np.int64) + 1


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (tokens x features), and which tokens have a digit and eight bytes."""
    n = t.end - t.start
    lower, upper = t.counts(CASES)
    digit, hexed = t.counts(DIGITS)
    same = np.concatenate(([True], t.kind[1:] == t.kind[:-1]))
    joiner, changes = t.counts(np.where(t.kind == JOINER, 1, 0) + np.where(~same, 1 << 32, 0))
    bucket = np.searchsorted(LENGTHS, n, side="right")
    flags = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (joiner > 0)
    varied = np.searchsorted([1, 10, 25, 40], 100 * np.maximum(changes - 1, 0) // n, side="right")
    share = np.minimum(8 * digit // n, 7) * 4 + np.minimum(4 * upper // n, 3)

    word = mixed(t.heads(8, lower=True) + n.astype(np.uint64) * np.uint64(0x100000001B3), WORDS)
    out = np.empty((len(n), len(SIZES)), dtype=np.int32)
    out[:, 0] = bucket * 16 + flags
    out[:, 1] = bucket + 16 * (hexed == n)
    out[:, 2] = varied * 16 + bucket
    out[:, 3] = share
    for column, by in zip(AROUND, (1, 2, 3, -1), strict=True):
        far = np.zeros(len(n), dtype=np.int64)
        if by > 0:
            far[by:] = np.where(t.owner[by:] == t.owner[:-by], word[:-by], 0)
        else:
            far[:by] = np.where(t.owner[:by] == t.owner[-by:], word[-by:], 0)
        out[:, column] = far
    out[:, 8] = np.where(digit > 0, 0, word)
    out[:, 9] = np.where(digit > 0, mixed(t.heads(4, lower=False), HEADS), 0)

    texts = len(t.ends)
    tokens = np.maximum(np.bincount(t.owner, minlength=texts), 1)
    hard = (digit > 0) & (n >= 8)
    signs = np.bincount(t.owner, weights=t.kind[t.start] == PUNCT, minlength=texts)
    sparse = np.minimum(16 * signs // tokens, 7).astype(np.int64)
    many = np.searchsorted([1, 3, 10], np.bincount(t.owner, weights=hard, minlength=texts), side="right")
    out[:, 10] = (sparse * 4 + many)[t.owner] * 2 + (digit > 0)
    out[:, 11] = np.minimum(np.log2(tokens).astype(np.int64), 15)[t.owner] * 2 + (digit > 0)
    out += FIRST[:-1].astype(np.int32)
    return out, hard


def base_spans(t: Texts) -> np.ndarray:
    """Rows of start, kind, end, begin of the value, end of the value (byte positions).

    No match can hold a newline, so none crosses from one text to the next.
    """
    rows = []
    low = t.data.lower()
    if any(w in low for w in (b"passw", b"secret", b"token", b"api")):
        rows += [(m.start(), 0, m.end(), m.start(2), m.end()) for m in ASSIGN.finditer(low) if m.end() - m.start(2) >= LEAST_VALUE]
    rows += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(t.data) if m.end() - m.start() >= LEAST_ACCESS]
    rows += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(t.data)]
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def token_labels(t: Texts, base: np.ndarray) -> np.ndarray:
    """BEGIN and INSIDE for tokens within the value of a base span, else OUTSIDE."""
    out = np.full(len(t.start), OUTSIDE, dtype=np.int8)
    for lo, hi in base[:, 3:]:
        a, b = np.searchsorted(t.start, lo), np.searchsorted(t.end, hi, side="right")
        if a < b and out[a] == OUTSIDE:
            out[a:b] = INSIDE
            out[a] = BEGIN
    return out


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in texts:
        if held and size + len(x) > CHUNK:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


# ---- learning ----------------------------------------------------------------------------


def windows(texts: list[bytes]) -> Iterator[tuple[bool, bytes, bytes]]:
    """Has a secret, feature numbers, labels of some stretches of each text: around base
    values, around other tokens that have digits, and around a middle token."""
    for part in chunks(texts):
        t = Texts(part)
        f, hard = features(t)
        labels = token_labels(t, base_spans(t))
        stop = t.token_ends()
        for lo, hi in zip(np.concatenate(([0], stop[:-1])), stop, strict=True):
            if lo == hi:
                continue
            found = np.flatnonzero(labels[lo:hi] == BEGIN)[:PER_TEXT] + lo
            other = np.flatnonzero(hard[lo:hi] & (labels[lo:hi] == OUTSIDE))[:PER_TEXT] + lo
            for at in (*found, *other, (lo + hi) // 2):
                a = max(lo, at - SIDE)
                b = min(hi, a + STEPS)
                yield bool((labels[a:b] != OUTSIDE).any()), f[a:b].astype(np.uint16).tobytes(), labels[a:b].tobytes()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 20_000, each: int = 1_000) -> Chain | None:
    """The field learned from about ``sample`` documents, chosen by a hash of key and text.

    At most ``each`` windows with and ``each`` without a secret come to the driver, again chosen
    by hash (of those without one, so many are made as give about twice ``each``); these bounds
    are the only sampling. None where no window has a secret.
    """
    n = docs.count()
    if not n:
        return None
    million = 1_000_000
    thin = max(1, min(n, sample) // (2 * each))
    rows = docs.select(F.xxhash64(key, text).alias("_h"), F.col(text).cast("binary").alias("_t"))
    rows = rows.filter(F.col("_t").isNotNull() & (F.pmod("_h", F.lit(million)) < int(min(1.0, sample / n) * million)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(hit, by, f, y) for hit, f, y in windows(b.column("_t").to_pylist()) if (by := crc32(f)) % thin == 0 or hit]
            hit, by, f, y = zip(*got, strict=True) if got else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.bool_()), pa.array(by, pa.int64()), pa.array(f, pa.binary()), pa.array(y, pa.binary())], names=["hit", "by", "f", "y"])

    found = rows.select("_t").mapInArrow(cut, "hit boolean, by long, f binary, y binary")
    place = F.row_number().over(Window.partitionBy("hit").orderBy("by", "f", "y"))
    got = found.withColumn("_n", place).filter(F.col("_n") <= each).orderBy("by", "f", "y").collect()
    if not any(r["hit"] for r in got):
        return None
    width = len(SIZES)
    x = np.zeros((len(got), STEPS, width), dtype=np.int32)
    y = np.zeros((len(got), STEPS), dtype=np.int64)
    lengths = np.zeros(len(got), dtype=np.int64)
    for i, r in enumerate(got):
        f = np.frombuffer(r["f"], dtype=np.uint16).reshape(-1, width)
        lengths[i] = len(f)
        x[i, : len(f)] = f
        y[i, : len(f)] = np.frombuffer(r["y"], dtype=np.int8)
    x[::2, :, list(AROUND)] = FIRST[list(AROUND)]
    chain = learn(x, y, lengths, int(FIRST[-1]))
    return Chain(chain.weights.astype(np.float32), chain.transitions)


# ---- tagging -----------------------------------------------------------------------------


def tagged_spans(t: Texts, chain: Chain, base: np.ndarray) -> np.ndarray:
    """Rows of start and end (bytes) of tagged stretches that overlap no base span."""
    f, _ = features(t)
    stop = t.token_ends()
    labels = best_labels(chain, chain.scores(f), stop)
    on = np.flatnonzero(labels != OUTSIDE)
    if not len(on):
        return np.zeros((0, 2), dtype=np.int64)
    fresh = np.concatenate(([True], (np.diff(on) > 1) | (np.diff(t.owner[on]) > 0))) | (labels[on] == BEGIN)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(on)) - 1
    start, end = t.start[on[first]], t.end[on[last]]
    reach = np.concatenate(([-1], np.maximum.accumulate(base[:, 2]))) if len(base) else np.array([-1])
    free = reach[np.searchsorted(base[:, 0], end, side="left")] <= start
    return np.stack((start[free], end[free]), axis=1)


def spans_of(texts: list[bytes], chain: Chain | None) -> pa.Array:
    """For each text its spans (start, kind, end) in code points, sorted."""
    counts, columns = [], []
    for part in chunks(texts):
        t = Texts(part)
        base = base_spans(t)
        rows = base[:, :3]
        if chain is not None and len(t.start):
            more = tagged_spans(t, chain, base)
            rows = np.concatenate((rows, np.stack((more[:, 0], np.full(len(more), KINDS.index("tagged")), more[:, 1]), axis=1)))
        owner = np.searchsorted(t.ends, rows[:, 0], side="right")
        rows = np.stack((t.code_points(rows[:, 0], owner), rows[:, 1], t.code_points(rows[:, 2], owner)), axis=1)
        columns.append(rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], owner))])
        counts.append(np.bincount(owner, minlength=len(part)))
    every = np.concatenate(columns) if columns else np.zeros((0, 3), dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)) if counts else []))
    fields = [pa.array(every[:, i].astype(np.int32)) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(fields, names=["start", "kind", "end"]))


def find_secrets(docs: DataFrame, chain: Chain | None, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with an array column of spans (start, kind, end), sorted by start, then kind.

    Kinds are numbers of KINDS; positions count code points, ends are exclusive. Base spans of
    different kinds may overlap and all stay; tagged ones overlap no base span. A null or
    empty text has none; equal texts have equal spans. A text of any length is looked at whole,
    in about forty times its own memory. Ties cannot occur: equal starts are ordered by kind, and
    spans of one kind do not overlap. The new column is the last one; while another column has
    its name, underscores are added to it. No rows in, no rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        return spans_of(texts.to_pylist(), shared.value)

    # so marked, it is worked out once, however often its spans are used
    return docs.withColumn(free_name(docs, into), scan.asNondeterministic()(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


__all__ = ["KINDS", "find_secrets", "fit", "listing"]
