"""Removal of repeated passages: depth-limited radix ordering of suffixes.

Two suffixes that agree through ``width`` bytes are a repeat. Suffixes are put in order by
passes over digits of their first ``width`` bytes, most significant first, and only those that
are still in a group of several documents go on:

1. The first digit is the least hash of the short substrings inside the window. Consecutive
   windows share it, so a run of windows moves as one entry: (digit, hash of the whole run).
   Entries alone with their digit are unique and stop here. Entries equal as a whole are
   decided here: all windows of the run repeat.
2. Where one digit has different runs, their windows are ordered by all ``width`` bytes;
   equal groups are exactly the repeated windows.

Texts travel as compressed blocks of documents; what one block holds several times is one
entry with its smallest id, so a common passage is one entry per block, not per document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import cut, last_id, order_key, partitions

U = np.uint64
#: Bytes of a block, and windows worked on at one time.
BLOCK = 1 << 20
#: Length of the substring whose least hash is the first digit.
GRAM = 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U))


def hashes(x: np.ndarray, widths: Iterable[int]) -> list[np.ndarray]:
    """Hash of the substring of each width at each position, put together from halves."""
    level = {1: byte_values()[x]}
    w = 1
    while 2 * w <= max(widths):
        h = level[w]
        level[2 * w] = h[:-w] * U(0x9E3779B97F4A7C15 ^ (w << 1)) + mix_light(h[w:])
        w *= 2

    def of(width: int) -> np.ndarray:
        at, out = 0, None
        for bit in sorted(level, reverse=True):
            if width - at >= bit:
                h = level[bit]
                n = len(x) - width + 1
                piece = h[at : at + n]
                out = piece if out is None else out * U(0xD6E8FEB86659FD93) + mix_light(piece)
                at += bit
        return mix(out)

    return [of(w) for w in widths]


def mix_light(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> U(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        h, w = np.minimum(h[:-w], h[w:]), 2 * w
    return np.minimum(h[: len(h) - (width - w)], h[width - w :]) if w < width else h


class Runs(NamedTuple):
    """Runs of consecutive windows with one first digit, in the documents of a block."""

    doc: np.ndarray  # position of the document in the block
    start: np.ndarray  # first window, as an offset in the document
    size: np.ndarray  # number of windows
    digit: np.ndarray
    whole: np.ndarray  # hash of all bytes of the run
    at: np.ndarray  # first window, as an offset in ``windows``
    windows: np.ndarray  # hash of each window


def runs_of(docs: list[bytes], width: int, block: int) -> Runs:
    gram = min(GRAM, width)
    parts: list[tuple] = []
    hashed: list[np.ndarray] = []
    base = 0
    batch: list[tuple[int, int, bytes]] = []
    size = 0

    def work() -> None:
        nonlocal base
        x = np.frombuffer(b"".join(b for _, _, b in batch), np.uint8)
        length = np.array([len(b) for _, _, b in batch])
        first = np.cumsum(length) - length
        window, small = hashes(x, (width, gram))
        low = sliding_min(small, width - gram + 1)
        valid = np.ones(len(low), bool)
        for s in first[1:]:
            valid[s - width + 1 : s] = False
        change = np.r_[True, (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])]
        change[first] = True
        start = np.flatnonzero(change)
        end = np.r_[start[1:], len(low)]
        keep = valid[start]
        start, end = start[keep], end[keep]
        # a run of equal digits (periodic text) is cut so that its two outer windows cover it
        pieces = -(-(end - start) // width)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + step * width
        end = np.minimum(start + width, np.repeat(end, pieces))
        whole = mix(window[start] * U(0xFF51AFD7ED558CCD) + mix_light(window[end - 1]) + (end - start).astype(U))
        k = np.searchsorted(first, start, side="right") - 1
        doc, offset = np.array([d for d, _, _ in batch]), np.array([o for _, o, _ in batch])
        parts.append((doc[k], offset[k] + start - first[k], end - start, mix(low[start]), whole, start + base))
        hashed.append(window)
        base += len(window)

    for d, data in enumerate(docs):
        for lo in range(0, max(len(data) - width + 1, 0), block):
            piece = data[lo : lo + block + width - 1]
            batch.append((d, lo, piece))
            size += len(piece)
            if size >= block:
                work()
                batch, size = [], 0
    if batch:
        work()
    if not parts:
        i, u = np.zeros(0, np.int64), np.zeros(0, U)
        return Runs(i, i, i, u, u, i, u)
    return Runs(*[np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate(hashed))


class Entries(NamedTuple):
    """What a block says to the others: sorted keys, each with its smallest id; ``of`` gives the entry of each row."""

    digit: np.ndarray
    whole: np.ndarray
    low: np.ndarray
    of: np.ndarray


def entries(digit: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> Entries:
    order = np.lexsort((doc, whole, digit))
    g, w, d = digit[order], whole[order], doc[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])] if len(g) else np.zeros(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return Entries(g[new], w[new], d[new], of)


#: Bytes of a digit and of an id that travel; of the rest 6 for runs (it is compared within one digit), 2 for windows.
DIGIT, ID, RUN_REST, WINDOW_REST = 6, 8, 6, 2


def planes(columns: Iterable[tuple[np.ndarray, int]]) -> bytes:
    """The low bytes of each column, laid out byte by byte so that equal ones stand together."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes() for c, k in columns)


def unplanes(data: bytes, n: int, widths: Iterable[int]) -> list[np.ndarray]:
    out, at = [], 0
    for k in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :k] = np.frombuffer(data, np.uint8, k * n, at).reshape(k, n).T
        out.append(full.view("<u8")[:, 0])
        at += k * n
    return out


def packs(number: int, e: Entries, buckets: int, rest: int) -> pa.RecordBatch:
    bucket = ((e.digit >> U(16)) * U(buckets)) >> U(32)
    lo = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    hi = np.r_[lo[1:], len(bucket)] if len(lo) else lo
    data = [planes(((e.digit[a:b], DIGIT), (e.whole[a:b], rest), (e.low[a:b], ID))) for a, b in zip(lo, hi, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[lo].astype(np.int32)), pa.array(np.full(len(lo), number)), pa.array(lo, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "base", "pack"])


def run_entries(runs: Runs, ids: np.ndarray) -> Entries:
    return entries(runs.digit >> U(16), runs.whole >> U(16), ids[runs.doc])


def window_entries(h: np.ndarray, doc: np.ndarray) -> Entries:
    return entries(h >> U(16), h & U(0xFFFF), doc)


PACKS = "bucket int, block long, base long, pack binary"
ANSWER = "block long, kind int, at binary"
REPEATED, OPEN, WINDOW = 0, 1, 2


def answers(key, t: pa.Table, wide: bool) -> pa.Table:
    """For each block, which of its entries repeat (a smaller id has the same), and which are open."""
    blocks, bases = t.column("block").to_numpy(), t.column("base").to_numpy()
    raw = t.column("pack").to_pylist()
    widths = (DIGIT, RUN_REST if wide else WINDOW_REST, ID)
    sizes = np.array([len(p) // sum(widths) for p in raw])
    digit, whole, low = (np.concatenate(c) for c in zip(*[unplanes(p, n, widths) for p, n in zip(raw, sizes, strict=True)], strict=True))
    low = low.view(np.int64)
    pack = np.repeat(np.arange(len(raw)), sizes)
    index = np.arange(len(digit)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bases[pack]
    order = np.lexsort((low, whole, digit))
    digit, whole, low, pack, index = digit[order], whole[order], low[order], pack[order], index[order]
    new_digit = np.r_[True, digit[1:] != digit[:-1]]
    new = new_digit | np.r_[True, whole[1:] != whole[:-1]]
    group = np.cumsum(new) - 1
    least = low[new][group]
    repeated = low > least
    open_ = np.zeros(len(low), bool)
    if wide:
        top = np.cumsum(new_digit) - 1
        firsts = np.flatnonzero(new)
        lead = np.flatnonzero(new_digit[firsts])
        span_min, span_max = np.minimum.reduceat(least[firsts], lead), np.maximum.reduceat(least[firsts], lead)
        open_ = ~repeated & (span_min < span_max)[top]
    out: dict[str, list] = {"block": [], "kind": [], "at": []}
    for kind, mask in ((REPEATED if wide else WINDOW, repeated), (OPEN, open_)):
        rows = np.flatnonzero(mask)
        rows = rows[np.lexsort((index[rows], blocks[pack[rows]]))]
        b = blocks[pack[rows]]
        lo = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
        for x, y in zip(lo, np.r_[lo[1:], len(b)] if len(b) else [], strict=True):
            out["block"].append(int(b[x]))
            out["kind"].append(kind)
            out["at"].append(index[rows[x:y]].astype("<u4").tobytes())
    return pa.table({"block": pa.array(out["block"], pa.int64()), "kind": pa.array(out["kind"], pa.int32()), "at": pa.array(out["at"], pa.binary())})


def unblock(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, size = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    at = 8 + 16 * n + np.r_[0, np.cumsum(size)]
    return ids, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def blocks_of(docs: DataFrame, text: str, block: int) -> DataFrame:
    """block, data: about ``block`` bytes of documents (_doc, text) each, compressed. Cut, so a block stays the same."""

    def gather(batches):
        press = zstandard.ZstdCompressor(level=5)
        ids: list[int] = []
        data: list[bytes] = []
        size = k = 0
        part = None

        def close() -> pa.RecordBatch:
            n = np.array([len(ids), *ids, *[len(d) for d in data]], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([press.compress(n.tobytes() + b"".join(data))], pa.binary())], names=["block", "data"])

        for b in batches:
            part = b.column("_part")[0].as_py() if b.num_rows else part
            for i, t in zip(b.column("_doc").to_pylist(), b.column(text).to_pylist(), strict=True):
                ids.append(i)
                data.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(data[-1])
                if size >= block or len(ids) >= 65_536:
                    yield close()
                    ids, data, size, k = [], [], 0, k + 1
        if ids:
            yield close()

    part = docs.withColumn("_part", F.spark_partition_id().cast("long"))
    return cut(part.mapInArrow(gather, "block long, data binary"))


def told(t: pa.Table, kind: int) -> np.ndarray:
    got = [np.frombuffer(a, "<u4") for a, k in zip(t.column("at").to_pylist(), t.column("kind").to_pylist(), strict=True) if k == kind]
    return np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)


def open_windows(runs: Runs, first: Entries, ids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of open entries, from the document that holds the entry's smallest id: run, offset in ``windows``, hash."""
    flag = np.zeros(len(first.digit), bool)
    flag[open_] = True
    rows = np.flatnonzero(flag[first.of] & (ids[runs.doc] == first.low[first.of]))
    size = runs.size[rows]
    run = np.repeat(rows, size)
    at = runs.at[run] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return run, at, runs.windows[at]


def cover(ids: np.ndarray, docs: list[bytes], width: int, block: int, repeated: np.ndarray, open_: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(id, bytes, removed, removed spans, kept bytes) of each document of a block."""
    runs = runs_of(docs, width, block)
    own = ids[runs.doc]
    first = run_entries(runs, ids)
    flag = np.zeros(len(first.digit), bool)
    flag[repeated] = True
    full = flag[first.of] | (own > first.low[first.of])
    run, at, h = open_windows(runs, first, ids, open_)
    second = window_entries(h, ids[runs.doc[run]])
    flag = np.zeros(len(second.digit), bool)
    flag[window] = True
    hit = flag[second.of] | (ids[runs.doc[run]] > second.low[second.of])
    run, at = run[hit], at[hit]
    doc = np.concatenate([runs.doc[full], runs.doc[run]])
    start = np.concatenate([runs.start[full], runs.start[run] + at - runs.at[run]])
    end = start + np.concatenate([runs.size[full], np.ones(len(run), np.int64)]) - 1 + width
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    bound = np.searchsorted(doc, np.arange(len(docs) + 1))
    for k, data in enumerate(docs):
        s, e = start[bound[k] : bound[k + 1]], end[bound[k] : bound[k + 1]]
        if not len(s):
            yield int(ids[k]), len(data), 0, 0, data
            continue
        step = np.zeros(len(data) + 1, np.int64)
        np.add.at(step, s, 1)
        np.add.at(step, e, -1)
        gone = np.cumsum(step[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        yield int(ids[k]), len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()


def without_repeats(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes if it lies in a string of ``width`` bytes that also starts in a document of a
    smaller id; strings are judged on the texts as given. A null text is empty; texts under
    ``width`` bytes stay. A null id orders last and is given back as null. Rows that share an
    id do not remove each other's strings. Strings are equal if their 64-bit hashes are. An empty table gives no row.
    """
    if width < 2:
        raise ValueError("width is at least 2")
    rows = docs.select(last_id(key).alias("_doc"), F.col(text).cast("string").alias("_text"))
    blocks = blocks_of(rows, "_text", block)
    buckets = 4 * partitions(docs.sparkSession)

    def say(batches):
        for b in batches:
            for number, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
                ids, texts = unblock(data)
                runs = runs_of(texts, width, block)
                yield packs(number, run_entries(runs, ids), buckets, RUN_REST)

    wide = blocks.mapInArrow(say, PACKS).groupBy("bucket").applyInArrow(lambda k, t: answers(k, t, True), ANSWER)
    wide = cut(wide)

    def ask(key, left, right):
        out = []
        for number, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True):
            open_ = told(right, OPEN)
            if len(open_):
                ids, texts = unblock(data)
                runs = runs_of(texts, width, block)
                run, _, h = open_windows(runs, run_entries(runs, ids), ids, open_)
                out.append(packs(number, window_entries(h, ids[runs.doc[run]]), buckets, WINDOW_REST))
        return pa.Table.from_batches(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("base", pa.int64()), ("pack", pa.binary())]))

    # both cogroups are in one plan, so the blocks are dealt by number only once
    by = blocks.groupBy("block")
    fine = by.cogroup(wide.filter(F.col("kind") == OPEN).groupBy("block")).applyInArrow(ask, PACKS)
    fine = fine.groupBy("bucket").applyInArrow(lambda k, t: answers(k, t, False), ANSWER)

    def finish(key, left, right):
        out = []
        for data in left.column("data").to_pylist():
            ids, texts = unblock(data)
            out += cover(ids, texts, width, block, *[told(right, k) for k in (REPEATED, OPEN, WINDOW)])
        c = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.table({n: pa.array(c[k], kinds[k]) for k, n in enumerate(("_doc", "n_bytes", "n_removed", "n_spans", "kept"))})

    done = by.cogroup(wide.unionByName(fine).groupBy("block")).applyInArrow(finish, "_doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(order_key(F.col("_doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")
