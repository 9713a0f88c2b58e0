"""Jaccard join of word-shingle sets by PartEnum signatures.

Sets are banded by size; in the frame of a band any two sets that reach the threshold differ
in at most k elements. Hashing splits the elements into more than k parts, so at least one
part is the same in both sets; a part's content, with frame and part number, is a signature.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import components, cut, last_id, order_key, partitions

U = np.uint64
WIDTH = 5
#: Signatures of one Arrow batch are gathered up to this many before they are sent.
GATHER = 1_000_000
#: Ids up to this many (counted) are broadcast to the documents; beyond it they are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Sets of a group compared with one other at one time.
STRIP = 4096
#: Rounds in which each set tries its nearest partner outside its component, before all open pairs are tried.
NEAREST_ROUNDS = 2
#: Partition seeds a set may go through; see ``signatures``.
SEEDS = 6
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, 0x9E3779B97F4A7C15, U)]))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; of all words as one if there are fewer."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.zeros(0, U)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    top = int(size.max())
    value = (b[word].astype(U) + U(1)) * powers(1 << max(4, top.bit_length()))[inside]
    words = mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(U))
    w = min(width, len(words))
    h = np.full(len(words) - w + 1, U(w))
    for k in range(w):
        h = mix(h) + words[k : k + len(h)]
    return np.unique(mix(h))


def identity(s: np.ndarray) -> int:
    """A set's own hash."""
    return int(mix(np.array([(mix(s ^ U(0x5851F42D4C957F2D))).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


# ---- frames and signatures ---------------------------------------------------------------


class Frames:
    """Size bands for a threshold of percent/100: band i is [low[i], high[i]], high <= low / threshold.

    Frame i compares sets of band i with each other and with those of band i + 1.
    """

    def __init__(self, percent: int, largest: int = 1 << 40) -> None:
        self.low, self.high = [], []
        lo = 1
        while lo <= largest:
            hi = lo * 100 // percent
            self.low.append(lo)
            self.high.append(hi)
            lo = hi + 1
        # sizes a <= b, b <= a / t: at most (a + b)(1 - t)/(1 + t) elements differ, most for a = high
        self.differ = [(h + h * 100 // percent) * (100 - percent) // (100 + percent) for h in self.high]
        self.parts = [k + 1 + ceil(0.12 * k + 2 * sqrt(k)) if k else 1 for k in self.differ]

    def of(self, n: int) -> list[int]:
        i = int(np.searchsorted(self.low, n, side="right")) - 1
        return [i - 1, i] if i else [i]


@lru_cache(maxsize=8)
def frames(percent: int) -> Frames:
    return Frames(percent)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """One hash per part of each of the set's frames.

    An empty part is no signature: of p parts at least p - k agree, so a set with fewer empty
    parts than that agrees with its partner in one that is not empty. A set with more goes on
    to parts of another seed, as its partner then does too; after the last seed its empty
    parts count as signatures.
    """
    f, out = frames(percent), []
    for i in f.of(len(s)):
        p, spare = f.parts[i], f.parts[i] - f.differ[i]
        for seed in range(SEEDS):
            tag = mix(np.array([i * 64 + seed + 1], U))[0]
            h = mix(s ^ tag)
            part = ((h >> U(32)) * U(p)) >> U(32)
            total = np.zeros(p, U)
            np.add.at(total, part.astype(np.int64), mix(h))
            used = np.bincount(part.astype(np.int64), minlength=p) > 0
            enough = p - int(used.sum()) < spare
            sig = mix(total + mix(np.arange(p, dtype=U) + tag))
            out.append(sig if seed == SEEDS - 1 and not enough else sig[used])
            if enough:
                break
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the elements per bit, at least two bits an element: differing bits never outnumber differing elements."""
    bits = 1 << max(6, (2 * len(s)).bit_length())
    at, n = np.unique((s & U(bits - 1)).astype(np.int64), return_counts=True)
    flat = np.zeros(bits, np.uint8)
    flat[at] = n & 1
    return np.packbits(flat, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Least number of differing elements that two sketches prove."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def distance(n: int, m: int, a: bytes, b: bytes, percent: int) -> float | None:
    """Share of elements proven to differ, or None if size or sketch rules the pair out."""
    if 100 * min(n, m) < percent * max(n, m):
        return None
    d = apart(a, b)
    return d / (n + m) if d * (100 + percent) <= (n + m) * (100 - percent) else None


def across_group(e: np.ndarray, root: np.ndarray, n: np.ndarray, marks: list[bytes], percent: int, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group (in order of size) across components that size and sketch allow, without
    its smallest set, and how far apart their sketches are; ``best``: for each set only the nearest."""
    hub = e.min()
    words = [np.frombuffer(x, np.uint64) for x in marks]
    short = min(map(len, words))
    bits = np.stack([x if len(x) == short else np.bitwise_xor.reduce(x.reshape(-1, short), axis=0) for x in words])
    out, far = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    near, partner = np.full(len(e), np.inf), np.zeros(len(e), np.int64)
    for i in range(len(e) - 1):
        if e[i] == hub:
            continue
        # by size: only later ones within the size ratio
        top = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        for lo in range(i + 1, top, STRIP):
            q = np.arange(lo, min(lo + STRIP, top))
            q = q[(root[q] != root[i]) & (e[q] != hub)]
            d = np.bitwise_count(bits[q] ^ bits[i]).sum(axis=1, dtype=np.int64) / (n[q] + n[i])
            q, d = q[d * (100 + percent) <= 100 - percent + 1e-9], d[d * (100 + percent) <= 100 - percent + 1e-9]
            if not len(q):
                continue
            if best:
                closer = d < near[q]
                near[q[closer]], partner[q[closer]] = d[closer], i
                k = int(d.argmin())
                if d[k] < near[i]:
                    near[i], partner[i] = d[k], q[k]
            else:
                out.append(np.stack([np.minimum(e[q], e[i]), np.maximum(e[q], e[i])], axis=1))
                far.append(d)
    if best:
        has = np.flatnonzero(np.isfinite(near))
        return np.stack([e[partner[has]], e[has]], axis=1), near[has]
    return np.concatenate(out), np.concatenate(far)


# ---- Spark -------------------------------------------------------------------------------


def facts(rows: DataFrame, text: str) -> DataFrame:
    """_doc, _h, _e (hash of the set; null if empty) and _n of every row."""

    def measure(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column(text).to_pylist()]
            e = [identity(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("_doc"), b.column("_h"), pa.array(e, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["_doc", "_h", "_e", "_n"])

    return rows.withColumn("_h", F.xxhash64(text)).mapInArrow(measure, "_doc long, _h long, _e long, _n long")


def groups_of(rows: DataFrame, text: str, percent: int) -> DataFrame:
    """_members: sets (packed hashes, sorted) that share a signature, at least two.

    Signatures travel in packs, one per batch of documents and bucket of signatures, in which
    equal sets stand once. A pack is sorted and laid out by byte, so it compresses.
    """
    buckets = 4 * partitions(rows.sparkSession)

    def pack(sig: list[np.ndarray], own: list[int]) -> pa.RecordBatch:
        ids = np.array(own, np.int64)
        who = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(s) for s in sig])
        h = np.concatenate(sig)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        bucket = ((h >> U(32)) * U(buckets)) >> U(32)
        cutting = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        number, data = [], []
        for lo, hi in zip(cutting, np.r_[cutting[1:], len(h)], strict=True):
            used, local = np.unique(who[lo:hi], return_inverse=True)
            planes = h[lo:hi].view(np.uint8).reshape(-1, 8).T.tobytes()
            local = local.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
            number.append(int(bucket[lo]))
            data.append(np.array([hi - lo, len(used)], np.int64).tobytes() + planes + local + ids[used].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(data, pa.binary())], names=["_bucket", "_pack"])

    def emit(batches):
        sig, own, seen, size = [], [], set(), 0
        for b in batches:
            for t in b.column(text).to_pylist():
                s = shingle_set(t)
                e = identity(s) if len(s) else None
                if e is None or e in seen:
                    continue
                seen.add(e)
                sig.append(signatures(s, percent))
                own.append(e)
                size += len(sig[-1])
                if size >= GATHER:
                    yield pack(sig, own)
                    sig, own, seen, size = [], [], set(), 0
        if size:
            yield pack(sig, own)

    def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, k = np.frombuffer(data, np.int64, 2)
        h = np.frombuffer(data, np.uint8, 8 * n, 16).reshape(8, n).T.copy().view(U)[:, 0]
        local = np.frombuffer(data, np.uint8, 4 * n, 16 + 8 * n).reshape(4, n).T.copy().view(np.uint32)[:, 0]
        return h, np.frombuffer(data, np.int64, k, 16 + 12 * n)[local]

    def gather(key, t):
        parts = [unpack(d) for d in t.column("_pack").to_pylist()]
        h, e = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((e, h))
        h, e = h[order], e[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (e[1:] != e[:-1])]
        h, e = h[new], e[new]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        end = np.r_[start[1:], len(h)]
        keep = end - start > 1
        data = [e[lo:hi].tobytes() for lo, hi in zip(start[keep], end[keep], strict=True)]
        return pa.table({"_members": pa.array(data, pa.binary())})

    return rows.select(text).mapInArrow(emit, "_bucket int, _pack binary").groupBy("_bucket").applyInArrow(gather, "_members binary")


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose _doc is in ``ids``."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "_doc", "left_semi")


def sketches(docs: DataFrame, reps: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """_e, _n, _s of the wanted sets (column _e), from one document of each."""

    def draw(batches):
        for b in batches:
            sets = [s for s in (shingle_set(t) for t in b.column(text).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], names=["_e", "_n", "_s"])

    ids = cut(reps.join(wanted, "_e", "left_semi"))
    out = chosen(docs, ids.select("_doc").distinct()).mapInArrow(draw, "_e long, _n long, _s binary")
    return out.join(wanted, "_e", "left_semi").dropDuplicates(["_e"])


def sets_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """_e and its sorted shingle hashes."""

    def whole(batches):
        for b in batches:
            sets = [s for s in (shingle_set(t) for t in b.column(text).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["_e", "_set"])

    ids = cut(reps.join(wanted, "_e", "left_semi"))
    out = chosen(docs, ids.select("_doc").distinct()).mapInArrow(whole, "_e long, _set array<long>")
    return out.join(wanted, "_e", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, text: str, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets those that reach the threshold, by exact intersection."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("_e")).distinct())
    sets = cut(sets_of(docs, reps, wanted, text))
    both = pairs.join(sets.select(F.col("_e").alias("a"), F.col("_set").alias("sa")), "a").join(sets.select(F.col("_e").alias("b"), F.col("_set").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return cut(both.filter(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b").distinct())


def roots_of(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("_e"), F.col("root").alias("_root"))


def near_sets(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc, _h (of the text), _e, _n of every row of ``docs``, and _root: one set of its linked component.

    Equal sets are one set from the start. In a group of sets that share a signature each set
    is first held against the group's smallest; of those that can reach the threshold by
    size and sketch, each set's nearest is verified exactly, and components are formed. Then
    only groups that still hold more than one component are looked at again: first each set's
    nearest partner in another component, at last all pairs across components, less those
    that size and sketch rule out, are verified. So every pair that
    can be a link is verified or already joined, and no group's pairs are all listed.
    """
    rows = docs.select(last_id(key).alias("_doc"), F.col(text).cast("string").alias(text))
    every = cut(facts(rows, text))
    reps = cut(every.filter(F.col("_e").isNotNull()).groupBy("_e").agg(F.min("_doc").alias("_doc")))
    # many signatures have the same members
    groups = cut(groups_of(rows, text, percent).distinct())

    def star(batches):
        for b in batches:
            m = [np.frombuffer(x, np.int64) for x in b.column("_members").to_pylist()]
            if m:
                hub = np.repeat([x[0] for x in m], [len(x) - 1 for x in m])
                pairs = np.unique(np.stack([hub, np.concatenate([x[1:] for x in m])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    spokes = cut(groups.mapInArrow(star, "a long, b long").distinct())
    wanted = cut(spokes.select(F.explode(F.array("a", "b")).alias("_e")).distinct())
    marks = cut(sketches(rows, reps, wanted, text))

    def rule_out(batches):
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in ("n", "m", "x", "y")}
            d = pa.array([distance(*v, percent) for v in zip(c["n"], c["m"], c["x"], c["y"], strict=True)], pa.float64())
            keep = d.is_valid()
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), d.filter(keep)], names=["a", "b", "d"])

    one = marks.select(F.col("_e").alias("a"), F.col("_n").alias("n"), F.col("_s").alias("x"))
    two = marks.select(F.col("_e").alias("b"), F.col("_n").alias("m"), F.col("_s").alias("y"))
    able = cut(spokes.join(one, "a").join(two, "b").mapInArrow(rule_out, "a long, b long, d double"))

    def nearest_of(pairs: DataFrame) -> DataFrame:
        """Each b's nearest a, as pairs a < b."""
        one = pairs.groupBy("b").agg(F.min(F.struct("d", "a"))["a"].alias("a"))
        return one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tried = cut(nearest_of(able))
    links = verified(tried, rows, reps, text, percent)
    roots = roots_of(links)

    def spread(batches):
        for b in batches:
            m = [np.frombuffer(x, np.int64) for x in b.column("_members").to_pylist()]
            g = np.repeat(b.column("_g").to_numpy(), [len(x) for x in m])
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.concatenate(m) if m else np.zeros(0, np.int64))], names=["_g", "_e"])

    # pairs with a group's smallest are in ``able``; groups of three and more have others
    large = groups.filter(F.octet_length("_members") >= 24).select(F.xxhash64("_members").alias("_g"), "_members")
    members = large.mapInArrow(spread, "_g long, _e long")
    some = F.pmod("_g", F.lit(4 * partitions(docs.sparkSession)))

    def open_pairs(roots: DataFrame, best: bool) -> DataFrame:
        """Pairs (a, b, d) across components: with a group's smallest, and among the others of groups that hold several components."""

        def across(key, t):
            g, e, r, n = (t.column(c).to_numpy() for c in ("_g", "_e", "_root", "_n"))
            s = t.column("_s").to_pylist()
            order = np.lexsort((e, n, g))
            bound = np.flatnonzero(np.r_[True, np.diff(g[order]) != 0, True])
            got = [across_group(*[v[order[lo:hi]] for v in (e, r, n)], [s[i] for i in order[lo:hi]], percent, best) for lo, hi in zip(bound[:-1], bound[1:], strict=True)]
            pairs, far = (np.concatenate(c) for c in zip(*got, strict=True))
            pairs, first = np.unique(pairs, axis=0, return_index=True)
            return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "d": pa.array(far[first])})

        held = members.join(roots, "_e", "left").withColumn("_root", F.coalesce("_root", "_e"))
        open_ = held.groupBy("_g").agg(F.min("_root").alias("lo"), F.max("_root").alias("hi")).filter("lo <> hi").select("_g")
        held = held.join(open_, "_g", "left_semi").join(marks, "_e").select(some.alias("_some"), "_g", "_e", "_root", "_n", "_s")
        inner = held.groupBy("_some").applyInArrow(across, "a long, b long, d double")
        ra, rb = roots.select(F.col("_e").alias("a"), F.col("_root").alias("ra")), roots.select(F.col("_e").alias("b"), F.col("_root").alias("rb"))
        outer = able.join(ra, "a", "left").join(rb, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "d")
        return inner.unionByName(outer)

    # Nearest partners first: what they join need not be listed. Then whatever is still open.
    for best in (*[True] * NEAREST_ROUNDS, False):
        now = open_pairs(roots, best)
        now = cut((nearest_of(now) if best else now.select("a", "b").distinct()).join(tried, ["a", "b"], "left_anti"))
        if now.isEmpty():
            continue
        more = verified(now, rows, reps, text, percent)
        tried = tried.unionByName(now)
        if not more.isEmpty():
            links = cut(links.unionByName(more))
            roots = roots_of(links)
    return every.join(roots, "_e", "left").withColumn("_root", F.coalesce("_root", "_e"))


def near_documents(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Words are what stands between white space, lower-cased in A-Z; a set holds the distinct
    shingles of five words, or the whole of fewer words. Two rows link at a Jaccard of
    percent/100 or more. component_id is the smallest id reachable by links. A null or blank
    text has no shingles and is alone. A null id orders last and is given back as null. Rows
    that repeat an id are judged by their texts, each for itself. Sets are told apart by
    64-bit hashes of their members' 64-bit hashes.
    """
    out = near_sets(docs, percent, key, text)
    low = out.filter(F.col("_root").isNotNull()).groupBy("_root").agg(F.min("_doc").alias("_low"))
    out = out.join(low, "_root", "left")
    return out.select(order_key(F.col("_doc")).alias(key), F.col("_n").alias("n_shingles"), order_key(F.coalesce("_low", "_doc")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each linked component: that of the smallest id, then of the
    smallest text hash; of rows that repeat id and text any one. Rows without words all stay."""
    own = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))
    every = cut(near_sets(own, percent, "_k", "_t"))
    best = every.filter(F.col("_root").isNotNull()).groupBy("_root").agg(F.min(F.struct("_doc", "_h")).alias("m"))
    keep = best.select("m.*", F.lit(True).alias("_set")).unionByName(every.filter(F.col("_root").isNull()).select("_doc", "_h", F.lit(False).alias("_set")).distinct())
    many = every.filter(F.col("_root").isNotNull()).groupBy("_doc", "_h").agg(F.count("*").alias("_c")).filter("_c > 1")
    keep = cut(keep.join(many, ["_doc", "_h"], "left").select(F.col("_doc").alias("_kd"), F.col("_h").alias("_kh"), (F.col("_set") & F.col("_c").isNotNull()).alias("_again")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    base = docs.select(row, last_id(key).alias("_kd"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("_kh"))
    plain = lambda df: df.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    out = plain(base.join(keep.filter("not _again"), ["_kd", "_kh"], "left_semi"))
    again = keep.filter("_again")
    return out if again.isEmpty() else out.unionByName(plain(base.join(again, ["_kd", "_kh"], "left_semi").dropDuplicates(["_kd", "_kh"])))
