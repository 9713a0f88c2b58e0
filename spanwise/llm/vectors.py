"""Vectors: validity, near duplicates by PCA-ordered tiles, nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import LAST, components, cut, last_id, order_key, partitions

#: Rows of a tile, and rows compared at one time.
TILE, STRIP = 4096, 1024
#: Tiles a task holds of the second side, and pairs of tiles that go to Python at one time.
HELD, AT_ONCE = 8, 4
#: Counts and links a task gathers before it folds them.
FOLD = 1_000_000
#: Dimensions accumulated before the bound is looked at again.
STEPS = (12, 24, 40)


def usable(vector: str, dim: int) -> Column:
    """A vector of the table's dimension with finite components that are not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) == dim) & ~bad & some, F.lit(False))


def dimension(rows: DataFrame, vector: str) -> int:
    """The commonest length (the larger of equals); 0 for an empty table."""
    got = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).filter("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return got["d"] if got else 0


def matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    """Rows of packed little-endian doubles."""
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(-1, dim)


def packed(vector: str, dim: int, name: str) -> tuple[Callable, str]:
    """Arrow function that turns (id, vector, ...) into the same with the vector as packed doubles."""

    def pack(batches):
        for b in batches:
            flat = np.ascontiguousarray(b.column(vector).flatten().to_numpy(zero_copy_only=False), dtype="<f8")
            rows = flat.reshape(-1, dim)
            at = b.schema.get_field_index(vector)
            yield b.set_column(at, name, pa.array([r.tobytes() for r in rows], pa.binary()))

    return pack, name


# ---- near duplicates ---------------------------------------------------------------------


def second_moments(units: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products of unit vectors; dim^2 numbers come to the driver, whatever the input."""

    def add(batches):
        m = np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column("_v").to_pylist(), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            m += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(m.ravel())], names=["at", "v"])

    got = units.select("_v").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros(dim * dim)
    m[got["at"].to_numpy(dtype=np.int64)] = got["v"]
    return m.reshape(dim, dim)


def links(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, same: bool):
    """Index pairs (i, j) with cosine of at least ``threshold``; of i < j only when both sides are the same.

    a and b are unit vectors in the order of falling variance. Leading dimensions are
    accumulated first; a pair goes on only while its sum so far plus the product of the two
    suffix norms can still reach the threshold. Cosines within 1e-9 of it are taken from the
    vectors as given.
    """
    dim = a.shape[1]
    cuts = [c for c in STEPS if c < dim]
    rest = lambda x: [np.sqrt(np.maximum((x[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    rest_a, rest_b = rest(a), rest(b)
    out_i, out_j = [], []
    for lo in range(0, len(a), STRIP):
        hi = min(lo + STRIP, len(a))
        for left in range(lo if same else 0, len(b), STRIP):
            right = min(left + STRIP, len(b))
            first = cuts[0] if cuts else dim
            s = a[lo:hi, :first] @ b[left:right, :first].T
            if cuts:
                i, j = np.nonzero(s + np.outer(rest_a[0][lo:hi], rest_b[0][left:right]) >= threshold - 1e-9)
            else:
                i, j = np.nonzero(s >= threshold - 1e-9)
            if same:
                keep = i + lo < j + left
                i, j = i[keep], j[keep]
            v = s[i, j]
            i, j = i + lo, j + left
            for k, c in enumerate(cuts):
                end = cuts[k + 1] if k + 1 < len(cuts) else dim
                v = v + np.einsum("nd,nd->n", a[i, c:end], b[j, c:end])
                bound = v + rest_a[k + 1][i] * rest_b[k + 1][j] if k + 1 < len(cuts) else v
                keep = bound >= threshold - 1e-9
                i, j, v = i[keep], j[keep], v[keep]
            near = np.abs(v - threshold) <= 1e-9
            if near.any():
                x, y = raw_a[i[near]], raw_b[j[near]]
                v[near] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            keep = v >= threshold
            out_i.append(i[keep])
            out_j.append(j[keep])
    return np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])


def forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of pairs that join two parts not joined before: a spanning forest, at most one pair a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return out


TILED = "tile long, n int, lo array<double>, hi array<double>, ids binary, weights binary, vectors binary"


def near_vectors(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", box: int = 8) -> DataFrame:
    """One row per row of ``rows``: id, n_links, component_id, kept.

    Equal vectors are first counted as one, so a very common vector is one row of the search.
    Vectors in PCA order of dimensions are cut into tiles along the leading one; two tiles
    are compared only if the boxes around their leading ``box`` dimensions come near enough
    for the threshold. A comparison gives a link count per vector and a spanning forest of
    its links, never the links themselves.

    Null, zero and non-finite vectors, and those of another length than most, have no links
    and are their own component. Repeated rows link with each other. A null id orders last
    and is given back as null, kept. An empty table gives no row.
    """
    spark = rows.sparkSession
    dim = dimension(rows, vector)
    base = rows.select(last_id(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    ok = usable("_v", dim)
    base = base.withColumn("_h", F.when(ok, F.xxhash64(F.lit(1), "_v"))).withColumn("_g", F.when(ok, F.xxhash64(F.lit(2), "_v")))
    if dim == 0:
        base = base.filter(F.lit(False))
    grouped = base.filter(F.col("_h").isNotNull()).groupBy("_h", "_g").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"), F.first("_v").alias("_v"))
    pack, _ = packed("_v", dim, "_v")
    reps = cut(grouped.mapInArrow(pack, "_h long, _g long, _rep long, _n long, _v binary"))
    found = None
    if dim and not reps.isEmpty():
        axes = np.linalg.eigh(second_moments(reps, dim))[1][:, ::-1].copy()
        found = _tiled(reps, axes, threshold, dim, box)
    slim = base.select("_id", "_h", "_g").join(reps.select("_h", "_g", "_rep", "_n"), ["_h", "_g"], "left")
    if found is not None:
        count = found.filter("_b is null").groupBy(F.col("_a").alias("_rep")).agg(F.sum("_c").alias("_c"))
        root = components(found.filter("_b is not null").select(F.col("_a").alias("a"), F.col("_b").alias("b"))).withColumnRenamed("node", "_rep")
        per = count.join(root, "_rep", "left")
        slim = slim.join(per, "_rep", "left")
    else:
        slim = slim.withColumns({"_c": F.lit(0), "root": F.lit(None).cast("long")})
    comp = F.coalesce("root", "_rep", "_id")
    return slim.select(
        order_key(F.col("_id")).alias(id_col),
        (F.coalesce("_c", F.lit(0)) + F.coalesce(F.col("_n") - 1, F.lit(0))).cast("long").alias("n_links"),
        order_key(comp).alias("component_id"),
        (F.col("_id") == comp).alias("kept"),
    )


def _tiled(reps: DataFrame, axes: np.ndarray, threshold: float, dim: int, box: int) -> DataFrame:
    """(_a, _b null, _c links) and (_a, _b, null) for the forest, over all tile pairs that can hold a link."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(axes)
    lead = min(box, dim)

    def first(batches):
        axis = shared.value[:, :1]
        for b in batches:
            x = matrix(b.column("_v").to_pylist(), dim)
            yield b.append_column("_c1", pa.array(((x @ axis)[:, 0]) / np.linalg.norm(x, axis=1)))

    ordered = reps.select("_rep", "_n", "_v").mapInArrow(first, "_rep long, _n long, _v binary, _c1 double")
    n = max(partitions(spark), 1)

    def tile(batches):
        part = None
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table, k: int) -> pa.RecordBatch:
            x = matrix(t.column("_v").to_pylist(), dim)
            y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value[:, :lead]
            rows = [(part << 32) + k], [len(x)], [y.min(axis=0).tolist()], [y.max(axis=0).tolist()]
            ids, weights = (t.column(c).to_numpy().astype("<i8").tobytes() for c in ("_rep", "_n"))
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2]), pa.array(rows[3]), pa.array([ids], pa.binary()), pa.array([weights], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                names=["tile", "n", "lo", "hi", "ids", "weights", "vectors"],
            )

        k = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            part = b.column("_part")[0].as_py()
            held.append(b)
            t = pa.Table.from_batches(held)
            while t.num_rows >= TILE:
                yield emit(t.slice(0, TILE), k)
                t, k = t.slice(TILE), k + 1
            held = t.combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield emit(pa.Table.from_batches(held), k)

    total = reps.count()
    ranges = max(1, min(4 * n, ceil(total / TILE))) if total < 4 * n * TILE else ceil(total / (4 * TILE))
    tiles = cut(ordered.repartitionByRange(ranges, "_c1").withColumn("_part", F.spark_partition_id().cast("long")).mapInArrow(tile, TILED))
    reach = 2 - 2 * threshold  # squared distance of unit vectors
    # parts of tiles meet where they are read: a shuffle would write every tile once for each of its pairs
    parts = tiles.rdd.getNumPartitions()
    parts = min(parts, max(ceil(parts / HELD), ceil(2 * float(np.sqrt(n)))))
    a, b = (tiles.coalesce(parts).select(*[F.col(c).alias(f"{s}_{c}") for c in ("tile", "lo", "hi", "ids", "weights", "vectors")]) for s in ("a", "b"))
    gap = sum((F.greatest(F.lit(0.0), F.col("a_lo")[k] - F.col("b_hi")[k], F.col("b_lo")[k] - F.col("a_hi")[k]) ** 2 for k in range(lead)), F.lit(0.0))
    pairs = a.join(b.hint("shuffle_replicate_nl"), (F.col("a_tile") <= F.col("b_tile")) & (gap <= reach + 1e-9)).drop("a_lo", "a_hi", "b_lo", "b_hi")

    def met(ids, weights, raw) -> tuple[np.ndarray, ...]:
        """Link counts (id, count) and a spanning forest (id, id) of one tile, or of two."""
        units = [(x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value for x in raw]
        same = len(raw) == 1
        i, j = links(units[0], units[-1], raw[0], raw[-1], threshold, same)
        ca = np.bincount(i, weights=weights[-1][j], minlength=len(ids[0]))
        cb = np.bincount(j, weights=weights[0][i], minlength=len(ids[-1]))
        if same:
            ca, cb = ca + cb, np.zeros(0)
        ia, ib = np.flatnonzero(ca), np.flatnonzero(cb)
        edge = np.array(forest(i, j if same else j + len(ids[0])), dtype=int)
        return np.concatenate([ids[0][ia], ids[-1][ib]]), np.concatenate([ca[ia], cb[ib]]).astype(np.int64), ids[0][i[edge]], ids[-1][j[edge]]

    def folded(got: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        who, count, one, two = (np.concatenate(c) for c in zip(*got, strict=True))
        who, at = np.unique(who, return_inverse=True)
        total = np.zeros(len(who), np.int64)
        np.add.at(total, at, count)
        edge = np.array(forest(one, two), dtype=int)
        return who, total, one[edge], two[edge]

    def compare(batches):
        got, size = [], 0
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in batch.schema.names}
            for k in range(batch.num_rows):
                some = "a" if c["a_tile"][k] == c["b_tile"][k] else "ab"
                ids, weights = ([np.frombuffer(c[f"{s}_{name}"][k], "<i8") for s in some] for name in ("ids", "weights"))
                got.append(met(ids, weights, [np.frombuffer(c[f"{s}_vectors"][k], "<f8").reshape(-1, dim) for s in some]))
                size += len(got[-1][0]) + len(got[-1][2])
                if size > FOLD:
                    got, size = [folded(got)], 0
        if got:
            who, count, one, two = folded(got)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([who, one]), pa.int64()),
                    pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(two, pa.int64())]),
                    pa.concat_arrays([pa.array(count, pa.int64()), pa.nulls(len(two), pa.int64())]),
                ],
                names=["_a", "_b", "_c"],
            )

    # a row is two whole tiles
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(AT_ONCE))
    try:
        return cut(pairs.mapInArrow(compare, "_a long, _b long, _c long"))
    finally:
        spark.conf.set(name, was)


# ---- nearest neighbours ------------------------------------------------------------------


class CrossPolytope:
    """Pseudo-rotations (sign flips and Hadamard transforms, three times) and the nearest signed axis."""

    def __init__(self, dim: int, tables: int, seed: int = 7) -> None:
        self.dim, self.size = dim, 1 << max(0, ceil(log2(max(dim, 1))))
        self.flips = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, self.size))

    def rotate(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : self.dim] = x
        for flip in self.flips[table]:
            y *= flip
            h = 1
            while h < self.size:
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), self.size)
                h *= 2
        return y

    def axes(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` nearest signed axes of each row, nearest first; axis k and its opposite are 2k and 2k + 1."""
        y = self.rotate(x, table)
        signed = np.stack([y, -y], axis=2).reshape(len(y), -1)
        return np.argsort(-signed, axis=1, kind="stable")[:, :probes]


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, tables: int = 2, probes: int = 56, id_col: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """The ``k`` rows of largest cosine found for each query: query_id, rank, vec_id, score.

    Every row is put into one bucket of each table, a query looks into ``probes`` buckets of
    each. Buckets of more than ``block`` rows are dealt into salted parts, and a query visits
    every part, so no task holds a whole bucket. Parts are scored as matrix products, the
    best k of each part are scored again row by row, and only these leave the part. A query
    that found fewer than k looks into every bucket of the first table, which is all rows.

    Vectors that are null, zero, non-finite or of another length than most, and rows without
    id, take no part. Rows that repeat an id count once, by their largest cosine, and are no
    neighbour of a query of the same id. Ties go to the smaller id.
    """
    spark = rows.sparkSession
    dim = dimension(rows, vector)
    lsh = CrossPolytope(dim, tables)
    pack, _ = packed("_v", dim, "_v")

    def prepare(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
        out = out.filter(F.col("_id").isNotNull() & usable("_v", dim)) if dim else out.filter(F.lit(False))
        return out.mapInArrow(pack, "_id long, _v binary")

    def into(df: DataFrame, probes: int, last: int) -> DataFrame:
        def assign(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column("_v").to_pylist(), dim)
                for t in range(last):
                    at = lsh.axes(x, t, probes)
                    own = np.repeat(np.arange(len(x)), at.shape[1])
                    ids, v = b.column("_id").take(pa.array(own)), b.column("_v").take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([ids, v, pa.array((at + t * 2 * lsh.size).ravel())], names=["_id", "_v", "_bucket"])

        return df.mapInArrow(assign, "_id long, _v binary, _bucket long")

    index = cut(into(prepare(rows), 1, tables))
    parts = index.groupBy("_bucket").agg(F.ceil(F.count("*") / block).cast("long").alias("_parts"))
    # At most tables x 2 x dim buckets: fixed by the parameters, so the counts may be broadcast.
    parts = F.broadcast(parts)
    index = index.join(parts, "_bucket").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    index = index.select("_bucket", "_salt", F.lit(False).alias("_q"), "_id", "_v")
    asked = cut(prepare(queries))

    def search(df: DataFrame, probes: int, last: int) -> DataFrame:
        visits = into(df, probes, last).join(parts, "_bucket").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        visits = visits.select("_bucket", "_salt", F.lit(True).alias("_q"), "_id", "_v")

        def score(key, t):
            is_query = t.column("_q").to_numpy(zero_copy_only=False).astype(bool)
            ids, x = t.column("_id").to_numpy(), matrix(t.column("_v").to_pylist(), dim)
            qi, qx, ri, rx = ids[is_query], x[is_query], ids[~is_query], x[~is_query]
            out = _best(qi, qx, ri, rx, k)
            return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

        return index.unionByName(visits).groupBy("_bucket", "_salt").applyInArrow(score, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    out = cut(ranked(search(asked, probes, tables)))
    full = out.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = cut(asked.join(full, F.col("_id") == F.col("query_id"), "left_anti"))
    if not short.isEmpty():
        out = out.join(full, "query_id", "left_semi").unionByName(ranked(search(short, 2 * lsh.size, 1)))
    return out.select("query_id", "rank", "vec_id", "score")


def _best(qi: np.ndarray, qx: np.ndarray, ri: np.ndarray, rx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows for each query by score, then by id."""
    norm_r, norm_q = np.sqrt((rx * rx).sum(axis=1)), np.sqrt((qx * qx).sum(axis=1))
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(qi) if len(ri) else 0, 256):
        ids, q, nq = qi[lo : lo + 256], qx[lo : lo + 256], norm_q[lo : lo + 256]
        s = (q @ rx.T) / np.outer(nq, norm_r)
        s[ids[:, None] == ri[None, :]] = -np.inf
        floor = np.partition(s, len(ri) - k, axis=1)[:, len(ri) - k] - 1e-9 if len(ri) > k else np.full(len(ids), -2.0)
        for n in range(len(ids)):
            at = np.flatnonzero((s[n] >= floor[n]) & (s[n] > -2))
            exact = (rx[at] * q[n]).sum(axis=1) / (norm_r[at] * nq[n])
            order = np.lexsort((ri[at], -exact))
            # equal ids may stand in several rows; k different ids are enough
            first = np.sort(np.unique(ri[at][order], return_index=True)[1])[:k]
            at, exact = at[order][first], exact[order][first]
            got.append((np.full(len(at), ids[n]), ri[at], exact))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))
