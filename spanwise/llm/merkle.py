"""Hash-tree manifest of a table: a leaf a row, a tree a group, a tree over the groups, proofs for all.

Rows are dealt into aligned blocks of fanout^depth leaves, each hashed by one task. A block hashes its
own subtree. The levels above are a butterfly: in round r a block asks, in each of the up to ``fanout``
neighbouring runs of fanout^r blocks, the block that has its own place there (the last run may
be short; its blocks then answer for several places), and hashes the common ancestor from the
answers. After the last round every block holds the root and the siblings on its way to it, so no
second pass goes down the tree. A round moves fanout digests a block; it is one join and one
grouped list of at most ``fanout`` entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import cut, partitions
from spanwise.operators.ordered import Seq, range_buckets, scan

FANOUT = 8
STEP = "struct<before:string,after:string>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]).cast("binary"), 256)


def combined(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to: at each step the siblings stand around the digest."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one string."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def subtree(leaves: list[str], levels: int) -> list[list[str]]:
    """Digests of a run of leaves, level by level, up to ``levels`` above."""
    out = [leaves]
    for _ in range(levels):
        low = out[-1]
        out.append([combined(low[i : i + FANOUT]) for i in range(0, len(low), FANOUT)])
    return out


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while FANOUT**levels < n:
        levels += 1
    return levels


def around(level: list[str], at: int) -> tuple[str, str]:
    """What stands before and after a node in its run."""
    lo = at // FANOUT * FANOUT
    return "".join(level[lo:at]), "".join(level[at + 1 : lo + FANOUT])


def butterfly(nodes: DataFrame, trees: Sequence[str]) -> DataFrame:
    """``trees`` columns, place, root and proof (steps from the node to the root) for every node.

    ``nodes`` has the trees, place (dense from 0), n (nodes of the tree) and digest.
    """
    trees = list(trees)
    state = cut(nodes.select(*trees, "place", "n", "digest", F.array().cast(f"array<{STEP}>").alias("proof")))
    rounds = height(state.agg(F.max("n")).first()[0] or 0)
    for r in range(rounds):
        run = FANOUT**r
        digit = (F.floor(F.col("place") / run) % FANOUT).cast("int")
        first = F.floor(F.col("place") / (run * FANOUT)) * run * FANOUT  # of the group of runs
        begin = (first + F.col("j") * run).cast("long")
        size = F.least(F.lit(run), F.col("n") - begin)
        asked = state.filter(F.col("n") > run).select(*trees, "place", "n", F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1))).alias("j"))
        asked = asked.filter(begin < F.col("n")).select(*trees, F.col("place").alias("asker"), "j", (begin + F.col("place") % run % size).cast("long").alias("place"))
        told = asked.join(state.select(*trees, "place", "digest"), [*trees, "place"])
        told = told.groupBy(*trees, F.col("asker").alias("place")).agg(F.array_sort(F.collect_list(F.struct("j", "digest"))).alias("_run"))
        joined = lambda keep: F.array_join(F.transform(F.filter("_run", keep), lambda x: x["digest"]), "")
        step = F.struct(joined(lambda x: x["j"] < digit).alias("before"), joined(lambda x: x["j"] > digit).alias("after"))
        up = F.sha2(joined(lambda x: F.lit(True)).cast("binary"), 256)
        live = F.col("_run").isNotNull()
        state = cut(
            state.join(told, [*trees, "place"], "left").select(
                *trees, "place", "n",
                F.when(live, up).otherwise(F.col("digest")).alias("digest"),
                F.when(live, F.array_append("proof", step)).otherwise(F.col("proof")).alias("proof"),
            )
        )
    return state.select(*trees, "place", F.col("digest").alias("root"), "proof")


def placed(rows: DataFrame, trees: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with place and n: dense number in its tree by ``order``, and rows of the tree.

    Rows are cut at sampled points of (trees, order), so one large tree is spread over many tasks.
    """
    several, seq = range_buckets(rows, Seq(tuple(trees), tuple(order), 1.0), partitions(rows.sparkSession))
    return scan(several, seq, index="place", total="n").drop(seq.bucket)


def manifest(docs: DataFrame, fields: Sequence[str], key: str = "doc_id", by: str = "lang", carry: Sequence[str] = (), depth: int = 4) -> DataFrame:
    """One row per row of ``docs``: key, ``carry`` columns, leaf, subroot, root and proof.

    A leaf is the hash of ``fields``. Leaves of each ``by`` ascend by ``key``; runs of FANOUT
    nodes become their hash until one is left, the subroot; subroots ascend by ``by`` (null
    first, bytewise) and become the root the same way. ``proof`` lists, from the leaf to the root,
    the digests before and after the node in its run (empty where it is alone).

    A null key comes first, a null ``by`` is a group of its own, null fields count as ``-``.
    Rows that share a key are ordered by leaf; rows that share both are equal and may change
    places. Empty and long texts are hashed like any other; only hashes travel, no texts. ``docs``
    may have any other columns. No rows in, no rows out. The columns named in ``carry`` may
    not be called leaf, subroot, root or proof.
    """
    if clash := {c.lower() for c in (key, *carry)} & {"leaf", "subroot", "root", "proof"}:
        raise ValueError(f"columns have names of the result: {sorted(clash)}")
    extra = F.struct(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    leaf = leaf_hash([F.col(f"`{c}`") for c in fields])
    # null keys sort first as (0, 0); a null group as (false, '')
    rank = F.struct(F.col(f"`{key}`").isNotNull().cast("int").alias("some"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("id"))
    rows = docs.select(F.coalesce(F.concat(F.lit("+"), F.col(f"`{by}`").cast("string")), F.lit("")).alias("_tree"), rank.alias("_key"), leaf.alias("leaf"), extra.alias("_extra"))
    width = FANOUT**depth
    rows = placed(cut(rows), ["_tree"], ["_key", "leaf"])
    rows = cut(rows.select("_tree", "place", "n", "leaf", "_extra", F.floor(F.col("place") / width).cast("long").alias("_block")))

    def tops(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        n = t.column("n")[0].as_py()
        digest = subtree(t.column("leaf").to_pylist(), min(depth, height(n)))[-1][0]
        return pa.table({"_tree": t.column("_tree")[:1], "place": t.column("_block")[:1], "n": pa.array([-(-n // width)]), "digest": pa.array([digest])})

    blocks = rows.select("_tree", "_block", "place", "n", "leaf").groupBy("_tree", "_block").applyInArrow(tops, "_tree string, place long, n long, digest string")
    blocks = butterfly(blocks, ["_tree"]).withColumnRenamed("root", "subroot").withColumnRenamed("place", "_block")
    trees = blocks.filter("_block = 0").select(F.lit(0).alias("_forest"), "_tree", F.col("subroot").alias("digest"))
    trees = cut(placed(trees, ["_forest"], ["_tree"]))
    over = butterfly(trees, ["_forest"]).join(trees.select("_forest", "place", "_tree"), ["_forest", "place"])
    over = over.select("_tree", "root", F.col("proof").alias("_over"))
    above = blocks.join(over, "_tree").select("_tree", "_block", "subroot", "root", F.concat("proof", "_over").alias("_above"))

    def proofs(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        leaves = t.column("leaf").to_pylist()
        levels = subtree(leaves, min(depth, height(t.column("n")[0].as_py())))
        upper = [(s["before"], s["after"]) for s in up.column("_above")[0].as_py()]
        steps, starts = [], [0]
        for at in range(len(leaves)):
            for level in levels[:-1]:
                steps.append(around(level, at))
                at //= FANOUT
            steps.extend(upper)
            starts.append(len(steps))
        before, after = zip(*steps, strict=True) if steps else ((), ())
        items = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        same = lambda c: pa.array([up.column(c)[0].as_py()] * len(leaves), pa.string())
        return pa.table({"_extra": t.column("_extra"), "leaf": t.column("leaf"), "subroot": same("subroot"), "root": same("root"), "proof": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), items)})

    shape = f"_extra {dict(rows.dtypes)['_extra']}, leaf string, subroot string, root string, proof array<{STEP}>"
    out = rows.groupBy("_tree", "_block").cogroup(above.groupBy("_tree", "_block")).applyInArrow(proofs, shape)
    return out.select(F.col("_extra.key").alias(key), *[F.col(f"_extra.c{i}").alias(c) for i, c in enumerate(carry)], "leaf", "subroot", "root", "proof")


__all__ = ["folded", "leaf_hash", "manifest", "siblings"]
