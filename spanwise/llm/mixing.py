"""Mix sources to target weights: rake token weights to several marginals, then sample documents.

Only DataFrame functions: documents are aggregated to cells (one per combination of the
marginals' values), the cells are raked, and each document is kept with its cell's
calibrated probability.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import cut, free_name

#: Tables of cells and marginals of up to this many counted rows are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000
BLANK = "[ \\t\\n\\r]+"


def words_of(text: str) -> Column:
    """Parts between blanks, tabs and line ends; none for a null text."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), lambda w: w != "")


def word_count(text: str = "text") -> Column:
    return F.size(words_of(text)).cast("long")


def topic_of(text: str = "text") -> Column:
    """A topic for tables without one: hash class of the headword, which is the longest word
    (the last by bytes of equals). ``-`` for a text without words."""
    head = F.array_max(F.transform(words_of(text), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.coalesce(F.substring(F.md5(head), 1, 1), F.lit("-"))


def value_key(column: Column) -> Column:
    """A marginal's value as text; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def cells_of(rows: DataFrame, margins: Sequence[str], tokens: str) -> DataFrame:
    return rows.groupBy(*margins).agg(F.sum(tokens).cast("double").alias("_t"), F.count("*").alias("_docs"))


def targets(cells: DataFrame, margin: str, given: Mapping[str | None, float] | None, temper: float) -> DataFrame:
    """(margin, _share): given shares, and for values not given their part of the rest; without
    any given, observed token shares to the power ``temper``, made to sum to one."""
    seen = cells.groupBy(margin).agg(F.sum("_t").alias("_o"))
    if given is None:
        raw = F.when(F.col("_o") > 0, F.pow("_o", F.lit(temper))).otherwise(0.0)
        seen = seen.withColumn("_raw", raw)
    else:
        keys = {"" if k is None else f"={k}": float(v) for k, v in given.items()}
        named = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]) if keys else F.create_map().cast("map<string,double>")
        rest = max(0.0, 1.0 - sum(keys.values()))
        others = seen.filter(~F.col(margin).isin(list(keys))).agg(F.sum("_o")).first()[0] or 0.0
        seen = seen.withColumn("_raw", F.coalesce(named[F.col(margin)], F.col("_o") * (rest / others if others else 0.0)))
    total = seen.agg(F.sum("_raw")).first()[0] or 1.0
    return seen.select(margin, (F.col("_raw") / total).alias("_share"))


def bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few, otherwise as it is (then the join shuffles)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def rake(cells: DataFrame, margins: Sequence[str], shares: Mapping[str, DataFrame], cycles: int = 60, tolerance: float = 1e-11) -> DataFrame:
    """Iterative proportional fitting: ``_w`` per cell so that sums of _w x _t meet every marginal.

    A cycle fits each marginal in turn by one grouped sum that is joined back, and is
    checkpointed. It ends when no factor moved by more than ``tolerance``, or after ``cycles``
    (marginals that no weights can meet, for want of cells, are then met as nearly as the last
    cycle got).
    """
    few = {m: shares[m].count() <= BROADCAST_ROWS for m in margins}
    now = cells.withColumn("_w", F.lit(1.0))
    for m in margins:
        now = now.join(F.broadcast(shares[m]) if few[m] else shares[m], m).withColumnRenamed("_share", f"_share{m}")
    now = cut(now)
    for _ in range(cycles):
        step = now.withColumn("_moved", F.lit(0.0))
        for m in margins:
            sums = step.groupBy(m).agg(F.sum(F.col("_w") * F.col("_t")).alias("_s"))
            factor = F.when(F.col("_s") > 0, F.col(f"_share{m}") / F.col("_s")).otherwise(0.0)
            step = step.join(F.broadcast(sums) if few[m] else sums, m).withColumn("_f", factor)
            step = step.withColumn("_moved", F.greatest("_moved", F.when(F.col("_w") > 0, F.abs(F.col("_f") - 1)).otherwise(0.0)))
            step = step.withColumn("_w", F.col("_w") * F.col("_f")).drop("_f", "_s")
        step = cut(step)
        moved = step.agg(F.max("_moved")).first()[0]
        now = step.drop("_moved")
        if moved is None or moved <= tolerance:
            break
    return now


def tilted(cells: DataFrame, goal: float) -> float:
    """c such that tokens x min(1, c x _w) sum to ``goal``.

    Cells that reach 1 are taken out of the equation until none is new; each turn is one
    aggregate to one row.
    """
    t, w = F.col("_t"), F.col("_w")
    c = None
    while True:
        full = F.lit(False) if c is None else w * c >= 1
        got = cells.agg(F.sum(F.when(full, t)).alias("a"), F.sum(F.when(~full, w * t)).alias("b")).first()
        left = goal - (got["a"] or 0.0)
        new = left / got["b"] if got["b"] and left > 0 else (c or 0.0)
        if c is not None and new <= c * (1 + 1e-12):
            return new if new > c else c
        c = new


def goals(cells: DataFrame, margin: str, shares: DataFrame, given: Mapping[str | None, float] | None, keep: float) -> DataFrame:
    """(margin, _goal): tokens expected of each value, in all ``keep`` of all tokens.

    Given shares must be within the value's own tokens, or this raises. Tempered ones are at most
    all of the value's tokens; what these cannot take goes to the others in proportion.
    """
    seen = cells.groupBy(margin).agg(F.sum("_t").alias("_o")).join(shares, margin)
    total = seen.agg(F.sum("_o")).first()[0] or 0.0
    want = F.col("_share") * keep * total
    if given is not None:
        over = seen.filter(want > F.col("_o") * (1 + 1e-9)).orderBy(F.desc(F.try_divide(want, F.col("_o")))).first()
        if over is not None:
            raise ValueError(f"a sample of {keep} of all tokens with these shares needs more tokens of {over[margin][1:] or None!r} than there are ({over['_o']:.0f})")
        return seen.select(margin, want.alias("_goal"))
    tilt = F.coalesce(F.try_divide(F.col("_share"), F.col("_o")), F.lit(0.0))
    c = tilted(seen.select(F.col("_o").alias("_t"), tilt.alias("_w")), keep * total)
    return seen.select(margin, F.least(F.col("_o"), F.col("_o") * tilt * c).alias("_goal"))


def calibrate(cells: DataFrame, margins: Sequence[str], aims: Mapping[str, DataFrame], keep: float, cycles: int = 100, tolerance: float = 1e-10) -> tuple[DataFrame, float]:
    """Probabilities ``_p`` = min(1, ``_w`` x one factor a marginal) whose expected tokens meet every goal.

    A cycle fits each marginal in turn: the factor of a value is the one with which its cells'
    tokens x min(1, weight x factor) sum to its goal. With a value's cells by falling weight it is
    (goal - tokens of the cells before) / (weighted tokens from here on), the largest of these that
    leaves its own cell at 1 or below. So a cell that is full is fixed at 1 and the others are raked
    to what is left. Up to BROADCAST_ROWS counted cells are raked without shuffles, more are
    dealt by each marginal in turn. Each cycle is checkpointed; it ends when no probability moved by more
    than ``tolerance``, or after ``cycles``. Also returned: the largest miss of a goal, relative to it.
    """
    t, w = F.col("_t"), F.col("_q")
    total = cells.agg(F.sum("_t")).first()[0] or 0.0
    now = cells.withColumn("_q", F.col("_w") * float(keep * total))
    for m in margins:
        now = now.join(bounded(aims[m]), m).withColumnRenamed("_goal", f"_goal{m}")
    now = cut(now)
    if now.count() <= BROADCAST_ROWS:
        now = cut(now.coalesce(1))
    for _ in range(cycles):
        step = now.withColumn("_old", F.least(F.lit(1.0), w))
        for m in margins:
            order = Window.partitionBy(m).orderBy(w.desc(), *margins)
            step = step.withColumn("_before", F.coalesce(F.sum(t).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            step = step.withColumn("_rest", F.sum(w * t).over(order.rowsBetween(0, Window.unboundedFollowing)))
            goal = F.col(f"_goal{m}")
            one = F.when(goal > F.col("_before"), F.try_divide(goal - F.col("_before"), F.col("_rest")))
            step = step.withColumn("_f1", F.when(one * w <= 1 + 1e-12, one)).withColumn("_f2", F.try_divide(F.lit(1.0), w))
            value = Window.partitionBy(m)
            factor = F.when(goal > 0, F.coalesce(F.max("_f1").over(value), F.max("_f2").over(value))).otherwise(0.0)
            step = step.withColumn("_f", factor).withColumn("_q", F.coalesce(w * F.col("_f"), F.lit(0.0))).drop("_f", "_f1", "_f2", "_before", "_rest")
        step = cut(step)
        moved = step.agg(F.max(F.abs(F.least(F.lit(1.0), w) - F.col("_old")))).first()[0]
        now = step.drop("_old")
        if moved is None or moved <= tolerance:
            break
    out = now.withColumn("_p", F.least(F.lit(1.0), w))
    miss = [out.groupBy(m).agg(F.try_divide(F.abs(F.sum(F.col("_p") * t) - F.max(f"_goal{m}")), F.max(f"_goal{m}")).alias("x")).agg(F.max("x")).first()[0] for m in margins]
    return out, max([x for x in miss if x is not None], default=0.0)


def draw(key: str, text: str, seed: int) -> Column:
    """Uniform number of a document: a hash of its id (of its text where the id is null)."""
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(
    docs: DataFrame,
    keep: float = 0.5,
    temper: float = 0.5,
    given: Mapping[str, Mapping[str | None, float]] | None = None,
    margins: Mapping[str, Column] | None = None,
    tokens: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 17,
    into: str = "_mix",
    allowed: float = 0.001,
) -> DataFrame:
    """``docs`` with a column ``into``: struct(topic and other marginals' keys, tokens, weight, probability, sampled, miss).

    Weights are raked to the shares; probabilities are calibrated under the bound of 1, so that
    expected tokens (tokens x probability) meet every marginal's goal. Goals that are each
    possible but not together are met as nearly as raking gets; ``miss`` is the largest relative
    miss in the whole table. Where shares are given, a miss of over ``allowed`` raises.

    ``margins`` names the marginals (default: source, lang, and topic_of the text); ``given``
    holds target shares for some of them, the others are tempered. ``keep`` is the share of
    tokens expected to be sampled. A null value is a category; a text that is null, empty or
    blank has no tokens and is sampled like others of its cell, with probability 0 where the
    whole cell has none. Rows that repeat an id share its draw. Other columns are untouched.
    """
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(text)}
    tokens = word_count(text) if tokens is None else tokens
    names = [f"_m{k}" for k in range(len(margins))]
    keyed = {n: value_key(c) for n, c in zip(names, margins.values(), strict=True)}
    cells = cut(cells_of(docs.select(*[c.alias(n) for n, c in keyed.items()], tokens.alias("_n")), names, "_n"))
    shares = {n: targets(cells, n, (given or {}).get(m), temper) for n, m in zip(names, margins, strict=True)}
    shares = {n: cut(s) for n, s in shares.items()}
    aims = {n: cut(goals(cells, n, shares[n], (given or {}).get(m), keep)) for n, m in zip(names, margins, strict=True)}
    done, miss = calibrate(rake(cells, names, shares).select(*names, "_t", "_w"), names, aims, keep)
    if given and miss > allowed:
        raise ValueError(f"no sample of {keep} of all tokens meets the given shares together: the largest miss is {miss:.3g} of its goal")
    done = cut(done.select(*names, "_w", "_p"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    wide = docs.select(own, *[c.alias(n) for n, c in keyed.items()], tokens.alias("_tokens"), draw(key, text, seed).alias("_draw"))
    out = wide.join(bounded(done), names)
    parts = [F.when(F.col(n) != "", F.substring(F.col(n), F.lit(2), F.length(n))).alias(m) for n, m in zip(names, margins, strict=True)]
    extra = F.struct(*parts, F.col("_tokens").alias("tokens"), F.col("_w").alias("weight"), F.col("_p").alias("probability"), (F.col("_draw") < F.col("_p")).alias("sampled"), F.lit(float(miss)).alias("miss"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], extra.alias(into))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The documents that ``mix`` samples, with their own columns."""
    name = free_name(docs, "_mix")
    return mix(docs, into=name, **how).filter(f"{name}.sampled").drop(name)


def oracle(keep: float = 0.5, temper: float = 0.5, cycles: int = 40, seed: int = 17) -> str:
    """The same in DuckDB SQL with a fixed number of cycles of each raking."""
    sql = f"""WITH d AS (SELECT doc_id, source, lang, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws FROM documents),
h AS (SELECT doc_id, source, lang, len(ws) AS tokens, list_max(list_transform(ws, lambda w: lpad(CAST(length(w) AS VARCHAR), 9, '0') || w)) AS hw FROM d),
k AS (SELECT doc_id, coalesce('=' || source, '') AS m0, coalesce('=' || lang, '') AS m1, '=' || coalesce(substr(md5(substr(hw, 10)), 1, 1), '-') AS m2, tokens FROM h),
c0 AS (SELECT m0, m1, m2, CAST(sum(tokens) AS DOUBLE) AS t, CAST(1 AS DOUBLE) AS w FROM k GROUP BY ALL)"""
    for m in ("m0", "m1", "m2"):
        sql += f""",
s_{m} AS (SELECT {m}, r / sum(r) OVER () AS share FROM (SELECT {m}, CASE WHEN sum(t) > 0 THEN pow(sum(t), {temper}) ELSE 0 END AS r FROM c0 GROUP BY {m}))"""
    at = 0
    for _ in range(cycles):
        for m in ("m0", "m1", "m2"):
            sql += f""",
c{at + 1} AS MATERIALIZED (SELECT m0, m1, m2, t, CASE WHEN sum(w * t) OVER (PARTITION BY {m}) > 0 THEN w * share / sum(w * t) OVER (PARTITION BY {m}) ELSE 0 END AS w FROM c{at} JOIN s_{m} USING ({m}))"""
            at += 1
    fit = "(CASE WHEN r > 0 AND g > b AND (g - b) / r * q <= 1 + 1e-12 THEN (g - b) / r END)"
    rows = "PARTITION BY {m} ORDER BY q DESC, m0, m1, m2"
    sums = f"coalesce(sum(t) OVER ({rows} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(q * t) OVER ({rows} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r"
    for m in ("m0", "m1", "m2"):
        sql += f""",
o_{m} AS (SELECT 0 AS m, {m} AS m0, 0 AS m1, 0 AS m2, sum(t) AS t, CASE WHEN sum(t) > 0 THEN any_value(share) / sum(t) ELSE 0 END AS q, {keep} * sum(sum(t)) OVER () AS g FROM c0 JOIN s_{m} USING ({m}) GROUP BY {m}),
g_{m} AS (SELECT m0 AS {m}, least(t, t * q * max({fit}) OVER ()) AS g FROM (SELECT *, {sums.format(m='m')} FROM o_{m}))"""
    sql += f""",
q0 AS MATERIALIZED (SELECT *, w * (SELECT {keep} * sum(t) FROM c0) AS q FROM c{at})"""
    at = 0
    for _ in range(cycles):
        for m in ("m0", "m1", "m2"):
            sql += f""",
q{at + 1} AS MATERIALIZED (SELECT m0, m1, m2, t, w, coalesce(q * CASE WHEN g > 0 THEN coalesce(max({fit}) OVER (PARTITION BY {m}), max(CASE WHEN q > 0 THEN 1 / q END) OVER (PARTITION BY {m})) ELSE 0 END, 0) AS q
 FROM (SELECT *, {sums.format(m=m)} FROM q{at} JOIN g_{m} USING ({m})))"""
            at += 1
    return sql + f""",
p AS (SELECT m0, m1, m2, w, least(1.0, q) AS p FROM q{at})
SELECT doc_id, nullif(substr(m0, 2), '') AS source, nullif(substr(m1, 2), '') AS lang, substr(m2, 2) AS topic, tokens,
round(w * 1e6, 6) AS weight, round(p, 6) AS probability,
CAST('0x' || substr(md5('{seed}|' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS sampled
FROM k JOIN p USING (m0, m1, m2)"""
