"""Frame and event metrics, roll-ups and comparison tables.

All inputs are DataFrames of any size; results are small aggregates. Sums and counts
combine map-side, so a hot key costs no more than its partial rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.scalar import f_beta, namespace, rank_of, safe_div, temporal_iou
from spanwise.operators.intervals import dilated, greedy_match, label_outcome, overlap_join, sorted_greedy, touched_by


def prf(tp: Column, fp: Column, fn: Column, beta: float | None = None) -> list[Column]:
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    out = [p.alias("precision"), r.alias("recall"), safe_div(2.0 * p * r, p + r).alias("f1")]
    return out + ([f_beta(p, r, beta).alias("f2")] if beta else [])


def frame_confusion(truth: DataFrame, pred: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates over frames present on both sides; ``y_true`` / ``y_pred`` are 0 or 1."""
    j = truth.join(pred, list(keys))
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    a = j.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return a.select(*by, "tp", "fp", "fn", "tn", *prf(tp, fp, fn), safe_div(fp, fp + tn).alias("false_alarm_rate"))


def event_counts(refs: DataFrame, preds: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: tp, fp, fn, precision, recall, f1 and onset / offset delays."""
    keys = list(keys)
    m = matches.select(
        *keys,
        F.lit(0).alias("_r"), F.lit(0).alias("_p"), F.lit(1).alias("_m"),
        (F.col("pred_start") - F.col("ref_start")).alias("_on"), (F.col("pred_end") - F.col("ref_end")).alias("_off"),
    )
    none = F.lit(None).cast("double")
    r = refs.select(*keys, F.lit(1).alias("_r"), F.lit(0).alias("_p"), F.lit(0).alias("_m"), none.alias("_on"), none.alias("_off"))
    p = preds.select(*keys, F.lit(0).alias("_r"), F.lit(1).alias("_p"), F.lit(0).alias("_m"), none.alias("_on"), none.alias("_off"))
    a = m.unionByName(r).unionByName(p).groupBy(*keys).agg(
        F.sum("_m").alias("tp"), (F.sum("_p") - F.sum("_m")).alias("fp"), (F.sum("_r") - F.sum("_m")).alias("fn"),
        F.avg("_on").alias("mean_onset"), F.avg(F.abs("_on")).alias("mean_abs_onset"), F.avg("_off").alias("mean_offset"),
        F.sum("_on").alias("sum_onset"),
    )
    return a.select(*keys, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), "mean_onset", "mean_abs_onset", "mean_offset", "sum_onset")


def micro_macro(per_video: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro from pooled counts, macro as mean of per-video values."""
    a = per_video.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return a.select(
        *by, "tp", "fp", "fn", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"),
        "macro_precision", "macro_recall", "macro_f1",
    )


def rollup_metrics(per_video: DataFrame, method: str, video: str) -> DataFrame:
    """Per-video rows and the pooled row of each method in one pass (video null)."""
    a = per_video.rollup(method, video).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return a.filter(F.col(method).isNotNull()).select(method, video, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def leave_one_out(per_video: DataFrame, video: str, by: Sequence[str] = ()) -> DataFrame:
    """Pooled micro metrics without each video: totals minus own counts."""
    tot = per_video.groupBy(*by).agg(*[F.sum(c).alias(f"_{c}") for c in ("tp", "fp", "fn")])
    on = list(by) or ["_one"]
    one = (lambda d: d) if by else (lambda d: d.withColumn("_one", F.lit(1)))
    j = one(per_video).join(one(tot), on)
    tp, fp, fn = (F.col(f"_{c}") - F.col(c) for c in ("tp", "fp", "fn"))
    return j.select(*by, F.col(video).alias("excluded"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), *prf(tp, fp, fn))


def contribution_share(per_video: DataFrame, video: str) -> DataFrame:
    """Share of labels and of true positives per video."""
    tot = per_video.agg(F.sum(F.col("tp") + F.col("fn")).alias("_g"), F.sum("tp").alias("_t"))
    gt = F.col("tp") + F.col("fn")
    j = per_video.withColumn("_one", F.lit(1)).join(tot.withColumn("_one", F.lit(1)), "_one")
    return j.select(
        video, gt.alias("n_gt"), "tp", safe_div(gt, F.col("_g")).alias("share_gt"), safe_div(F.col("tp"), F.col("_t")).alias("share_tp")
    )


def sensitivity_grid(
    refs: DataFrame, preds: DataFrame, keys: Sequence[str], width: float, cells: Sequence[tuple[float, float]]
) -> DataFrame:
    """Pooled metrics for each (IoU, tolerance), by one matching of all cells.

    Pairs are found once, in the hull of all tolerances (starts are floored at 0, so the largest need not hold the others),
    and copied to the cells they reach where these are decided; cell and key then name the series.
    """
    cell = ["iou", "tolerance"]
    tolerances = sorted({t for _, t in cells})
    of = lambda f, ends: f(*ends) if len(ends) > 1 else ends[0]
    hull = lambda side: (of(F.least, [dilated(side, t)[0] for t in tolerances]), of(F.greatest, [dilated(side, t)[1] for t in tolerances]))
    pairs = overlap_join(refs.select(*keys, "ref_id", "ref_start", "ref_end"), preds.select(*keys, "pred_id", "pred_start", "pred_end"), keys, hull("ref"), hull("pred"), width)
    reached = {t: f"_v{n}" for n, t in enumerate(tolerances)}
    pairs = pairs.withColumns({name: temporal_iou(*dilated("ref", t), *dilated("pred", t)) for t, name in reached.items()})
    every = F.array(*[F.struct(F.lit(float(i)).alias("iou"), F.lit(float(t)).alias("tolerance"), F.col(reached[t]).alias("iou_d")) for i, t in cells])
    every = F.filter(every, lambda c: (c["iou_d"] > 0) & (c["iou_d"] >= c["iou"]))
    some = [(F.col(name) > 0) & (F.col(name) >= min(i for i, u in cells if u == t)) for t, name in reached.items()]
    m = sorted_greedy(pairs.filter(reduce(lambda x, y: x | y, some)), keys, [-F.col("iou_d"), F.col("ref_id"), F.col("pred_id")], cells=(cell, every))
    tp = m.groupBy(*cell).agg(F.count(F.lit(1)).alias("tp"))
    grid = F.array(*[F.struct(F.lit(float(i)).alias("iou"), F.lit(float(t)).alias("tolerance")) for i, t in cells])
    sizes = refs.select(F.lit(1).alias("_r"), F.lit(0).alias("_p")).unionByName(preds.select(F.lit(0).alias("_r"), F.lit(1).alias("_p")))
    sizes = sizes.agg(F.sum("_r").alias("_r"), F.sum("_p").alias("_p")).select("_r", "_p", F.inline(grid))
    tp_, r, p = (F.coalesce(c, F.lit(0)) for c in (F.col("tp"), F.col("_r"), F.col("_p")))
    out = sizes.join(tp, cell, "left").select(*cell, tp_.alias("tp"), (p - tp_).alias("fp"), (r - tp_).alias("fn"))
    return out.withColumn("micro_f1", safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def failure_pivot(failures: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per failure type, zero filled; the types are fixed so no scan is needed to find them."""
    kinds = ["delayed_onset", "early_onset", "false_negative", "false_positive", "fragmented_detection", "merged_distinct_events", "short_event_suppression"]
    return failures.groupBy(*by).pivot("failure_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


POSITIVE = ("submission_signal", "extreme_vulnerability")


def namespaced_outcomes(
    refs: DataFrame,
    preds: DataFrame,
    negatives: DataFrame,
    keys: Sequence[str],
    width: float,
    threshold: float = 0.3,
    tolerance: float = 0.0,
    mode: str = "exact",
    early: float = 0.05,
) -> DataFrame:
    """One row per outcome: ``outcome`` (tp, mismatch, missed, extra), labels, onset and error category.

    Matching ignores labels; a match with incompatible labels counts as one false
    positive and one false negative. Extra predictions that overlap a scramble (first)
    or hand-posting interval of ``negatives`` (``neg_label``) are tagged.
    """
    keys = list(keys)
    m = greedy_match(refs, preds, keys, width, threshold, tolerance)
    # a side is read once for its matched and its left-over rows: references take their matches, predictions take these
    m = m.filter("ref_id is not null and pred_id is not null").select(*keys, "ref_id", "pred_id", F.col("ref_start").alias("_rs"), F.col("pred_start").alias("_ps"), F.lit(True).alias("_m"))
    r = refs.select(*keys, "ref_id", "ref_label").join(m, [*keys, "ref_id"], "left")
    p = preds.select(*keys, "pred_id", "pred_start", "pred_end", "pred_label").join(r.filter("_m").drop("ref_id"), [*keys, "pred_id"], "left")
    kinds = {"_scr": "negative.normal_scramble", "_hp": "negative.hand_posting"}
    p = touched_by(p, negatives, keys, ("pred_start", "pred_end"), ("neg_start", "neg_end"), "neg_label", kinds, width, sizes=preds)
    hit = F.col("_m").isNotNull()
    ok = label_outcome(F.col("ref_label"), F.col("pred_label"), mode)
    onset = F.col("_ps") - F.col("_rs")
    timing = F.when(F.col("_ps") < F.col("_rs") - early, "early_detection").when(F.col("_ps") > F.col("_rs") + early, "late_detection")
    subtype = F.when(~ok | (F.trim("ref_label") != F.trim("pred_label")), F.lit("wrong_subtype"))
    cat = F.when(F.col("_scr"), "false_positive_scramble").when(F.col("_hp"), "false_positive_hand_posting").otherwise("false_positive")
    judged = p.select(
        *keys, F.when(~hit, "extra").when(ok, "tp").otherwise("mismatch").alias("outcome"), "ref_label", "pred_label", onset.alias("onset"),
        F.when(hit, F.array_compact(F.array(subtype, F.when(ok, timing)))).otherwise(F.array(cat)).alias("errors"),
    )
    missed = r.filter("_m is null").select(
        *keys, F.lit("missed").alias("outcome"), "ref_label", F.lit(None).cast("string").alias("pred_label"), F.lit(None).cast("double").alias("onset"),
        F.array(F.lit("missed_event")).alias("errors"),
    )
    return judged.unionByName(missed)


def namespaced_metrics(outcomes: DataFrame, beta: float = 2.0) -> DataFrame:
    """Per label, ``micro`` and ``macro`` rows: tp, fp, fn, precision, recall, f1, f2, mean onset."""
    tp, mis = F.col("outcome") == "tp", F.col("outcome") == "mismatch"
    rows = F.array_compact(
        F.array(
            F.when(tp, F.struct(F.col("ref_label").alias("label"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))),
            F.when(mis | (F.col("outcome") == "missed"), F.struct(F.col("ref_label").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))),
            F.when(mis | (F.col("outcome") == "extra"), F.struct(F.col("pred_label").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))),
        )
    )
    d = outcomes.select(F.when(tp, F.col("onset")).alias("_on"), F.inline(rows))
    cls = d.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("_on").alias("_s"), F.sum(F.abs("_on")).alias("_a"))
    c3 = [F.col(c) for c in ("tp", "fp", "fn")]
    per = cls.select("label", "tp", "fp", "fn", *prf(*c3, beta), safe_div(F.col("_s"), F.col("tp")).alias("mean_onset"))
    pooled = cls.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "_s", "_a")])
    micro = pooled.select(F.lit("micro").alias("label"), "tp", "fp", "fn", *prf(*c3, beta), safe_div(F.col("_s"), F.col("tp")).alias("mean_onset"))
    macro = per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "f2")]).select(
        F.lit("macro").alias("label"), *[F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn")], "precision", "recall", "f1", "f2", F.lit(None).cast("double").alias("mean_onset")
    )
    return per.unionByName(micro).unionByName(macro)


def positives(labels: DataFrame, label: str) -> DataFrame:
    """Only labels that count as positives."""
    return labels.filter(namespace(F.col(label)).isin(*POSITIVE))


def error_counts(outcomes: DataFrame) -> DataFrame:
    """Errors per category, most frequent first, ties by name."""
    d = outcomes.select(F.explode("errors").alias("category"))
    return d.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def alert_consistency(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of equal labels (``level_a`` / ``level_b``) at equal positions."""
    return a.join(b, list(keys)).groupBy(*by).agg(F.avg((F.col("level_a") == F.col("level_b")).cast("double")).alias("consistency"), F.count(F.lit(1)).alias("n"))


def coverage(frames: DataFrame, poses: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of frames whose key also has a pose (membership, duplicates ignored)."""
    p = poses.select(*keys).distinct().withColumn("_hit", F.lit(1))
    j = frames.join(p, list(keys), "left")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"), F.count("_hit").alias("n_pose"), (100.0 * F.count("_hit") / F.count(F.lit(1))).alias("coverage_pct"))


def triggered_rule_counts(df: DataFrame, col: str) -> DataFrame:
    """Rule frequency over list cells: arrays, JSON arrays or plain strings."""
    if dict(df.dtypes)[col].startswith("array"):
        cells = F.col(col)
    else:
        cells = F.when(F.trim(F.col(col)).startswith("["), F.from_json(F.col(col), "array<string>")).otherwise(F.array(F.col(col)))
    d = df.select(F.explode(cells).alias("rule")).filter(F.length(F.trim("rule")) > 0)
    return d.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def behaviour(df: DataFrame, keys: Sequence[str], score: str, level: str, t: str) -> DataFrame:
    """Maximum, mean, share of HIGH or CRITICAL and first such time per run and mode."""
    hot = F.upper(F.col(level)).isin("HIGH", "CRITICAL")
    return df.groupBy(*keys).agg(
        F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), (100.0 * F.count_if(hot) / F.count(F.lit(1))).alias("pct_high"),
        F.min(F.when(hot, F.col(t))).alias("first_high"), F.count(F.lit(1)).alias("n_frames"),
    )


def variance_summary(df: DataFrame, mode: str, run: str, score: str) -> DataFrame:
    """Per mode: mean over runs of maximum, mean and sample variance."""
    per = df.groupBy(mode, run).agg(F.max(score).alias("_mx"), F.avg(score).alias("_mn"), F.when(F.count(score) > 1, F.var_samp(score)).alias("_v"))
    return per.groupBy(mode).agg(F.avg("_mx").alias("mean_max"), F.avg("_mn").alias("mean_mean"), F.avg("_v").alias("mean_variance"), F.count(F.lit(1)).alias("n_runs"))


def run_summary(df: DataFrame, keys: Sequence[str], t: str, score: str, level: str, order: Sequence[str], frame: str) -> DataFrame:
    """Frames, duration, score statistics (population deviation), highest level and first highest frame."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), (F.max(t) - F.min(t)).alias("duration"), F.max(score).alias("max_score"), F.avg(score).alias("avg_score"),
        F.stddev_pop(score).alias("std_score"), F.max(rank_of(F.col(level))).alias("top_rank"),
        F.min_by(frame, F.struct((-F.col(score)).alias("s"), *order)).alias("top_frame"),
    )


def highest_moment(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """The row with the highest score per key; the first one wins."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), *order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def majority_vote(df: DataFrame, keys: Sequence[str], item: str, pos: str) -> DataFrame:
    """Most frequent item per key; ties go to the one seen first."""
    c = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_p"))
    return c.groupBy(*keys).agg(F.min_by(F.struct(item, "_n"), F.struct((-F.col("_n")).alias("n"), "_p")).alias("_w")).select(*keys, F.col("_w")[item].alias(item), F.col("_w")["_n"].alias("votes"))


def statistics(df: DataFrame, video: str, dims: Sequence[str]) -> DataFrame:
    """Value distributions of several columns in one grouping-sets pass: dimension, value, n."""
    cols = [video, *dims]
    g = df.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    top = 2 ** (len(cols)) - 1
    name, val = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        bit = top - 2 ** (len(cols) - 1 - i)
        name = F.when(F.col("_g") == bit, F.lit(c)).otherwise(name)
        val = F.when(F.col("_g") == bit, F.col(c).cast("string")).otherwise(val)
    return g.select(name.alias("dimension"), val.alias("value"), "n")


def method_table(methods: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """Fixed list of methods; those without results give zero rows."""
    nums = [f.name for f in results.schema.fields if f.name != key]
    return methods.join(results, key, "left").na.fill(0, nums).orderBy(order)


def case_status(cases: DataFrame, runs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Per case: ok, missing_run, pending_annotation or missing."""
    r = runs.select(key).distinct().withColumn("_r", F.lit(True))
    a = labels.select(key).distinct().withColumn("_a", F.lit(True))
    has_r, has_a = F.coalesce("_r", F.lit(False)), F.coalesce("_a", F.lit(False))
    s = F.when(has_r & has_a, "ok").when(has_r, "pending_annotation").when(has_a, "missing_run").otherwise("missing")
    return cases.join(r, key, "left").join(a, key, "left").withColumn("status", s).drop("_r", "_a")


def scenario_table(df: DataFrame, metric: str, order: Sequence[str]) -> DataFrame:
    """One row per scenario, best first, scenarios without a value last (``place`` from 1). The table is an aggregate, so it is small."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(metric), *order)))


def sweep_summary(results: DataFrame, path: str, video: str, status: str) -> DataFrame:
    """One row per value of a sweep, taken from the folder name (``_p90``), and whether it is the best.

    ``results`` has per-video rows (tp, fp, fn, precision, recall, f1) and, for some folders, stored
    rows ``__micro__`` and ``__macro__``. Stored figures count; without them they are worked out from
    the rows of status OK or CACHED. Folders of other names and values without any row are left out.
    Best is the largest macro F1, then macro recall, then micro recall, then the smallest value.
    """
    d = results.withColumn("value", F.regexp_extract(path, r"_p(\d+)", 1)).filter("value <> ''").withColumn("value", F.col("value").cast("int"))
    good = F.col(status).isin("OK", "CACHED") & ~F.coalesce(F.col(video), F.lit("")).isin("", "__micro__", "__macro__") & F.col("tp").isNotNull() & F.col("fp").isNotNull() & F.col("fn").isNotNull()
    stored = lambda row, c: F.max(F.when(F.col(video) == row, F.col(c)))
    names = ("precision", "recall", "f1")
    a = d.groupBy("value").agg(
        F.count_if(good).alias("n_videos"),
        *[F.sum(F.when(good, F.col(c))).alias(f"_{c}") for c in ("tp", "fp", "fn")],
        *[F.avg(F.when(good, F.col(c))).alias(f"_mean_{c}") for c in names],
        *[stored("__micro__", c).alias(f"_micro_{c}") for c in names],
        *[stored("__macro__", c).alias(f"_macro_{c}") for c in names],
    )
    pooled = prf(F.col("_tp"), F.col("_fp"), F.col("_fn"))
    has = F.col("_micro_f1").isNotNull() & F.col("_macro_f1").isNotNull()
    a = a.filter(has | (F.col("n_videos") > 0)).select(
        "value", "n_videos", has.alias("stored"),
        *[F.when(has, F.col(f"_micro_{c}")).otherwise(p).alias(f"micro_{c}") for c, p in zip(names, pooled, strict=True)],
        *[F.when(has, F.col(f"_macro_{c}")).otherwise(F.coalesce(f"_mean_{c}", F.lit(0.0))).alias(f"macro_{c}") for c in names],
    )
    best = Window.orderBy(F.desc("macro_f1"), F.desc("macro_recall"), F.desc("micro_recall"), "value")
    return a.withColumn("best", F.row_number().over(best) == 1)


def case_summary(cases: DataFrame, key: str, risk: DataFrame, events: DataFrame, qa: DataFrame, score: str, level: str, start: str, end: str) -> DataFrame:
    """One row per case: frames, largest score and level rank, events and their longest, and the columns of ``qa``.

    Each side is one row per case before it is joined; a case without rows on a side has zero counts and nulls there.
    """
    r = risk.groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"), F.max(score).alias("max_score"), F.max(rank_of(F.col(level))).alias("top_rank"))
    e = events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.max(F.col(end) - F.col(start)).alias("longest"))
    return cases.join(r, key, "left").join(e, key, "left").join(qa, key, "left").na.fill(0, ["n_frames", "n_events"])


def leg_metrics(refs: DataFrame, preds: DataFrame, keys: Sequence[str], leg: str, legs: Sequence[str], width: float, threshold: float, tolerance: float = 0.0) -> DataFrame:
    """Per-video counts of each leg of a timeline and of all legs together (``combined``), by one matching with the leg as a key.

    A prediction counts for its own leg and the combined one; one of another or no leg only for the combined.
    Every leg is judged against all references.
    """
    every = F.array(*[F.lit(x) for x in ("combined", *legs)])
    r = refs.withColumn(leg, F.explode(every))
    own = F.when(F.col(leg).isin(*legs), F.array(F.lit("combined"), F.col(leg))).otherwise(F.array(F.lit("combined")))
    p = preds.withColumn(leg, F.explode(own))
    return event_counts(r, p, greedy_match(r, p, [leg, *keys], width, threshold, tolerance), [leg, *keys])


def coco_counts(doc: DataFrame, person: int = 1) -> DataFrame:
    """Distinct images and person annotations of nested JSON documents (``images``, ``annotations``)."""
    return doc.select(
        F.size(F.array_distinct(F.col("images.id"))).alias("n_images"),
        F.size(F.filter("annotations", lambda a: a["category_id"] == person)).alias("n_persons"),
    )


def explanation_metrics(df: DataFrame, keys: Sequence[str], text: str, fallback: str, error: str) -> DataFrame:
    """Counts of generated, fallback and failed explanations per run."""
    t = F.lower(F.col(text))
    filled = F.length(F.trim(F.col(text))) > 0
    fb, er = t.rlike(fallback), t.rlike(error)
    used = filled & ~fb & ~er
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(used).alias("n_used"), F.count_if(filled & fb).alias("n_fallback"), F.count_if(filled & er).alias("n_error"),
        safe_div(F.count_if(used), F.count(F.lit(1))).alias("success_rate"),
    )


def candidate_summary(metrics: DataFrame, manifest: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """Per run: candidate count, micro metrics, minutes (from metrics, else frames / fps / 60)."""
    n = preds.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates"))
    j = manifest.join(metrics, key, "left").join(n, key, "left")
    mins = F.coalesce(F.col("minutes"), F.col("frames") / F.col("fps") / 60.0)
    return j.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0)), "minutes": mins})


def regression_check(got: DataFrame, want: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float) -> DataFrame:
    """Compare metric tables by key: one row per key and column that differs or is absent on a side."""
    g = got.select(*keys, F.lit(True).alias("_g"), *[F.col(c).cast("double").alias(f"_g_{c}") for c in cols])
    w = want.select(*keys, F.lit(True).alias("_w"), *[F.col(c).cast("double").alias(f"_w_{c}") for c in cols])
    j = g.join(w, list(keys), "full_outer")
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_g_{c}").alias("got"), F.col(f"_w_{c}").alias("want")) for c in cols])
    d = j.select(*keys, F.col("_g").isNull().alias("missing"), F.col("_w").isNull().alias("unexpected"), F.inline(items))
    same = F.col("got").eqNullSafe(F.col("want")) | (F.abs(F.col("got") - F.col("want")) < tol)
    return d.filter(F.col("missing") | F.col("unexpected") | ~F.coalesce(same, F.lit(False)))


_ = Window
