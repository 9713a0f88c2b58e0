"""Greedy box tracking between consecutive frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.scalar import box_iou
from spanwise.operators.chain import cut
from spanwise.operators.intervals import mutual_best
from spanwise.operators.ordered import Seq, scan


def associate(df: DataFrame, keys: Sequence[str], threshold: float, width: float = 100_000.0) -> DataFrame:
    """Track ids for detections ``frame_index``, ``det_index``, ``box``.

    A detection takes the best unused track of the previous frame with IoU >= threshold,
    in detection order, else a new id; a frame without detections ends all tracks, so
    only consecutive frames link. Links depend on two frames only and are found for all
    frames at once; a track is then the path of links, followed by pointer doubling
    (log2 of the longest track many rounds). Ids count first detections in order.
    """
    keys = list(keys)
    cur = df.select(*keys, "frame_index", F.col("det_index").alias("pred_id"), F.col("box").alias("_b"))
    prev = df.select(*keys, (F.col("frame_index") + 1).alias("frame_index"), F.col("det_index").alias("ref_id"), F.col("box").alias("_a"))
    pairs = cur.join(prev, [*keys, "frame_index"]).withColumn("iou", box_iou(F.col("_a"), F.col("_b")))
    pairs = pairs.filter((F.col("iou") >= threshold) & (F.col("iou") > 0)).drop("_a", "_b")
    links = mutual_best(pairs, [*keys, "frame_index"], [F.col("pred_id")], [-F.col("iou"), F.col("ref_id")])
    node = F.struct(F.col("frame_index").alias("f"), F.col("det_index").alias("d"))
    up = links.select(*keys, "frame_index", F.col("pred_id").alias("det_index"), F.struct((F.col("frame_index") - 1).alias("f"), F.col("ref_id").alias("d")).alias("_up"))
    d = cut(df.select(*keys, "frame_index", "det_index").join(up, [*keys, "frame_index", "det_index"], "left").withColumn("_node", node).withColumn("_up", F.coalesce("_up", "_node")))
    while True:
        step = d.select(*keys, F.col("_node").alias("_up"), F.col("_up").alias("_up2"))
        nxt = cut(d.join(step, [*keys, "_up"]).select(*keys, "frame_index", "det_index", "_node", F.col("_up2").alias("_up"), (F.col("_up2") != F.col("_up")).alias("_moved")))
        d = nxt.drop("_moved")
        if nxt.filter("_moved").isEmpty():
            break
    heads = d.filter(F.col("_node") == F.col("_up")).select(*keys, "frame_index", "det_index", "_up")
    heads = scan(heads, Seq(tuple(keys), ("frame_index", "det_index"), width), index="_id").select(*keys, "_up", (F.col("_id") + 1).alias("track_id"))
    return d.join(heads, [*keys, "_up"]).select(*keys, "frame_index", "det_index", "track_id")
