"""Strike segments of live pose streams.

State of a session: the wrist speeds of its last frames (a ring), the last wrists, and the
segments already reported. Every ``stride`` frames the ring is searched as the batch detector
searches a whole video; segments that end near its tail are reported once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, hypot

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanwise.functions import geometry as g


@dataclass(frozen=True)
class StrikeStream:
    """Frames held and needed, frames between searches, and how near its tail a segment must end."""

    fps: float
    held: int = 24
    least: int = 16
    stride: int = 2
    tail: int = 6
    fresh: int = 4
    pct: float = 0.85
    merge: int = 8
    smooth: int = 5


def edge_mean(x: np.ndarray, rows: int) -> np.ndarray:
    """Centred mean over ``rows`` values, the end values repeated."""
    at = np.arange(len(x))[:, None] + np.arange(-(rows // 2), rows // 2 + 1)
    return x[np.clip(at, 0, len(x) - 1)].sum(axis=1) / rows


def quantile(x: np.ndarray, q: float) -> float:
    """Linear between the two nearest ranks."""
    s = np.sort(x)
    h = (len(s) - 1) * q
    lo = floor(h)
    return float(s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (h - lo))


def ring_segments(speeds: np.ndarray, cfg: StrikeStream) -> list[tuple[int, int, float]]:
    """(first, last, peak) of the runs above the ring's own percentile, joined over small gaps."""
    x = np.array(speeds, dtype=float)
    x[0] = 0.0
    sm = edge_mean(x, cfg.smooth)
    moving = sm[sm > 1e-12]
    if not len(moving):
        return []
    on = np.flatnonzero(sm > max(quantile(moving, cfg.pct), 1e-12))
    out = []
    for run in np.split(on, np.flatnonzero(np.diff(on) > cfg.merge + 1) + 1):
        if len(run):
            out.append((int(run[0]), int(run[-1]), float(sm[run[0] : run[-1] + 1].max())))
    return out


class StrikeProcessor(StatefulProcessor):
    """Rows of a session are taken by ``tie``; earlier triggers hold earlier frames."""

    def __init__(self, keys: list[str], cfg: StrikeStream) -> None:
        self.keys, self.cfg = keys, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "frames long, speeds array<double>, wrists array<double>")
        self.seen = handle.getMapState("seen", "first long, last long", "frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cfg = self.cfg
        frames, speeds, last = self.ring.get() if self.ring.exists() else (0, [], None)
        speeds, out = list(speeds), []
        batch = pd.concat(list(rows)).sort_values("tie")
        for ok, *wrists in batch[["ok", "lx", "ly", "rx", "ry"]].itertuples(index=False):
            now = [float(w) for w in wrists] if ok else None
            both = now is not None and last is not None and len(last) == 4
            moved = [hypot(now[i] - last[i], now[i + 1] - last[i + 1]) for i in (0, 2)] if both else [0.0]
            speeds = [*speeds[-(cfg.held - 1) :], max([0.0, *[m for m in moved if m == m]]) * cfg.fps]
            last, frames = now, frames + 1
            newest = frames - 1
            if len(speeds) < cfg.least or (frames - cfg.least + 1) % cfg.stride:
                continue
            first = frames - len(speeds)
            for a, b, peak in ring_segments(np.array(speeds), cfg):
                a, b = a + first, b + first
                if b < newest - cfg.tail or b + 1 < newest - cfg.fresh or self.seen.containsKey((a, b)):
                    continue
                self.seen.updateValue((a, b), (newest,))
                out.append((a, b, peak, newest))
        for a, b in [k for k in self.seen.keys() if k[1] < frames - cfg.held]:
            self.seen.removeKey((a, b))
        self.ring.update((frames, speeds, last or []))
        d = pd.DataFrame(out, columns=["start_index", "end_index", "score", "found_at"])
        for i, k in enumerate(self.keys):
            d.insert(i, k, key[i])
        yield d

    def close(self) -> None:
        pass


def strike_stream(stream: DataFrame, keys: list[str], tie: str, cfg: StrikeStream, valid: Column | None = None) -> DataFrame:
    """One row per new strike segment: keys, start_index, end_index, score, found_at (frames of the session from 0).

    ``stream`` has wide poses. A frame counts for speed where ``valid`` holds (default: at least
    five of the joints from shoulder to wrist are there), also in the frame before it. Rows that share ``tie``
    within a trigger keep no order. A trigger's rows of one session are held together:
    bound them at the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
    """
    ok = (g.n_valid(range(5, 11)) >= 5) if valid is None else valid
    left, right = g.joint(g.L_WR), g.joint(g.R_WR)
    d = stream.select(*keys, F.col(tie).alias("tie"), ok.alias("ok"), left.x.alias("lx"), left.y.alias("ly"), right.x.alias("rx"), right.y.alias("ry"))
    kt = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kt}, start_index long, end_index long, score double, found_at long"
    return d.groupBy(*keys).transformWithStateInPandas(statefulProcessor=StrikeProcessor(keys, cfg), outputStructType=schema, outputMode="Update", timeMode="None")
