"""Structured Streaming form of the episode bus.

Keyed by (session, kind); state is one open episode. Rows older than the watermark are
dropped by Spark; within a trigger they are taken in time order, so a stream read in one
trigger gives the batch result. The batch operator lives in ``operators.episodes``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanwise.plans.config import BusConfig

STATE = "episode long, start_us long, seen_us long, n_obs long, score double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: tuple | None, t: int, score: float, force: bool, gap: int, cooldown: int) -> tuple[tuple | None, tuple | None]:
    """One observation: returns (state, episode closed by it). Late rows (t before last seen) merge."""
    if state is None:
        return (0, t, t, 1, score), None
    ep, start, seen, n, best = state
    if t - seen <= gap:
        return (ep, min(start, t), max(seen, t), n + 1, max(best, score)), None
    if not force and t - seen < cooldown:
        return state, None
    return (ep + 1, t, t, 1, score), state


class EpisodeProcessor(StatefulProcessor):
    """Emits every episode touched in a trigger, and once more when silence closes it."""

    def __init__(self, keys: list[str], cfg: BusConfig) -> None:
        self.keys, self.cfg = keys, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", STATE)

    def _cooldown(self, key: tuple) -> int:
        return int(self.cfg.type_cooldown.get(key[-1], self.cfg.cooldown) * 1e6)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a key has few rows and there are many keys: rows travel in batches of many keys
        row = Row(*self.keys, "episode", "start_us", "seen_us", "n_obs", "score", "finished")
        batch = sorted((r["t_us"], r["tie"], r["obs_score"], r["forced"]) for r in rows)
        had = self.state.get() if self.state.exists() else None
        state = tuple(had) if had is not None else None
        gap, cd = int(round(self.cfg.merge_gap * 1e6)), self._cooldown(key)
        for t, _, s, f in batch:
            state, closed = advance(state, int(t), float(s), bool(f), gap, cd)
            if closed is not None:
                yield row(*key, *closed, True)
        self.state.update(state)
        if had is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
        self.handle.registerTimer(int(state[2] / 1000 + self.cfg.silence_seconds * 1000) + 1)
        yield row(*key, *state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            row = Row(*self.keys, "episode", "start_us", "seen_us", "n_obs", "score", "finished")
            yield row(*key, *tuple(self.state.get()), True)

    def close(self) -> None:
        pass


def episode_stream(stream: DataFrame, keys: list[str], ts: str, tie: str, score: str, cfg: BusConfig, delay: str, force: str | None = None) -> DataFrame:
    """Streaming episodes: update rows with ``finished``; the last row per (keys, episode) is current.

    A silence timer closes an episode when the watermark passes; a late merge can still
    extend it, because its state stays.
    """
    f = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)
    d = stream.withWatermark(ts, delay).select(
        *keys, ts, F.unix_micros(ts).alias("t_us"), F.col(tie).alias("tie"), F.col(score).cast("double").alias("obs_score"), f.alias("forced")
    )
    kt = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kt}, episode long, start_us long, seen_us long, n_obs long, score double, finished boolean"
    return d.groupBy(*keys).transformWithState(
        statefulProcessor=EpisodeProcessor(keys, cfg), outputStructType=schema, outputMode="Update", timeMode="EventTime"
    )


def current_episodes(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Latest row per episode of a stream of updates."""
    best = F.max_by(F.struct("start_us", "seen_us", "n_obs", "score", "finished"), F.struct("n_obs", F.col("finished").cast("int").alias("f")))
    r = updates.groupBy(*keys, "episode").agg(best.alias("_r"))
    return r.select(*keys, "episode", (F.col("_r.start_us") / 1e6).alias("start_time"), (F.col("_r.seen_us") / 1e6).alias("last_seen"), "_r.n_obs", "_r.score", "_r.finished")


def read_stream(spark, path: str, schema, glob: str, fmt: str = "parquet") -> DataFrame:
    """Unbounded frame or event feed from a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).format(fmt).load(path)


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Process what is available and append it to parquet, then stop (restartable from the checkpoint).

    Returns how many rows came behind the watermark and were dropped by stateful operators.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per trigger, overwritten on retry: the write is idempotent
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run_available(stream, write, checkpoint)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """One run over what is available; the number of rows dropped behind the watermark."""
    q = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that stateful processors need; the caller's settings stay."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def in_steps(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], folder: str) -> tuple[DataFrame, int]:
    """Feed ``parts`` to a stream one after the other: each is written below ``folder`` and read in a run of its own.

    Every run starts from the checkpoint of the one before, so state and watermark carry over
    as after a restart. Returns all rows that came out (with ``batch``) and the number of rows dropped.
    """
    own = stateful_session(parts[0].sparkSession)
    dropped = 0
    for k, part in enumerate(parts):
        part.write.mode("overwrite").parquet(f"{folder}/in/part-{k}")
        src = own.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        dropped += run_to_table(build(src), f"{folder}/out", f"{folder}/checkpoint")
    return parts[0].sparkSession.read.parquet(f"{folder}/out"), dropped


class UpsertSink:
    """A ``foreachBatch`` sink that keeps the latest row of each key, with a ledger of batches.

    A batch is written to a folder of its own; then its number goes to the ledger. Readers see
    ledger batches only, so a half-written one is invisible; a batch that is replayed finds itself in
    the ledger and changes nothing. Of several rows of a key the one of the latest batch
    counts; within a batch the last by ``order``.
    """

    def __init__(self, folder: str, keys: Sequence[str], order: Sequence[str]) -> None:
        self.folder, self.keys, self.order = folder, list(keys), list(order)

    def _ledger(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("batch long, n_rows long").option("recursiveFileLookup", "true").parquet(f"{self.folder}/ledger")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], "batch long, n_rows long")
        empty.write.mode("append").parquet(f"{self.folder}/ledger")
        if not self._ledger(spark).filter(F.col("batch") == batch_id).isEmpty():
            return
        at = f"{self.folder}/data/batch={batch_id}"
        values = [c for c in batch.columns if c not in self.keys]
        best = F.max_by(F.struct(*values), F.struct(*self.order)).alias("_v")
        batch.groupBy(*self.keys).agg(best).select(*self.keys, "_v.*").write.mode("overwrite").parquet(at)
        done = spark.read.parquet(at).agg(F.lit(batch_id).cast("long").alias("batch"), F.count(F.lit(1)).alias("n_rows"))
        done.write.mode("append").parquet(f"{self.folder}/ledger")

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest row of every key."""
        d = spark.read.parquet(f"{self.folder}/data").join(self._ledger(spark).select("batch"), "batch", "left_semi")
        values = [c for c in d.columns if c not in (*self.keys, "batch")]
        return d.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*self.keys, "_v.*")


def timeline_points(df: DataFrame, frame: str, level: str, stride: int) -> DataFrame:
    """Sampled timeline: every ``stride`` frames, score = level index / 3."""
    from spanwise.functions.scalar import rank_of

    return df.filter(F.col(frame) % stride == 0).withColumn("point_score", rank_of(F.col(level)) / 3.0)
