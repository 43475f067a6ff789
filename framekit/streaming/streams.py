"""Streams of frames, dropout runs and configurations (ST1-ST4).

Stream operators take and return streaming DataFrames. Event time is the capture's start (the column
``started``) plus the end of the frame, so that a capture that begins later in the day is later on the
stream's one clock, not back at zero. Rows that come after the watermark are counted (``LateRows``) and
``run_to_table`` refuses a result without them. Keys include the frame or the window, so a capture that sends
most of the rows is spread over tasks and state stores.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framekit.operators.vbi import step_class
from framekit.session import cut, exists, remove, scratch_dir
from framekit.sources import sidecar

EVENT = "event_time"
STARTED = "started"
#: How far after the last row of a bounded stream its closing row stands.
CLOSING = "INTERVAL 1 DAY"
#: Key of the closing row. It is not null, since the inner side of a join drops null keys before they move the watermark.
NO_CAPTURE = -1


def event_time(started: Column, frame: Column, fps: float | Column) -> Column:
    """Time at the end of a frame (its start would put frame 0 at the first watermark, where rows count as late)."""
    rate = F.lit(fps) if isinstance(fps, float) else fps
    return F.timestamp_micros(F.unix_micros(started.cast("timestamp")) + F.round((frame + 1) * 1e6 / rate).cast("bigint"))


def with_event_time(frames: DataFrame, fps: float | Column, delay: str) -> DataFrame:
    """``frames`` (``started``, ``frame_id``) with event time and watermark; without ``started`` in place of it."""
    if STARTED not in frames.columns:
        raise ValueError(f"a stream of frames needs the start of its capture in {STARTED}")
    return frames.withColumn(EVENT, event_time(F.col(STARTED), F.col("frame_id"), fps)).drop(STARTED).withWatermark(EVENT, delay)


class LateRows(StreamingQueryListener):
    """Counts the rows of one query that came after the watermark and are in no result, over all its batches."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:  # type: ignore[no-untyped-def]  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # type: ignore[no-untyped-def]  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # type: ignore[no-untyped-def]  # noqa: N802
        run = str(event.progress.runId)
        self.of[run] = self.of.get(run, 0) + sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:  # type: ignore[no-untyped-def]  # noqa: N802
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def count(self, query: StreamingQuery, wait: float = 60.0) -> int:
        """The count of a query that has ended; events come in order, so all its batches are in when its end is."""
        run = str(query.runId)
        if not self.ended.setdefault(run, threading.Event()).wait(wait):
            raise TimeoutError(f"the end of query {run} was not reported")
        return self.of.get(run, 0)


def closed(rows: DataFrame, key: str = "capture_id", after: str = CLOSING) -> DataFrame:
    """A bounded table with one more row, long after all others, which closes all windows and joins before it.

    It stays open itself, or gives a result of key ``NO_CAPTURE``, to be dropped at the end (``without_closing``).
    """
    last = rows.agg(F.max(STARTED).alias(STARTED), F.max("frame_id").alias("frame_id")).filter(F.col(STARTED).isNotNull())
    end = last.select(F.lit(NO_CAPTURE).cast(rows.schema[key].dataType).alias(key), (F.col(STARTED) + F.expr(after)).alias(STARTED), "frame_id")
    return rows.unionByName(end, allowMissingColumns=True)


def span_of(rows: DataFrame, fps: float | Column) -> str:
    """The time from the first to the last event of a bounded table (``started``, ``frame_id``) as an interval: rows that come in any order are at most so late."""
    at = F.unix_micros(event_time(F.col(STARTED), F.col("frame_id"), fps))
    first, last = rows.agg(F.min(at), F.max(at)).first()
    return f"{0 if first is None else (last - first) // 1_000_000 + 1} seconds"


def without_closing(result: DataFrame, key: str = "capture_id") -> DataFrame:
    return result.filter(F.col(key) != NO_CAPTURE)


def stream_continuity(frames: DataFrame, fps: float, late: str = "10 seconds", key: str = "capture_id") -> DataFrame:
    """ST1: the step of the picture number from each frame to the next, on a stream.

    Each frame meets its successor by an equi-join of the stream with itself on (capture, frame), so the
    state is hashed by frame rather than held per capture. A frame whose predecessor has not come by
    the watermark is emitted as lost_predecessor; frame 0 has none.
    """
    gap = F.expr(f"INTERVAL {late}")
    now = with_event_time(frames.select(key, STARTED, "frame_id", "picture_number"), fps, late)
    before = with_event_time(frames.select(key, STARTED, "frame_id", "picture_number"), fps, late).select(
        F.col(key).alias("__key"), (F.col("frame_id") + 1).alias("__frame"),
        F.col("picture_number").alias("previous"), F.col(EVENT).alias("__time"),
    )
    joined = now.join(
        before,
        (F.col(key) == F.col("__key")) & (F.col("frame_id") == F.col("__frame"))
        & (F.col("__time") <= F.col(EVENT)) & (F.col("__time") >= F.col(EVENT) - gap),
        "left",
    )
    step, missing = step_class(F.col("picture_number") - F.col("previous"))
    kind = F.when(F.col("frame_id") == 0, "start").when(F.col("previous").isNull(), "lost_predecessor").otherwise(step)
    return joined.select(key, "frame_id", "picture_number", "previous", kind.alias("step_class"), missing)


def _before(state: GroupState) -> tuple[dict[int, int | None], set[int]]:
    if not state.exists:
        return {}, set()
    frames, numbers, told = state.get
    return dict(zip(frames, numbers, strict=True)), set(told)


def stream_continuity_stateful(
    frames: DataFrame, fps: float, late: str = "10 seconds", key: str = "capture_id", block: int = 1024,
) -> DataFrame:
    """ST1: steps of picture numbers by keyed state, for streams in which a capture's rows come in any order.

    State is held per (capture, ``block`` frames): the frames met with their numbers, and which of them were told, so it has at most ``block`` + 1
    entries, and a capture of any length is spread over tasks. The last frame of a block is also sent to the next one. A frame is told as soon
    as it and the one before it are there; one that comes again after that is a ``replay`` (its number and the first one's as ``previous``). When the watermark
    passes the block's last event, the timer tells frames whose predecessor never came (``lost_predecessor``) and drops the state.
    ``late`` must cover how far rows of a block may be apart.
    """
    timed = with_event_time(frames.select(key, STARTED, "frame_id", "picture_number"), fps, late)
    own = F.floor(F.col("frame_id") / block)
    places = F.when((F.col("frame_id") + 1) % block == 0, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = timed.select(key, EVENT, "frame_id", "picture_number", F.explode(places).alias("block"))
    kind = dict(frames.dtypes)
    out = f"{key} {kind[key]}, frame_id bigint, picture_number bigint, previous bigint, told string"

    def step(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        capture, number = at
        met, told = _before(state)
        first = number * block
        rows: list[tuple] = []
        if state.hasTimedOut:
            rows = [(f, met[f], None, "lost_predecessor") for f in sorted(met) if f >= first and f not in told]
            state.remove()
        else:
            latest = 0
            for batch in batches:
                latest = max(latest, int(batch[EVENT].max().timestamp() * 1000))
                for frame, picture in zip(batch["frame_id"].tolist(), batch["picture_number"].tolist(), strict=True):
                    picture = None if picture is None or picture != picture else int(picture)
                    if frame in met:
                        if frame >= first:
                            rows.append((frame, picture, met[frame], "replay"))
                    else:
                        met[frame] = picture
            for frame in sorted(met):
                if frame >= first and frame not in told and (frame == 0 or frame - 1 in met):
                    told.add(frame)
                    rows.append((frame, met[frame], met.get(frame - 1), "start" if frame == 0 else "met"))
            order = sorted(met)
            state.update((order, [met[f] for f in order], sorted(told)))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        result = pd.DataFrame(rows, columns=["frame_id", "picture_number", "previous", "told"])
        result.insert(0, key, capture)
        yield result.astype({"frame_id": "int64", "picture_number": "Int64", "previous": "Int64"})

    found = dealt.groupBy(key, "block").applyInPandasWithState(
        step, out, "frames array<bigint>, numbers array<bigint>, told array<bigint>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    step_kind, missing = step_class(F.col("picture_number") - F.col("previous"))
    named = F.when(F.col("told") != "met", F.col("told")).when(F.col("previous").isNull(), "lost_predecessor").otherwise(step_kind)
    return found.select(
        key, "frame_id", "picture_number", "previous", named.alias("step_class"), F.when(F.col("told") == "met", missing).otherwise(0).cast("bigint").alias("missing"),
    )


def stream_dropout_rate(
    runs: DataFrame, fps: float, window: str, slide: str | None = None, late: str = "10 seconds", key: str = "capture_id"
) -> DataFrame:
    """ST2: runs and lost samples per capture in tumbling or sliding windows of capture time."""
    timed = with_event_time(runs, fps, late)
    return timed.groupBy(key, F.window(EVENT, window, slide)).agg(
        F.count("*").alias("n_runs"), F.sum("sample_count").alias("lost")
    ).select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_runs", "lost")


def stream_dropout_bursts(runs: DataFrame, fps: float, gap: str, late: str = "10 seconds", key: str = "capture_id") -> DataFrame:
    """ST2: bursts of dropouts: session windows that end after ``gap`` without a run."""
    timed = with_event_time(runs, fps, late)
    return timed.groupBy(key, F.session_window(EVENT, gap)).agg(
        F.count("*").alias("n_runs"), F.sum("sample_count").alias("lost")
    ).select(key, F.col("session_window.start").alias("burst_start"), F.col("session_window.end").alias("burst_end"), "n_runs", "lost")


def stream_sidecar_dedup(runs: DataFrame, fps: float, late: str = "10 seconds") -> DataFrame:
    """ST3: one row per primary key of ``dropout_run`` among rows at most ``late`` apart."""
    return with_event_time(runs, fps, late).dropDuplicatesWithinWatermark(["cvbs_file_id", "frame_id", "sample_start"]).drop(EVENT)


def ingest_sidecar(runs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """ST3: merge each batch into the sidecar table of ``folder``, one row per primary key, whatever the time between two copies.

    A batch replaces the rows of the files that it touches, so a replayed batch or a second copy changes nothing, and rows are never late.
    Of rows with equal keys the severest stays, then the longest.
    """
    spark = runs.sparkSession
    key = ["cvbs_file_id", "frame_id", "sample_start"]
    columns = [*key, "sample_count", "severity"]

    def save(batch: DataFrame, batch_id: int) -> None:
        base = scratch_dir(spark, "ingest")
        rows = batch.select(*columns)
        try:
            # also before the first batch of a new checkpoint rows may be there
            if exists(spark, f"{folder}/dropout_run"):
                rows.write.parquet(base)  # read for its files and for its rows
                rows = spark.read.schema(rows.schema).parquet(base)
                rows = rows.unionByName(sidecar.read_sidecar(spark, folder, "dropout_run", rows).select(*columns))
            merged = rows.groupBy(*key).agg(F.max(F.struct("severity", "sample_count")).alias("v")).select(*key, "v.sample_count", "v.severity")
            sidecar.write_sidecar(merged, folder, "dropout_run")
        finally:
            remove(spark, base)

    return runs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def stream_validate(
    rows: DataFrame, rules: Callable[[DataFrame], DataFrame], accepted: str, quarantine: str, checkpoint: str
) -> StreamingQuery:
    """ST4: apply rules to arriving configuration rows; rows with an error go to the quarantine table.

    ``rules`` maps a batch to findings (project_id, section_no, rule, severity, detail).
    """
    def route(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # read for the rules and for the split
        try:
            bad = rules(batch).filter("severity = 'error'").select(
                F.col("project_id").alias("__project"), F.col("section_no").alias("__section"), F.lit(True).alias("__bad"),
            ).distinct()
            match = F.col("project_id").eqNullSafe(F.col("__project")) & F.col("section_no").eqNullSafe(F.col("__section"))
            split = batch.join(bad, match, "left").select(*batch.columns, F.coalesce("__bad", F.lit(False)).alias("__bad"), F.lit(batch_id).alias("batch_id"))
            judged = cut(split, "judged")
            for flag, folder in ((False, accepted), (True, quarantine)):
                judged.filter(F.col("__bad") == flag).drop("__bad").write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic"
                ).partitionBy("batch_id").parquet(folder)
        finally:
            batch.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(route).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into a Parquet table and read it.

    In ``update`` mode each batch holds the rows that changed, with ``batch_id``: the last one wins.
    Late rows are an error, not a gap in the result.
    """
    spark = stream.sparkSession
    base = scratch_dir(spark, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(f"{base}/table")

    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
            .foreachBatch(save).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        late = listener.count(query)
    finally:
        spark.streams.removeListener(listener)
    if late:
        raise ValueError(f"{late} rows came after the watermark; allow more delay")
    return spark.read.schema(f"{_ddl(stream)}, batch_id bigint").parquet(f"{base}/table")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def replay(spark: SparkSession, table: DataFrame, label: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a written copy of a table, for replaying history through a stream operator."""
    path = scratch_dir(spark, label)
    table.write.parquet(path)
    reader = spark.readStream.schema(table.schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def replay_batches(spark: SparkSession, batches: list[DataFrame], label: str, files: int = 4) -> DataFrame:
    """A stream that brings the given tables one after the other, each in ``files`` files (the last, which may be short, in as many as it has)."""
    path = scratch_dir(spark, label)
    for rows in batches[:-1]:
        rows.repartition(files).write.mode("append").parquet(path)
    batches[-1].write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", files).parquet(path)
