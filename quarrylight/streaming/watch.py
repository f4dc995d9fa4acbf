"""File events as a stream: debounce and incremental apply.

Events are (path, event, ts) with event created, modified or deleted. In a finite table a time of quiet
closes a session of all paths together, and the last event of each path in a session counts; in a
stream the last event of a path counts once that path is quiet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.functions.columns import has_extension
from quarrylight.operators import indexing


def wanted(events: DataFrame, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> DataFrame:
    """Without paths that contain an excluded string or have another extension; a rename is created where the file exists, else deleted."""
    kept = F.lit(True)
    for part in exclude:
        kept = kept & ~F.col("path").contains(part)
    rows = events.filter(kept & has_extension(F.col("path"), extensions))
    if "exists" in events.columns:
        rows = rows.withColumn("event", F.when(F.col("event") == "renamed", F.when(F.col("exists"), "created").otherwise("deleted")).otherwise(F.col("event"))).drop("exists")
    return rows


def debounce_batch(events: DataFrame, gap_ms: int = 500, key: str = "path", order: tuple[str, ...] = ("ts",), range_ms: int = 3_600_000) -> DataFrame:
    """(session, path, event, ts) for a finite table: sessions end after gap_ms without any event.

    Gaps are counted within ranges of time, in parallel; only a row for each range that has events (its first and last time, and its number of
    gaps) goes through a window over all, which numbers the sessions that come before."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    times = events.select("ts").distinct().withColumn("m", micros).withColumn("range", F.floor(F.col("m") / (range_ms * 1000)))
    within = Window.partitionBy("range").orderBy("m")
    gaps = times.withColumn("gap", F.coalesce((F.col("m") - F.lag("m").over(within) >= gap_ms * 1000).cast("long"), F.lit(0)))
    ranges = gaps.groupBy("range").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.sum("gap").alias("inside"))
    after = Window.orderBy("range")
    border = F.coalesce((F.col("first") - F.lag("last").over(after) >= gap_ms * 1000).cast("long"), F.lit(0))
    before = ranges.withColumn("border", border).withColumn("before", F.sum(F.col("inside") + F.col("border")).over(after.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside")).select("range", "before")
    inside = F.sum("gap").over(within.rowsBetween(Window.unboundedPreceding, 0))
    session = gaps.withColumn("n", inside).join(before, "range").select("ts", (F.col("before") + F.col("n")).alias("session"))
    best = F.max_by(F.struct("event", "ts"), F.struct(*order))
    return events.join(session, "ts").groupBy("session", key).agg(best.alias("b")).select("session", key, "b.event", "b.ts")


def debounce_stream(events: DataFrame, gap_ms: int = 500, watermark: str = "10 seconds") -> DataFrame:
    """(path, event, ts) for a stream (path, event, ts), in append mode: the last event of a path once the path has been quiet for gap_ms.

    The state of a path is its last event, with a timer; it goes when the watermark has passed the quiet time, so state is bounded by the paths that are busy."""
    gap = gap_ms * 1000

    def quiet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple[str, int]] = []
        if state.hasTimedOut:
            done.append(state.get)
            state.remove()
        else:
            last = state.get if state.exists else None
            new = pd.concat([b[["event", "micros"]] for b in batches]).sort_values("micros", kind="stable")
            for event, micros in new.itertuples(index=False):
                if last and micros < last[1]:
                    continue
                if last and micros - last[1] >= gap:
                    done.append(last)
                last = (event, int(micros))
            state.update(last)
            state.setTimeoutTimestamp(max((last[1] + gap) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], event, micros) for event, micros in done], columns=["path", "event", "micros"])

    timed = events.select("path", "event", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark).withColumn("micros", F.unix_micros("ts"))
    out = timed.groupBy("path").applyInPandasWithState(quiet, "path string, event string, micros long", "event string, micros long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("path", "event", F.timestamp_micros("micros").alias("ts"))


def latest(events: DataFrame, key: str = "path", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last event of each path; pre-aggregated in each task."""
    return events.groupBy(key).agg(F.max_by(F.struct("event", "ts"), F.struct(*order)).alias("b")).select(key, "b.event", "b.ts")


def apply_changes(chunks: DataFrame, changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """chunks after changes (path, event): paths that were modified or deleted go, parsed chunks of those created or modified come."""
    touched = changes.select("path").distinct()
    fresh = parsed.join(changes.filter("event in ('created', 'modified')").select("path").distinct(), "path", "left_semi")
    return indexing.delete(chunks, touched).unionByName(fresh.select(*chunks.columns))


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: created, modified, deleted."""
    return changes.agg(*(F.count_if(F.col("event") == e).alias(e) for e in ("created", "modified", "deleted")))


def run(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a query that reduces each micro-batch to the last event of each path and hands it to apply(changes, batch id)."""

    def batch(rows: DataFrame, number: int) -> None:
        apply(latest(rows), number)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()
