"""What ingest does next: queues of work, and when a backlog may be worked on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the schedule.
SMALL_BACKLOG, FRESH_MS = 40, 24 * 3_600_000
READS_A_WORKER, EMBED_BATCH, SHARPEN_BATCH = 4, 8, 1


def _queued(rows: DataFrame, queue: DataFrame) -> DataFrame:
    return rows.join(queue.select("id", F.lit(True).alias("queued")), "id", "left").withColumn("queued", F.coalesce("queued", F.lit(False)))


def _newest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("mtime"), "id").limit(n)


def to_read(catalog: DataFrame, queue: DataFrame, workers: int) -> DataFrame:
    """Unread rows and rows queued again, newest first."""
    return _newest(_queued(catalog.filter(~F.col("hidden")), queue).filter((F.col("stage") == 0) | F.col("queued")), workers * READS_A_WORKER)


def needs_embedding(version: str) -> Column:
    return (F.col("stage") >= 1) & F.col("error").isNull() & (F.col("embedding").isNull() | ~F.col("embedding_version").eqNullSafe(version))


def to_embed(catalog: DataFrame, queue: DataFrame, version: str) -> DataFrame:
    rows = catalog.filter(~F.col("hidden") & needs_embedding(version)).join(queue.select("id"), "id", "left_anti")
    return _newest(rows, EMBED_BATCH)


def to_sharpen(catalog: DataFrame) -> DataFrame:
    """The newest row read plainly that has text, or could hold some: a wide image of 640 by 360 or more."""
    wide = (F.col("width") >= 640) & (F.col("height") >= 360) & (F.col("width") >= F.col("height"))
    return _newest(catalog.filter(~F.col("hidden") & (F.col("stage") >= 1) & (F.col("ocr") == 0) & ((F.col("text") != "") | wide)), SHARPEN_BATCH)


def may_work(forced: bool, on_battery: bool, idle: bool, waiting: int, newest_age_ms: int | None) -> bool:
    """Whether to work on a backlog now: small ones and fresh ones always, unless the power is short."""
    if forced or on_battery:
        return forced
    return idle or waiting <= SMALL_BACKLOG or (newest_age_ms is not None and newest_age_ms < FRESH_MS)


@dataclass(frozen=True)
class Control:
    """What a user asked of the backlog: to wait, or to be worked off now whatever the power and load."""

    paused: bool = False
    forced: bool = False

    def pause(self) -> Control:
        return Control(paused=True)

    def resume(self) -> Control:
        return Control()

    def finish(self) -> Control:
        """Works until nothing waits; ``after`` ends it."""
        return Control(forced=True)

    def after(self, waiting: int) -> Control:
        return Control(paused=self.paused) if self.forced and not waiting else self

    def may_work(self, on_battery: bool, idle: bool, waiting: int, newest_age_ms: int | None) -> bool:
        return not self.paused and may_work(self.forced, on_battery, idle, waiting, newest_age_ms)


def next_lane(last: str, ready: dict[str, bool]) -> str | None:
    """Reading, embedding and sharpening take turns; lanes without work are passed over."""
    lanes = ["read", "embed", "sharpen"]
    at = lanes.index(last) if last in lanes else -1
    return next((lanes[(at + i) % 3] for i in (1, 2, 3) if ready.get(lanes[(at + i) % 3])), None)


def read_workers(cores: int) -> int:
    return min(3, max(1, cores // 4))
