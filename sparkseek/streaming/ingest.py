"""Incremental ingest: new files as a stream, debounced paths, and micro-batches that are merged.

A file stream reports new paths only. Changed and deleted files come from the periodic difference
of a full listing with the catalog, which ``reconcile`` makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkseek.schema import conform
from sparkseek.sources.files import BINARY_FILE, apply_diff, catalog_diff, located, scan_roots
from sparkseek.sources.pointers import Pointers

DEBOUNCE_MS = 400


class CatalogStore:
    """Versions of a catalog under a folder; the highest numbered pointer names the current one.

    A version is written whole before its pointer gets its name, and a pointer is never replaced, so
    readers find a whole version at any time. A batch that is run again finds its number under the
    name of its stream in the pointer and does nothing; another stream, or a stream that begins anew
    with a checkpoint folder of its own, has another name. Versions that the last few pointers don't
    name are removed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pointers = Pointers(spark, self.folder)

    def read(self) -> DataFrame:
        pointer = self.pointers.read()
        if not pointer:
            return conform(self.spark.createDataFrame([], "id long"))
        return self.spark.read.parquet(f"{self.folder}/{pointer['version']}")

    def queue(self) -> DataFrame:
        pointer = self.pointers.read()
        if not pointer:
            return self.spark.createDataFrame([], "id long")
        return self.spark.read.parquet(f"{self.folder}/{pointer['version']}-queue")

    def done(self, batch: int, stream: str = "") -> bool:
        return self.pointers.read().get("batches", {}).get(stream, -1) >= batch

    def write(self, catalog: DataFrame, queue: DataFrame, batch: int = -1, stream: str = "") -> None:
        version = uuid4().hex
        catalog.write.parquet(f"{self.folder}/{version}")
        queue.distinct().write.parquet(f"{self.folder}/{version}-queue")
        batches = self.pointers.read().get("batches", {})
        if batch >= 0:
            batches[stream] = max(batch, batches.get(stream, -1))
        for old in self.pointers.write({"version": version, "batches": batches}):
            self.pointers.remove(f"{self.folder}/{old['version']}")
            self.pointers.remove(f"{self.folder}/{old['version']}-queue")


def file_stream(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """New files below a folder, without their contents."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    return reader.load(root).select("path", "modificationTime", "length")


def upsert(store: CatalogStore, files: DataFrame, roots: list[str], excluded: list[str] = (), batch: int = -1, stream: str = "") -> None:
    """Merges listed files into the catalog: new ones are added, changed ones are queued; nothing is removed."""
    found = located(files, roots, excluded).dropDuplicates(["path"])
    catalog = store.read()
    diff = catalog_diff(found, catalog, roots, complete=[], excluded=[])
    merged, again = apply_diff(catalog, diff)
    store.write(merged, store.queue().unionByName(again), batch, stream)


def reconcile(store: CatalogStore, roots: list[str], excluded: list[str] = (), complete: list[str] | None = None) -> list[str]:
    """Brings the catalog in line with a full listing; gives the roots that could be listed to the end.

    Roots that could not, or that the caller does not name as complete, lose nothing.
    """
    found, listed = scan_roots(store.spark, roots, excluded)
    complete = listed if complete is None else [r for r in complete if r in listed]
    catalog = store.read()
    merged, again = apply_diff(catalog, catalog_diff(found, catalog, roots, complete, excluded))
    left = store.queue().unionByName(again).join(merged.select("id"), "id", "left_semi")
    store.write(merged, left)
    return listed


def start(store: CatalogStore, root: str, checkpoint: str, roots: list[str] | None = None, excluded: list[str] = (), once: bool = False) -> StreamingQuery:
    """Follows a folder: each micro-batch of new files is merged once, also after a restart."""
    roots = roots or [root]

    def merge(files: DataFrame, batch: int) -> None:
        if not store.done(batch, checkpoint):
            upsert(store, files, roots, excluded, batch, checkpoint)

    writer = file_stream(store.spark, root).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def _settle(quiet_ms: int) -> Callable:
    def settle(key: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "last_ms": [last]})
            return
        last = max([*(int(e["event_ms"].max()) for e in events), *(state.get if state.exists else ())])
        state.update((last,))
        state.setTimeoutDuration(quiet_ms)

    return settle


def debounced(events: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(path, last_ms) of each path once no event (path, event_ms) has come for it for a while."""
    return events.groupBy("path").applyInPandasWithState(_settle(quiet_ms), "path string, last_ms long", "last_ms long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_events(events: DataFrame) -> DataFrame:
    """(path, last_ms) of a micro-batch: many events of one path are one."""
    return events.groupBy("path").agg(F.max("event_ms").alias("last_ms"))


class Progress(StreamingQueryListener):
    """Tells a callback of merged batches, at most once in a while."""

    def __init__(self, tell: Callable[[int], None], every_s: float = 1.0):
        self.tell, self.every_s, self._last = tell, every_s, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        import time

        if event.progress.numInputRows and time.monotonic() - self._last >= self.every_s:
            self._last = time.monotonic()
            self.tell(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
