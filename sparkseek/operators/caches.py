"""What searches keep between calls: vectors and the vocabulary of one version of a catalog."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

IDLE_S = 60.0


@dataclass
class _Kept:
    version: str
    rows: DataFrame
    used: float


class Caches:
    """DataFrames by name, each for one version; another version, ``forget`` or idleness lets go of them.

    Rows are persisted on the executors, so a lost executor's part is made again.
    """

    def __init__(self, idle_s: float = IDLE_S, clock: Callable[[], float] = time.monotonic):
        self.idle_s, self.clock = idle_s, clock
        self._kept: dict[str, _Kept] = {}

    def get(self, name: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
        self.drop_idle()
        kept = self._kept.get(name)
        if kept is None or kept.version != version:
            self.forget(name)
            kept = self._kept[name] = _Kept(version, make().persist(), self.clock())
        kept.used = self.clock()
        return kept.rows

    def forget(self, *names: str) -> None:
        """Lets go of these, or of all: vectors when vectors are written, the vocabulary when texts or metadata are."""
        for name in names or list(self._kept):
            if kept := self._kept.pop(name, None):
                kept.rows.unpersist()

    def drop_idle(self) -> None:
        for name in [n for n, k in self._kept.items() if self.clock() - k.used > self.idle_s]:
            self.forget(name)
