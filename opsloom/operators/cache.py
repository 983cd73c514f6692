"""Materialised results, kept for a while by what was asked.

A result of at most ``rows`` rows is held as a local relation, so asking again runs no job; a larger one is kept by the
executors and dropped with its entry. There are ``entries`` entries at most; the one that ends first makes room.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable
from threading import Lock

from pyspark.sql import DataFrame

from ..plans.window import Window

TTL, ENTRIES, ROWS = 15.0, 64, 10_000


def asked(w: Window, name: str, user: str = "") -> Hashable:
    """What tells one call from another: the window as resolved, the report and the user looked for."""
    return w.start, w.end, w.tz, w.source, w.preset, w.bucket_minutes, name, user.strip().lower()


class ResultCache:
    def __init__(self, ttl: float = TTL, entries: int = ENTRIES, rows: int = ROWS, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.entries, self.rows, self.clock = ttl, entries, rows, clock
        self._kept: dict[Hashable, tuple[float, dict[str, DataFrame], list[DataFrame]]] = {}
        self._lock = Lock()

    def __len__(self) -> int:
        return len(self._kept)

    def _materialised(self, df: DataFrame, large: list[DataFrame]) -> DataFrame:
        some = df.limit(self.rows + 1).toArrow()
        if some.num_rows <= self.rows:
            return df.sparkSession.createDataFrame(some, df.schema)
        large.append(df := df.persist())
        df.count()
        return df

    def _drop(self, key: Hashable) -> None:
        for df in self._kept.pop(key)[2]:
            df.unpersist()

    def get(self, key: Hashable, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The parts kept under ``key``, or those that ``build`` gives, materialised. A lifetime of nothing keeps nothing."""
        if self.ttl <= 0:
            return build()
        with self._lock:
            for old in [k for k, (end, *_) in self._kept.items() if end <= self.clock()]:
                self._drop(old)
            if key in self._kept:
                return dict(self._kept[key][1])
        large: list[DataFrame] = []
        parts = {name: self._materialised(df, large) for name, df in build().items()}
        with self._lock:
            if key in self._kept:  # somebody was faster
                self._drop(key)
            self._kept[key] = (self.clock() + self.ttl, parts, large)
            while len(self._kept) > self.entries:
                self._drop(min(self._kept, key=lambda k: self._kept[k][0]))
        return dict(parts)

    def clear(self) -> None:
        with self._lock:
            for key in list(self._kept):
                self._drop(key)
