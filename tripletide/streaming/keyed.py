"""A bounded window per key over arriving graphs, without reasoning.

Input rows are graphs: (key, graph_no, use_count, arrival_ts, expire_ts), one per graph
however many triples it has, numbered 0, 1, 2, ... per key. Each key's window fills up in that order,
in whatever order graphs arrive, and from then on every full window drops what has expired, refills, and gives up
``evict`` graphs by policy.

State is read by key: waiting graphs one by one by number, as the window has room; the held ones, at most
``size``, only when the window is full and can step. With ``timers``, event time also ends graphs of a key for which
nothing arrives: a graph whose expiry the watermark has passed leaves at once and pays for the next eviction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripletide.plans.spec import WindowSpec

ENTRY_STATE = "use_count bigint, arrival_us bigint, expire_us bigint"
PLACE_STATE = "epoch bigint, cursor bigint, held bigint, gone bigint"
FIRST = {"FEFO": 2, "LRU": 1, "LFU": 0}


class _KeyedWindow(StatefulProcessor):
    """``place`` has the step, the next graph's number, how many are held, and how many timers took out."""

    def __init__(self, key: str, size: int, evict: int, policy: str, timers: bool) -> None:
        self.key, self.size, self.evict, self.policy, self.timers = key, size, evict, policy, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "graph_no bigint", ENTRY_STATE)
        self.waiting = handle.getMapState("waiting", "graph_no bigint", ENTRY_STATE)
        self.place = handle.getValueState("place", PLACE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = {}
        for pdf in rows:
            columns = (pdf[c] for c in ("graph_no", "use_count", "arrival_us", "expire_us"))
            fresh.update({int(g): (int(u), int(a), int(e)) for g, u, a, e in zip(*columns)})
        yield self._left(key, self._advance(fresh))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (epoch, cursor, held, gone) = expiredTimerInfo.getExpiryTimeInMs(), self.place.get()
        over = [k[0] for k, v in self.held.iterator() if -(-v[2] // 1000) <= now]
        for g in over:
            self.held.removeKey((g,))
        self.place.update((epoch, cursor, held - len(over), gone + len(over)))
        yield self._left(key, [(epoch, g, "expired") for g in over] + self._advance({}))

    def _advance(self, fresh: dict[int, tuple]) -> list[tuple]:
        """Takes in what has room, and steps while the window is full and its refills are there."""
        epoch, cursor, n_held, gone = self.place.get() if self.place.exists() else (0, 0, 0, 0)
        held: dict[int, tuple] = {}
        before: set[int] | None = None
        out = []

        def take(n: int) -> None:
            nonlocal cursor, n_held
            for _ in range(n):
                entry = fresh.pop(cursor, None)
                if entry is None:
                    entry = self.waiting.getValue((cursor,)) if self.waiting.containsKey((cursor,)) else None
                    if entry is None:
                        return
                    self.waiting.removeKey((cursor,))
                held[cursor] = tuple(entry)
                cursor, n_held = cursor + 1, n_held + 1

        def there(n: int) -> bool:
            return all(g in fresh or self.waiting.containsKey((g,)) for g in range(cursor, cursor + n))

        take(self.size - n_held)
        while n_held == self.size:
            if before is None:
                stored = {k[0]: tuple(v) for k, v in self.held.iterator()}
                before, held = set(stored), stored | held
            now = max(a for _, a, _ in held.values())
            over = [g for g, (_, _, e) in held.items() if e < now]
            if not there(len(over)):
                break
            for g in over:
                del held[g]
            n_held -= len(over)
            take(len(over))
            k = self.size if self.evict == self.size else max(0, self.evict - len(over) - gone)
            evicted = sorted(held, key=lambda g: (held[g][FIRST[self.policy]], g))[:k]
            for g in evicted:
                del held[g]
            n_held -= len(evicted)
            out += [(epoch, g, "expired") for g in over] + [(epoch, g, "evicted") for g in evicted]
            epoch, gone = epoch + 1, 0
            take(self.size - n_held)
        for g in (before or set()) - held.keys():
            self.held.removeKey((g,))
        for g in held.keys() - (before or set()):
            self.held.updateValue((g,), held[g])
            if self.timers:
                self.handle.registerTimer(-(-held[g][2] // 1000))
        for g, entry in fresh.items():
            self.waiting.updateValue((g,), entry)
        self.place.update((epoch, cursor, n_held, gone))
        return out

    def _left(self, key, rows: list[tuple]) -> pd.DataFrame:
        result = pd.DataFrame(rows, columns=["epoch", "graph_no", "cause"])
        result.insert(0, self.key, key[0])
        return result

    def close(self) -> None:
        pass


def keyed_policy_window(stream: DataFrame, key: str, spec: WindowSpec, timers: bool = False) -> DataFrame:
    """(key, epoch, graph_no, cause): every graph as it leaves its window, expired or evicted.

    With ``timers``, ``stream`` carries a watermark on ``arrival_ts``. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    key_type = dict(stream.dtypes)[key]
    timed = stream.select(
        key, "graph_no", "use_count", *(["arrival_ts"] if timers else []),
        F.unix_micros(F.col("arrival_ts").cast("timestamp")).alias("arrival_us"),
        F.unix_micros(F.col("expire_ts").cast("timestamp")).alias("expire_us"),
    )
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_KeyedWindow(key, spec.size, spec.evict, spec.policy, timers),
        outputStructType=f"{key} {key_type}, epoch bigint, graph_no bigint, cause string",
        outputMode="Append",
        timeMode="EventTime" if timers else "None",
    )
