"""Keyed state over micro-batches: polite slots by host (L-04, A-11) and the breaker of a client (L-05)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of processors with timers is kept by this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PoliteSlots(StatefulProcessor):
    """When each host is free again. A refused request uses no slot. A host's state is dropped once the watermark has passed that moment: from then on it would change nothing."""

    def __init__(self, delay: float, max_wait: float):
        self._delay, self._max_wait = delay, max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._free = handle.getValueState("free", "free double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free = self._free.get()[0] if self._free.exists() else None
        before = free
        asked = pd.concat(list(rows)).sort_values(["at", "item"], kind="stable")
        out = []
        for item, at, own in zip(asked["item"], asked["at"], asked["delay"], strict=True):
            seconds = at.timestamp()
            wait = 0.0 if free is None else max(0.0, free - seconds)
            granted = wait <= self._max_wait
            if granted:
                free = seconds + wait + max(self._delay, 0.0 if pd.isna(own) else own)
            out.append((key[0], item, at, granted, wait))
        if free is not None and free != before:
            for timer in self._handle.listTimers():
                self._handle.deleteTimer(timer)
            self._free.update((free,))
            self._handle.registerTimer(int(free * 1000) + 1)
        yield pd.DataFrame(out, columns=["host", "item", "at", "granted", "wait"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._free.clear()
        return iter([])


def polite_slots(requests: DataFrame, delay: float = 1.0, max_wait: float = 30.0, late: str = "1 minute") -> DataFrame:
    """L-04, A-11: requests(host, item, at timestamp, delay) with `granted` and the seconds to `wait`: each gets the next free slot of its host unless that is over `max_wait` away.

    `delay` is the host's own (of `robots.permitted`, say) where it is longer, and may
    be null. Requests later than `late` are dropped by the watermark.
    """
    asked = requests.select("host", "item", "at", F.col("delay").cast("double")).withWatermark("at", late)
    return asked.groupBy("host").transformWithStateInPandas(PoliteSlots(delay, max_wait), "host string, item string, at timestamp, granted boolean, wait double", "append", "EventTime")


class Breaker(StatefulProcessor):
    """The run of unrecoverable failures of a client, and whether it opened the breaker. A client without a run has no state."""

    def __init__(self, limit: int):
        self._limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._run = handle.getValueState("run", "failures int, reason string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, reason = self._run.get() if self._run.exists() else (0, None)
        calls = pd.concat(list(rows)).sort_values("at", kind="stable")
        out = []
        for at, ok, hard, error in zip(calls["at"], calls["ok"], calls["hard"], calls["error"], strict=True):
            if reason is None:
                failures = failures + 1 if not ok and hard else failures if ok else 0
                reason = f"disabled after {failures} failures in a row: {(error or '')[:200]}" if failures >= self._limit else None
            out.append((key[0], at, ok, error, reason is not None, reason))
        if failures or reason:
            self._run.update((failures, reason))
        elif self._run.exists():
            self._run.clear()
        yield pd.DataFrame(out, columns=["client", "at", "ok", "error", "disabled", "reason"])


def unrecoverable(error: Column, markers: tuple[str, ...]) -> Column:
    """Whether an error cannot be mended by trying again: it holds one of the markers."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def breaker_stream(calls: DataFrame, markers: tuple[str, ...], limit: int = 3) -> DataFrame:
    """L-05: calls(client, at, ok, error) with whether the client is `disabled` from then on, and why: `limit` unrecoverable failures in a row do it for good, a recoverable one ends the run, a success leaves it."""
    rows = calls.select("client", "at", "ok", "error", unrecoverable(F.col("error"), markers).alias("hard"))
    return rows.groupBy("client").transformWithStateInPandas(Breaker(limit), "client string, at timestamp, ok boolean, error string, disabled boolean, reason string", "append", "None")
