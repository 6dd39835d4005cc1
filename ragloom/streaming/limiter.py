"""Rate limits on a stream in event time (T2, T3), with ``transformWithState``.

A request's verdict is given when the watermark has passed the span of time
that decides it, so it does not depend on the order of arrival: it equals the
batch operators W9 and W10 (admitted requests only) over the same requests.

* Fixed windows: keys are dealt to buckets; the state of a (bucket, window)
  is the ``limit`` earliest requests of each of its keys. A request that is
  later than those is refused at once; the others are admitted by the timer of
  the window's end. State and memory do not grow with the requests of a
  window, only with its keys, and a busy key is as many groups as it has open
  windows.
* Moving windows: keys are dealt to buckets; a bucket's requests wait in a map
  state by slice of time, an entry for every micro-batch; the timer of a slice
  takes its requests in order. What stays is each key's last ``limit``
  admitted instants while they count.

Timers remove the state, which lives in RocksDB. Requests whose window or
slice was closed before they came are returned with ``late`` and no verdict.
A row with a null id is a heartbeat: it moves the watermark and has no verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.timex import micros

MICROS = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that the keys of a window are dealt to; one bucket's slice, or its keys' earliest requests, are held in memory.
BUCKETS = 64
VERDICTS = "event_id long, allowed boolean, late boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need, unless the session names one."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _rows(ids, allowed, late) -> pd.DataFrame:
    n = len(ids)
    return pd.DataFrame({"event_id": pd.Series(ids, dtype="int64"), "allowed": pd.array([allowed] * n, dtype="boolean"),
                         "late": np.full(n, late, bool)})


def _staged(requests: DataFrame, key_cols, ts: str, id_col: str, watermark: str) -> DataFrame:
    """(key, req_us, req_id, beat).

    The watermark stays on a column of its own, so that late rows reach the
    processor and are counted there. The processor's batches do not take names
    that start with _, and a null in them makes integers doubles, so the key is
    the text of the key columns and what may be null is replaced and marked.
    """
    marked = requests.withColumn("_tl", F.col(ts).cast("timestamp")).withWatermark("_tl", watermark)
    us, i = micros(ts), F.col(id_col).cast("long")
    # a filter on nulls would be pushed below the watermark, which then would not see heartbeats
    return marked.select(F.to_json(F.struct(*key_cols)).alias("key"), F.coalesce(us, F.lit(0)).alias("req_us"),
                         F.coalesce(i, F.lit(0)).alias("req_id"), (us.isNull() | i.isNull()).alias("beat"))


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))


def _requests(rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Instants and ids of a group's batches, heartbeats left out."""
    for b in rows:
        real = ~b["beat"].to_numpy(bool)
        if real.any():
            yield b["req_us"].to_numpy(np.int64)[real], b["req_id"].to_numpy(np.int64)[real]


def _end_ms(end_us: int) -> int:
    """First millisecond at or after an instant."""
    return -(-end_us // 1000)


def _text_lines(keys) -> bytes:
    """Texts of keys are JSON, hence without a line break, and are packed as lines."""
    return "\n".join(keys).encode()


class FixedWindow(StatefulProcessor):
    """Group: (key, start of the window in microseconds last)."""

    def __init__(self, width_us: int, limit: int):
        self.width, self.limit = width_us, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "us array<bigint>, ids array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = _end_ms(int(key[-1]) + self.width)
        if end < timerValues.getCurrentWatermarkInMs():
            for _, ids in _requests(rows):
                yield _rows(ids, None, True)
            return
        held = self.first.get()  # None if there is none: every call to the state is a round trip
        us, ids = (np.array(x, np.int64) for x in (held or ([], [])))
        for more_us, more_ids in _requests(rows):  # what is over the limit already cannot pass any more
            us, ids = np.concatenate([us, more_us]), np.concatenate([ids, more_ids])
            order = np.lexsort((ids, us))
            if len(order) > self.limit:
                yield _rows(ids[order[self.limit:]], False, False)
            us, ids = us[order[:self.limit]], ids[order[:self.limit]]
        if held is None and len(us):
            self.handle.registerTimer(end)
        if len(us):
            self.first.update((us.tolist(), ids.tolist()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.first.get()
        if held is not None:
            yield _rows(held[1], True, False)
            self.first.clear()

    def close(self) -> None:
        pass


class FixedWindowBucket(StatefulProcessor):
    """Group: (bucket of keys, start of the window in microseconds last).

    A group is a start of its own and several round trips to the state, so the
    earliest requests of all keys of a bucket are one packed value.
    """

    def __init__(self, width_us: int, limit: int):
        self.width, self.limit = width_us, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "keys binary, us binary, ids binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = _end_ms(int(key[-1]) + self.width)
        if end < timerValues.getCurrentWatermarkInMs():
            for _, ids in _requests(rows):
                yield _rows(ids, None, True)
            return
        held, changed = None, False
        us = ids = keys = None
        for b in rows:
            b = b[~b["beat"].to_numpy(bool)]
            if b.empty:
                continue
            more = b["key"].to_numpy(object), b["req_us"].to_numpy(np.int64), b["req_id"].to_numpy(np.int64)
            if not changed:
                held, changed = self.first.get(), True
                if held:
                    keys = np.array(bytes(held[0]).decode().split("\n"), object)
                    us, ids = (np.frombuffer(bytes(x), np.int64) for x in held[1:])
            keys, us, ids = more if keys is None else (np.concatenate(x) for x in zip((keys, us, ids), more))
            of = pd.factorize(keys)[0]
            order = np.lexsort((ids, us, of))
            of = of[order]
            start = np.flatnonzero(np.diff(of, prepend=-1))  # of each key's run
            passes = np.arange(len(of)) - np.repeat(start, np.diff(start, append=len(of))) < self.limit
            if not passes.all():  # what is over the limit already cannot pass any more
                yield _rows(ids[order[~passes]], False, False)
            order = order[passes]
            keys, us, ids = keys[order], us[order], ids[order]
        if not changed or not len(us):
            return
        if held is None:
            self.handle.registerTimer(end)
        self.first.update((_text_lines(keys), us.tobytes(), ids.tobytes()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.first.get()
        if held is not None:
            yield _rows(np.frombuffer(bytes(held[2]), np.int64), True, False)
            self.first.clear()

    def close(self) -> None:
        pass


class MovingWindow(StatefulProcessor):
    """Group: a bucket of keys. Requests wait by slice and are judged in order when their slice is over.

    Every call to the state is a round trip, so a micro-batch adds one packed
    entry for a bucket's slice, however many keys it has.
    """

    def __init__(self, width_us: int, limit: int, slice_us: int):
        self.width, self.limit, self.slice = width_us, limit, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # open: slices that hold requests, with the number of their entries in waiting
        self.open = handle.getValueState("open", "slices array<bigint>, entries array<bigint>")
        self.waiting = handle.getMapState("waiting", "slice bigint, entry bigint", "keys binary, us binary, ids binary")
        self.admitted = handle.getValueState("admitted", "keys binary, us binary")

    def _opened(self) -> dict[int, int]:
        held = self.open.get()
        return dict(zip(*held)) if held else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, opened, changed = timerValues.getCurrentWatermarkInMs(), None, False
        for b in rows:
            b = b[~b["beat"].to_numpy(bool)]
            if b.empty:
                continue
            opened = self._opened() if opened is None else opened
            us, ids, keys = b["req_us"].to_numpy(np.int64), b["req_id"].to_numpy(np.int64), b["key"].to_numpy(object)
            at = us // self.slice
            order = np.argsort(at, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                s = int(at[own[0]])
                end = _end_ms((s + 1) * self.slice)
                if end < passed:
                    yield _rows(ids[own], None, True)
                    continue
                if s not in opened:
                    self.handle.registerTimer(end)
                entry = opened.get(s, 0)
                self.waiting.updateValue((s, entry), (_text_lines(keys[own]), us[own].tobytes(), ids[own].tobytes()))
                opened[s], changed = entry + 1, True
        if changed:
            self.open.update((list(opened), list(opened.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        s = end * 1000 // self.slice - 1  # slices are whole milliseconds long
        opened = self._opened()
        if s not in opened:
            if not opened:  # the timer set when nothing waited: no admitted request counts any more
                self.admitted.clear()
            return
        keys, parts = [], []
        for entry in range(opened.pop(s)):
            held = self.waiting.getValue((s, entry))
            self.waiting.removeKey((s, entry))
            keys += bytes(held[0]).decode().split("\n")
            parts.append([np.frombuffer(bytes(x), np.int64) for x in held[1:]])
        us, ids = (np.concatenate(x) for x in zip(*parts))
        held, last = self.admitted.get(), {}  # key: its admitted instants that still count, oldest first
        if held:
            for k, t in zip(bytes(held[0]).decode().split("\n"), np.frombuffer(bytes(held[1]), np.int64).tolist()):
                last.setdefault(k, []).append(t)
        order = np.lexsort((ids, us))
        allowed = []
        for i, t in zip(order.tolist(), us[order].tolist()):
            own = last.setdefault(keys[i], [])
            ok = len(own) < self.limit or t - own[-self.limit] >= self.width
            if ok and self.limit:
                own.append(t)
                del own[:-self.limit]
            allowed.append(ok)
        yield pd.DataFrame({"event_id": ids[order], "allowed": pd.array(allowed, dtype="boolean"), "late": False})
        self.open.update((list(opened), list(opened.values()))) if opened else self.open.clear()
        # what the next slices can still meet
        kept = [(k, t) for k, own in last.items() for t in own if t + self.width > end * 1000]
        if kept:
            self.admitted.update((_text_lines(k for k, _ in kept), np.array([t for _, t in kept], np.int64).tobytes()))
            if not opened:
                self.handle.registerTimer(_end_ms((max(t for _, t in kept) + self.width) // self.slice * self.slice + self.slice))
        else:
            self.admitted.clear()

    def close(self) -> None:
        pass


def fixed_window_verdicts(requests: DataFrame, width_seconds: int, limit: int, key_cols=("user_id", "event_type"), ts: str = "ts",
                          id_col: str = "event_id", watermark: str = "2 minutes", buckets: int | None = BUCKETS) -> DataFrame:
    """event_id, allowed, late; the first ``limit`` requests in time of every key and window pass.

    ``buckets`` is fixed for the life of a checkpoint; None makes every key a
    group of its own, as checkpoints from before there were buckets have it.
    """
    use_rocksdb(requests.sparkSession)
    width = width_seconds * MICROS
    rows = _staged(requests, key_cols, ts, id_col, watermark)
    rows = rows.withColumn("win", F.col("req_us") - F.pmod(F.col("req_us"), F.lit(width)))
    if buckets is None:
        return rows.groupBy("key", "win").transformWithStateInPandas(FixedWindow(width, limit), VERDICTS, "append", "eventTime")
    rows = _dealt(rows, buckets)
    return rows.groupBy("bucket", "win").transformWithStateInPandas(
        FixedWindowBucket(width, limit), VERDICTS, "append", "eventTime")


def moving_window_verdicts(requests: DataFrame, width_seconds: int, limit: int, key_cols=("user_id", "event_type"), ts: str = "ts",
                           id_col: str = "event_id", watermark: str = "2 minutes", slice_seconds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """event_id, allowed, late; a request passes if fewer than ``limit`` admitted ones lie in the window before it.

    ``slice_seconds`` (default: a quarter of the window, a second at least) is
    the longest a request waits beyond the watermark. ``buckets`` is fixed for
    the life of a checkpoint.
    """
    use_rocksdb(requests.sparkSession)
    step = (slice_seconds or max(1, width_seconds // 4)) * MICROS
    rows = _dealt(_staged(requests, key_cols, ts, id_col, watermark), buckets)
    return rows.groupBy("bucket").transformWithStateInPandas(MovingWindow(width_seconds * MICROS, limit, step), VERDICTS, "append", "eventTime")
