"""Rate limits in event time: any order of arrival gives the verdicts of the batch operators."""

import datetime as dt
import random
import uuid

import pytest

from ragloom.operators.admitted import moving_window_admitted
from ragloom.operators.traffic import fixed_window_limit
from ragloom.session import scratch_path
from ragloom.streaming import jobs, limiter

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


def requests(seed, n=240):
    r = random.Random(seed)
    span = 600
    return [(k, START + dt.timedelta(seconds=r.randint(0, span), microseconds=r.choice([0, 1, 999_999])), r.choice([1, 1, 2, None]), "a") for k in range(n)]


def verdicts(spark, job, files, **options):
    base = scratch_path(spark, f"limiter-{uuid.uuid4().hex}")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/d={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/d=*")
    out = job(stream, 60, watermark="5 minutes", **options)
    jobs.run_available(out.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint")
    return spark.read.schema("event_id long, allowed boolean, late boolean").parquet(f"{base}/out").collect()


BEAT = [(None, START + dt.timedelta(days=2), None, None)]


@pytest.mark.parametrize("limit", [1, 3])
def test_out_of_order_arrival_equals_the_batch_operators(spark, limit):
    rows = requests(limit)
    arrival = sorted(rows, key=lambda x: x[1] + dt.timedelta(seconds=random.Random(x[0]).randint(0, 290)))
    files = [arrival[:80], arrival[80:160], arrival[160:]]
    batch = spark.createDataFrame(rows, SCHEMA)
    for job, want in ((limiter.fixed_window_verdicts, fixed_window_limit(batch, limit, 60)),
                      (limiter.moving_window_verdicts, moving_window_admitted(batch, 60, limit))):
        got = verdicts(spark, job, [*files, BEAT], limit=limit)
        assert not any(r["late"] for r in got)
        assert {r["event_id"]: r["allowed"] for r in got} == {r["event_id"]: r["allowed"] for r in want.collect()}
        assert len(got) == len(rows)


def test_late_requests_are_returned_and_not_counted(spark):
    first = [(1, START + dt.timedelta(seconds=5), 1, "a"), (2, START + dt.timedelta(minutes=20), 1, "a")]
    late = [(3, START + dt.timedelta(seconds=1), 1, "a"), (4, START + dt.timedelta(minutes=20, seconds=1), 1, "a"), (5, None, 1, "a")]
    for job in (limiter.fixed_window_verdicts, limiter.moving_window_verdicts):
        got = sorted(map(tuple, verdicts(spark, job, [first, late, BEAT], limit=1)))
        assert got == [(1, True, False), (2, True, False), (3, None, True), (4, False, False)]


def test_state_of_a_window_is_its_earliest_requests():
    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, ms):
            self.timer = ms

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0
    import pandas as pd
    p = limiter.FixedWindow(60_000_000, 2)
    p.init(Handle())
    chunks = (pd.DataFrame({"req_us": [100 - k, 500], "req_id": [k, 1000 + k], "beat": [False, False]}) for k in range(50))
    refused = [i for out in p.handleInputRows((1, 0), chunks, Clock()) for i in out["event_id"]]
    assert p.first.value == ([51, 52], [49, 48]) and len(refused) == 98 and p.handle.timer == 60_000


def test_a_group_costs_no_frame_and_no_state_call_it_does_not_need():
    import pandas as pd

    class State:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, v):
            self.calls.append("update")
            self.value = v

        def clear(self):
            self.calls.append("clear")
            self.value = None

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, ms):
            pass

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0
    p = limiter.FixedWindow(60_000_000, 2)
    p.init(Handle())
    rows = iter([pd.DataFrame({"req_us": [1], "req_id": [9], "beat": [False]})])
    assert list(p.handleInputRows((1, 0), rows, Clock())) == []  # an empty frame before
    assert [i for out in p.handleExpiredTimer((1, 0), None, None) for i in out["event_id"]] == [9]
    assert list(p.handleExpiredTimer((1, 0), None, None)) == []
    assert State.calls == ["get", "update", "get", "clear", "get"]


def test_a_bucket_of_keys_costs_one_entry_a_slice_and_batch():
    import numpy as np
    import pandas as pd

    class State:
        def __init__(self, calls, value=None):
            self.calls, self.value = calls, value

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, v):
            self.calls.append("update")
            self.value = v

        def clear(self):
            self.calls.append("clear")
            self.value = None

    class Map:
        def __init__(self, calls):
            self.calls, self.held = calls, {}

        def getValue(self, k):
            self.calls.append("getValue")
            return self.held[k]

        def updateValue(self, k, v):
            self.calls.append("updateValue")
            self.held[k] = v

        def removeKey(self, k):
            self.calls.append("removeKey")
            del self.held[k]

    class Handle:
        def __init__(self):
            self.calls, self.timers = [], []

        def getValueState(self, *_):
            return State(self.calls)

        def getMapState(self, *_):
            return Map(self.calls)

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    class Timer:
        def getExpiryTimeInMs(self):
            return 15_000
    handle = Handle()
    p = limiter.MovingWindow(60_000_000, 1, 15_000_000)
    p.init(handle)
    n = 1000  # keys, two requests each; a few calls a key before
    rows = pd.DataFrame({"key": [f'{{"user_id":{k % n}}}' for k in range(2 * n)], "req_us": np.arange(2 * n), "req_id": np.arange(2 * n), "beat": False})
    assert list(p.handleInputRows((0,), iter([rows]), Clock())) == []
    out = pd.concat(p.handleExpiredTimer((0,), Clock(), Timer()))
    assert out["event_id"].tolist() == list(range(2 * n)) and out["allowed"].tolist() == [True] * n + [False] * n
    assert len(handle.calls) <= 10 and handle.timers == [15_000, 75_000] and not p.waiting.held


def test_a_fixed_window_of_many_keys_is_a_state_row_a_bucket(spark):
    n = 1500  # keys, two requests each; a group and a timer a key before
    rows = [(i, START + dt.timedelta(microseconds=i), i % n, "a") for i in range(2 * n)]
    base = scratch_path(spark, f"limiter-{uuid.uuid4().hex}")
    for k, part in enumerate((rows[n // 2:], rows[:n // 2], BEAT)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{base}/in/d={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/d=*")
    out = limiter.fixed_window_verdicts(stream, 60, 1, watermark="5 minutes")
    q = jobs.run_available(out.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint")
    steps = [s for p in q.recentProgress for s in p["stateOperators"]]
    assert 0 < max(s["numRowsUpdated"] for s in steps) <= 4 * limiter.BUCKETS and max(s["numRowsTotal"] for s in steps) <= 4 * limiter.BUCKETS
    got = {r["event_id"]: (r["allowed"], r["late"]) for r in spark.read.schema("event_id long, allowed boolean, late boolean").parquet(f"{base}/out").collect()}
    assert got == {i: (i < n, False) for i in range(2 * n)}


def test_a_group_a_key_gives_the_same_verdicts_as_buckets(spark):
    rows = requests(7)
    one, other = (sorted(map(tuple, verdicts(spark, limiter.fixed_window_verdicts, [rows[:120], rows[120:], BEAT], limit=2, buckets=b))) for b in (None, 3))
    assert one == other and len(one) == len(rows)


def test_state_of_a_bucket_is_the_earliest_requests_of_its_keys():
    import numpy as np
    import pandas as pd

    class State:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, v):
            self.calls.append("update")
            self.value = v

        def clear(self):
            self.calls.append("clear")
            self.value = None

    class Handle:
        timers = []

        def getValueState(self, *_):
            return State()

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    def frame(at, n=100):
        return pd.DataFrame({"key": [f'{{"user_id":{k}}}' for k in range(n)], "req_us": at, "req_id": np.arange(n) + 1000 * at, "beat": False})
    p = limiter.FixedWindowBucket(60_000_000, 2)
    p.init(Handle())
    refused = [i for calls in ([9, 8, 7], [6], [5]) for out in p.handleInputRows((3, 0), iter(map(frame, calls)), Clock(0)) for i in out["event_id"]]
    assert sorted(refused) == [k + 1000 * at for at in (7, 8, 9) for k in range(100)]
    assert State.calls == ["get", "update"] * 3 and Handle.timers == [60_000]
    assert sorted(i for out in p.handleExpiredTimer((3, 0), None, None) for i in out["event_id"]) == [k + 1000 * at for at in (5, 6) for k in range(100)]
    assert p.first.value is None and list(p.handleExpiredTimer((3, 0), None, None)) == []
    beats = frame(1).assign(beat=True)
    assert list(p.handleInputRows((3, 0), iter([beats]), Clock(0))) == [] and p.first.value is None
    late = list(p.handleInputRows((3, 0), iter([frame(1)]), Clock(60_001)))
    assert len(late) == 1 and late[0]["late"].all() and late[0]["allowed"].isna().all() and len(late[0]) == 100
    none = limiter.FixedWindowBucket(60_000_000, 0)
    none.init(Handle())
    assert len(pd.concat(none.handleInputRows((3, 0), iter([frame(1)]), Clock(0)))) == 100 and none.first.value is None and Handle.timers == [60_000]
