"""W10 counting admitted requests only: pointer doubling against a plain walk."""

import datetime as dt
import random
from bisect import bisect_right

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.operators.admitted import moving_window_admitted

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


def walk(rows, width, limit):
    """event positions that pass, request by request."""
    out, taken = [None] * len(rows), {}
    order = sorted((r[1], r[0], i) for i, r in enumerate(rows) if r[1] is not None)
    for t, _, i in order:
        acc = taken.setdefault(rows[i][2:4], [])
        out[i] = len(acc) - bisect_right(acc, t - dt.timedelta(seconds=width)) < limit
        if out[i]:
            acc.append(t)
    return out


def rows_of(seed, n, keys, span):
    r = random.Random(seed)
    return [(k, START + dt.timedelta(seconds=r.choice([r.randint(0, span), r.randint(0, span // 10)])), r.choice(keys), "a") for k in range(n)]


def run(spark, rows, width, limit):
    got = moving_window_admitted(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", at int").repartition(4), width, limit).collect()
    return [r["allowed"] for r in sorted(got, key=lambda r: r["at"])]


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_against_a_walk(spark, limit):
    rows = rows_of(limit, 400, [1, 1, 1, 2, 3, None], 3000)  # one key holds half of the rows; many equal instants
    assert run(spark, rows, 60, limit) == walk(rows, 60, limit)


def test_awkward_requests(spark):
    t = START
    rows = [(1, t, 1, "a"), (1, t, 1, "a"), (2, None, 1, "a"), (None, t, 1, "a"), (3, t + dt.timedelta(seconds=60), 1, None),
            (4, t + dt.timedelta(seconds=60), 1, "a"), (5, t + dt.timedelta(microseconds=59_999_999), 1, "a"), (6, t, None, None), (7, t, None, None)]
    got = run(spark, rows, 60, 1)
    assert got[2] is None and sum(g is True for g in got) == 4
    assert got[4] and got[5] and not got[6] and got[7] and not got[8]
    assert run(spark, rows, 60, 0) == [None if r[1] is None else False for r in rows]
    assert moving_window_admitted(spark.createDataFrame([], SCHEMA), 60, 2).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=40), st.integers(1, 12), st.integers(1, 4))
def test_doubling_rule_in_plain_python(times, width, limit):
    """far(c, 0) by doubled tables names exactly the requests that a walk admits."""
    times = sorted(times)
    n, end = len(times), 10 ** 9
    later = [next((y for y in range(n) if times[y] >= t + width), n) for t in times]

    def at(table, x, i):
        return table[x][i] if x < n else end
    table = [[max([x + c] + [(later[x + a] + c - limit - a) if x + a < n else end for a in range(c - limit + 1)]) for c in range(1, 2 * limit)]
             for x in range(n)]
    found, cost = {c: c for c in range(min(limit, n))}, limit
    while True:
        more = {}
        for c, x in found.items():
            for p in range(limit - 1, 2 * limit - 1):
                s = c + p + cost - limit + 1
                if s < 2 * cost:
                    more[s] = max(more.get(s, 0), at(table, x, p))
        more = {s: x for s, x in more.items() if x < n}
        if not more:
            break
        found |= more
        cost *= 2
        size = 2 * limit - 1
        table = [[max(at(table, table[x][p], i + limit - 1 - p) for p in range(size) if 0 <= i + limit - 1 - p < size) for i in range(size)]
                 for x in range(n)]
    acc = []
    for i, t in enumerate(times):
        if sum(times[a] > t - width for a in acc) < limit:
            acc.append(i)
    assert sorted(found.values()) == acc


@pytest.mark.parametrize("limit", [1, 3])
def test_keys_that_fill_several_pieces_are_walked_from_piece_to_piece(spark, monkeypatch, limit):
    from ragloom.operators import admitted
    monkeypatch.setattr(admitted, "PIECE_ROWS", 60)  # at least 20 pieces
    rows = rows_of(limit + 9, 1200, [1, 1, 1, 1, None, None, 2], 6000) + [(5000 + k, START, 3, "a") for k in range(200)]
    cut = []
    spans = admitted._spans
    monkeypatch.setattr(admitted, "_spans", lambda *a: cut.extend(spans(*a)) or list(cut))
    assert run(spark, rows, 60, limit) == walk(rows, 60, limit)
    assert max(s[-1] for s in cut) >= 3 and {s[1] for s in cut} >= {"1", None}
