"""Moving-window limit that counts admitted requests only (W10), in batch.

A request is admitted if fewer than ``limit`` admitted requests of its key
lie in the window before it. That is a recursion along the key's time line,
and all that it remembers is the last ``limit`` admitted instants.

Requests are sorted once, by range of (key, instant), into pieces of bounded
size. A walk over a piece goes from one admitted request to the next by
binary search. Keys that begin in a piece are walked at once, all pieces side
by side. A key that goes on in further pieces is walked there in rounds: the
second piece of every such key, then the third, each from the instants that
the piece before left. Every round reads only its own pieces, so all rounds
together read a request once.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timex import micros
from ..session import scratch_path
from .traffic import MICROS

#: Requests of a piece, about; small tables are cut into a piece a task slot.
PIECE_ROWS = 500_000


def _step(at: list[int], start: int, stop: int, last: list[int], width: int, limit: int) -> list[int]:
    """Positions in [start, stop) of one key's ordered instants that are admitted; ``last`` (admitted before, in order) goes on."""
    out, i = [], start
    while i < stop:
        if len(last) >= limit:
            i = bisect_left(at, last[-limit] + width, i, stop)
            if i == stop:
                break
        out.append(i)
        last.append(at[i])
        del last[:-limit]
        i += 1
    return out


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null is a value."""
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    other = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _walk(keys: list[str], width: int, limit: int):
    """Admitted rows of a sorted piece, every key from its first request."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k) for k in keys]
            new = np.any([_changes(c) for c in cols], axis=0)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            at, found = b.column("_t").to_pylist(), []
            if held != tuple(c[0].as_py() for c in cols):
                last = []
            for start, stop in zip(starts, [*starts[1:], len(at)]):
                if start:
                    last = []
                found += _step(at, start, stop, last, width, limit)
            held = tuple(c[len(at) - 1].as_py() for c in cols)
            yield b.take(pa.array(found, pa.int64()))
    return walk


def _spans(pieces: DataFrame, keys: list[str]) -> list[tuple]:
    """(piece, key, round) of the keys that a piece goes on with; one row a piece at most."""
    piece = F.shiftright("_o", 33).alias("_piece")
    ends = pieces.groupBy(piece).agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"))
    ends = ends.select("_piece", F.explode(F.array("lo", "hi")).alias("_end"))
    found = pieces.select(F.col("_o").alias("_end"), *keys).join(F.broadcast(ends.distinct()), "_end")  # two rows a piece at most
    keys_at = {}
    for r in sorted(found.collect(), key=lambda r: r["_end"]):
        keys_at.setdefault(r["_piece"], []).append(tuple(r[k] for k in keys))
    spans, before, turn = [], None, 0
    for at, own in keys_at.items():
        if own[0] == before:
            turn += 1
            spans.append((at, *own[0], turn))
        if own[-1] != before:
            before, turn = own[-1], 0
    return spans


def moving_window_admitted(req: DataFrame, width_seconds: int, limit: int, key_cols=("user_id", "event_type"),
                           ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """W10 (admitted requests only): adds ``allowed``, true for the requests that pass.

    Requests of a key are taken in the order of (instant, id); rows with equal
    ids are requests of their own. Null keys are a key like any other; a
    request without an instant has no verdict (null). ``limit`` 0 admits none.
    Other columns stay. No requests: none. Keys are told apart by the text of
    their columns.

    A key that holds a third of all requests is cut into pieces like any other
    rows; a task holds a piece at most, and the driver the keys at the ends of
    pieces and their last ``limit`` admitted instants.
    """
    spark, width = req.sparkSession, width_seconds * MICROS
    rows = req.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    if limit < 1:
        return rows.withColumn("allowed", F.when(F.col(ts).isNotNull(), F.lit(False))).drop("_row")
    keys = [f"_k{i}" for i in range(len(key_cols))]
    base = rows.select("_row", *[F.col(c).cast("string").alias(k) for c, k in zip(key_cols, keys)], F.col(id_col).alias("_id"), micros(ts).alias("_t"))
    order = [*keys, "_t", "_id", "_row"]
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PIECE_ROWS))
    # _o: place in the order, with the number of the piece in its upper bits
    pieces = (base.where("_t is not null").repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select("_row", *keys, "_t").withColumn("_o", F.monotonically_increasing_id()).checkpoint(eager=True))
    spans = _spans(pieces, keys)
    schema, named = pieces.schema, "".join(f", _s{i} string" for i in range(len(keys)))
    going = spark.createDataFrame(spans, f"_piece long{named}, _round long")
    own = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)])
    same = (F.shiftright("_o", 33) == F.col("_piece")) & own
    found = [pieces.join(F.broadcast(going), same, "left_anti").mapInArrow(_walk(keys, width, limit), schema).checkpoint(eager=True)]
    if spans:
        path = scratch_path(spark, f"admitted-{uuid.uuid4().hex}")
        pieces.join(F.broadcast(going), same).select(*schema.names, "_round").write.partitionBy("_round").parquet(path)
        hot = spark.createDataFrame(list({s[1:-1] for s in spans}), named[2:])
        last: dict[tuple, list[int]] = {}

        def left(walked: DataFrame) -> None:
            """Take over the last instants that the pieces just walked admitted of the keys that go on."""
            w = Window.partitionBy(*keys).orderBy(F.col("_o").desc())
            tail = walked.join(F.broadcast(hot), own, "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
            for r in sorted(tail.collect(), key=lambda r: r["_o"]):  # limit rows a key that goes on
                key = tuple(r[k] for k in keys)
                last[key] = [*last.get(key, []), r["_t"]][-limit:]

        for turn in range(1, max(s[-1] for s in spans) + 1):
            left(found[-1])
            carried = dict(last)

            def go_on(key: tuple, piece: pd.DataFrame) -> pd.DataFrame:
                piece = piece.sort_values("_o")
                key = tuple(None if pd.isna(k) else k for k in key)
                at = piece["_t"].tolist()
                return piece.iloc[_step(at, 0, len(at), list(carried.get(key, [])), width, limit)]

            own_pieces = spark.read.schema(schema).parquet(f"{path}/_round={turn}")
            found.append(own_pieces.groupBy(*keys).applyInPandas(go_on, schema).checkpoint(eager=True))
    passed = found[0].select("_row")
    for more in found[1:]:
        passed = passed.unionByName(more.select("_row"))
    return (rows.join(passed.withColumn("_in", F.lit(True)), "_row", "left")
            .withColumn("allowed", F.when(F.col(ts).isNotNull(), F.coalesce("_in", F.lit(False)))).drop("_row", "_in"))
