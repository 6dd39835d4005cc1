"""Time helpers that work on TIMESTAMP and TIMESTAMP_NTZ alike.

Request times are wall-clock instants; both types are read as NTZ so window
boundaries do not move with the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts) -> Column:
    """Microseconds since the epoch of a (NTZ or LTZ) timestamp column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c.cast("timestamp_ntz"))


def from_micros(us) -> Column:
    """TIMESTAMP_NTZ from microseconds since the epoch."""
    c = F.col(us) if isinstance(us, str) else us
    return F.timestamp_add("MICROSECOND", c, F.expr(EPOCH_NTZ))
