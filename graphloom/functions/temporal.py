"""Valid time: two nullable bounds, null is open, the upper bound is exclusive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM, _UNTIL = "valid_from", "valid_until"


def _at(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def valid_at(t: datetime) -> Column:
    start, end = F.col(_FROM), F.col(_UNTIL)
    return (start.isNull() | (start <= _at(t))) & (end.isNull() | (end > _at(t)))


def valid_within(a: datetime, b: datetime) -> Column:
    """The interval and [a, b) overlap."""
    start, end = F.col(_FROM), F.col(_UNTIL)
    return (start.isNull() | (start < _at(b))) & (end.isNull() | (end > _at(a)))


def valid_between(a: datetime, b: datetime) -> Column:
    """The interval has both bounds and lies in [a, b]."""
    start, end = F.col(_FROM), F.col(_UNTIL)
    return start.isNotNull() & end.isNotNull() & (start >= _at(a)) & (end <= _at(b))


TEMPORAL = {"valid_now": valid_at, "valid_at": valid_at, "valid_within": valid_within, "valid_between": valid_between}


def live(now: datetime, include_archived: bool = False) -> Column:
    """Rows that a ranked read may return: not expired, not archived unless asked for, no retired reflection."""
    out = (F.col("expires_at").isNull() | (F.col("expires_at") > _at(now))) & ((F.col("thought_type") != "REFLECTION") | (F.col("lifecycle_status") == "ACTIVE"))
    return out if include_archived else out & (F.col("lifecycle_status") != "ARCHIVED")
