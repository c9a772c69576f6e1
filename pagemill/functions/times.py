"""Points in time, always UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(now: datetime | Column) -> Column:
    """A literal point in time without a zone, whatever zone Python runs in."""
    if isinstance(now, Column):
        return now
    if now.tzinfo is not None:
        now = now.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))
