"""Epoch seconds from ISO-8601 stamps; times without a zone are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(stamp: Column) -> Column:
    """Seconds since 1970, null where the stamp can't be read."""
    return F.unix_timestamp(F.try_to_timestamp(stamp))


def epoch_or_unknown(stamp: Column) -> Column:
    return F.coalesce(epoch(stamp), F.lit(0).cast("bigint"))


def moment(stamp: Column) -> Column:
    """As ``epoch``; a bare date stands for its midnight."""
    return epoch(F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(stamp, F.lit("T00:00:00Z"))).otherwise(stamp))


def closed(valid_to: Column, open_end: int) -> Column:
    """The end of a window for output: null while it is open."""
    return F.when(valid_to < open_end, valid_to)
