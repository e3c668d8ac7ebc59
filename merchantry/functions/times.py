"""Times (F50-F53). The present is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def hour_mark(c: Column) -> Column:
    """yyyyMMddhh with a 12-hour hour, as the marks of the shop feed are written."""
    return F.date_format(c.cast("timestamp"), "yyyyMMddhh")


def from_hour_mark(c: Column) -> Column:
    """The morning hour of a mark: whether it was afternoon is not in it. Null for anything else."""
    return F.try_to_timestamp(F.concat(c, F.lit(" AM")), F.lit("yyyyMMddhh a"))
