"""Time expressions; epoch seconds are BIGINT, the session zone is UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ts(sec) -> Column:
    return F.timestamp_seconds(_c(sec))


def age_days(sec, as_of: int) -> Column:
    """Whole days between ``sec`` and ``as_of``, truncated toward zero."""
    return ((F.lit(as_of) - _c(sec)) / F.lit(DAY)).cast("bigint")


def on_this_day(sec, as_of: int) -> Column:
    """Same day of the year in another year; unset dates never match."""
    now = F.timestamp_seconds(F.lit(as_of))
    then = ts(sec)
    return ((_c(sec) > 0) & (F.dayofyear(then) == F.dayofyear(now))
            & (F.year(then) != F.year(now)))


def epoch_ms(col) -> Column:
    return F.unix_millis(_c(col).cast("timestamp"))
