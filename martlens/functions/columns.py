"""Column builders shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_days(start, end) -> Column:
    """Whole days from start to end, floored (-1 for two hours backwards).

    timestampdiff(DAY) truncates toward zero and datediff counts midnights;
    neither matches a floored timedelta, so go through seconds.
    """
    secs = F.timestamp_diff("SECOND", _c(start), _c(end))
    return F.floor(secs / F.lit(86400)).cast("bigint")


def month_label(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def month_start(ts) -> Column:
    return F.trunc(_c(ts).cast("date"), "MM")



def md5_key(salt: str, *keys) -> Column:
    """md5 hex of salt and integer keys joined by '|' (null key -> empty text; same in DuckDB)."""
    parts = [F.lit(salt)] + [F.coalesce(_c(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def md5_unit(salt: str, *keys) -> Column:
    """Uniform [0,1) from the first 32 bits of md5(salt|keys): repartition-proof randomness."""
    h = F.conv(F.substring(md5_key(salt, *keys), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(4294967296.0)


def md5_int(salt: str, *keys) -> Column:
    return F.conv(F.substring(md5_key(salt, *keys), 1, 8), 16, 10).cast("bigint")


def money(c) -> Column:
    """Money with at most two decimals as an exact decimal, so sums do not depend on order."""
    return _c(c).cast("decimal(18,2)")



def ratio(num, den) -> Column:
    """num / den as double, null when den is 0 or null (ANSI mode would raise)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
