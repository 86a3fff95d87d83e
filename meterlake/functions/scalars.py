"""Scalar helpers: guarded division, rounding, saturation, text patterns, time windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
QUOTA_PER_UNIT = 500_000
INT32_MAX, INT32_MIN = 2**31 - 1, -(2**31)
INT64_MAX, INT64_MIN = 2**63 - 1, -(2**63)
SAFE_INTEGER = 2**53 - 1


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero at some digits, as round(x * 10**d) / 10**d."""
    scale = float(10**digits)
    return F.round(x * scale) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0 or the quotient is not finite."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), F.lit(0.0)).otherwise(q)


def clamped(x: Column, low: int, high: int) -> Column:
    """struct(value long, kind): x clamped to [low, high]; kind is overflow, underflow, nan or null; NaN gives 0."""
    kind = F.when(F.isnan(x), "nan").when(x > high, "overflow").when(x < low, "underflow")
    value = F.when(F.isnan(x), F.lit(0)).when(x > high, F.lit(high)).when(x < low, F.lit(low)).otherwise(x.cast("bigint"))
    return F.struct(value.cast("bigint").alias("value"), kind.alias("kind"))


def quota_truncated(x: Column) -> Column:
    """Double to int32 quota toward zero, saturating."""
    toward_zero = F.signum(x) * F.floor(F.abs(x)).cast("double")
    return clamped(F.when(F.isnan(x) | (F.abs(x) > 1e18), x).otherwise(toward_zero), INT32_MIN, INT32_MAX)


def quota_rounded(x: Column) -> Column:
    """Double or decimal to int32 quota, half away from zero, saturating."""
    return clamped(F.round(x).cast("double"), INT32_MIN, INT32_MAX)


def wallet(x: Column) -> Column:
    """Double to wallet units within +-(2**53 - 1), half away from zero."""
    return clamped(F.round(x).cast("double"), -SAFE_INTEGER, SAFE_INTEGER)


def usd(quota: Column, unit: int = QUOTA_PER_UNIT) -> Column:
    """Quota in currency at 4 digits; tiny positive values show 0.0001."""
    x = rounded(quota.cast("double") / unit, 4)
    return F.when((quota > 0) & (x < 0.0001), F.lit(0.0001)).otherwise(x)


def text_match(column: str, value: str) -> Column:
    """Equality, or LIKE if the value has %; `_` and the escape character are literal. Bad patterns raise."""
    if "%" not in value:
        return F.col(column) == value
    check_pattern(value)
    escaped = value.replace("!", "!!").replace("_", "!_").replace("'", "\\'")
    return F.expr(f"`{column}` LIKE '{escaped}' ESCAPE '!'")


def check_pattern(value: str) -> None:
    """Rejects %%, more than two % and fewer than two other bytes."""
    if "%%" in value:
        raise ValueError("consecutive % are not allowed")
    if value.count("%") > 2:
        raise ValueError("at most two % are allowed")
    if len(value.replace("%", "").encode()) < 2:
        raise ValueError("at least two characters besides % are needed")


def csv_has(column: str, item: str) -> Column:
    """Whether a comma-separated list holds an item."""
    return F.coalesce(F.array_contains(F.split(F.col(column), ","), item), F.lit(False))


def stat_window(start: int, end: int, now: int, days: int = 30) -> tuple[int, int]:
    """Default window of statistics: 30 days before ``end`` if that is late enough, else before now."""
    span = days * 86_400
    if start > 0:
        return start, end
    return (end if end > span else now) - span, end


#: Length and bucket of each ranking period in seconds.
PERIODS = {"today": (86_400, 3_600), "week": (7 * 86_400, 86_400), "month": (30 * 86_400, 86_400), "year": (365 * 86_400, 7 * 86_400)}


def period_window(period: str, now: int) -> tuple[int, int, int, int, int]:
    """(start, end, previous start, previous end, bucket) of a ranking period that ends now."""
    length, bucket = PERIODS[period]
    start = now - length
    return start, now, start - length, start - 1, bucket


def health_window(now: int, hours: int = 24) -> tuple[int, int]:
    """Whole hours up to now: (start of the first hour, now); 1 to 720 hours."""
    hours = min(720, hours if hours > 0 else 24)
    return now - now % 3_600 - (hours - 1) * 3_600, now


def status_ranges(text: str) -> list[tuple[int, int]]:
    """`401,500-503` to sorted ranges; a full-width comma separates too; a bad token raises."""
    found = []
    for token in text.replace("，", ",").split(","):
        token = token.strip()
        if not token:
            continue
        ends = [t.strip() for t in token.split("-")]
        if len(ends) > 2 or not all(t.isdigit() for t in ends):
            raise ValueError(f"bad status range: {token}")
        low, high = int(ends[0]), int(ends[-1])
        if low > high or low < 100 or high > 599:
            raise ValueError(f"bad status range: {token}")
        found.append((low, high))
    return sorted(found)


def retriable(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a status code is in a range; outside 100-599 never, 504 and 524 never."""
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | code.between(low, high)
    return F.coalesce(code.between(100, 599) & ~code.isin(504, 524) & hit, F.lit(False))
