"""Scalar expressions on position reports. All are native columns; nulls stand for every missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the domain.
EARTH_RADIUS_M = 6_371_000.0
KNOTS_EXPLAIN = 1.943844
KNOTS_FALLBACK = 1.94384
HEADING_UNKNOWN = 511.0
SOG_LOW, SOG_HIGH = 0.0, 40.0
MAX_GAP_S = 3600
STD_FLOOR = 1e-8
THRESHOLD_FLOOR = 1e-9
CONTEXT_S = 3600
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Null for NaN and infinities."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def to_number(c: str | Column) -> Column:
    """A double, or null where the text is no number."""
    x = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def wrap_angle(a: str | Column, b: str | Column) -> Column:
    """Signed turn from a to b in [-180, 180)."""
    return F.pmod(col(b) - col(a) + 180.0, F.lit(360.0)) - 180.0


def turn(a: str | Column, b: str | Column, places: int = 6) -> Column:
    """wrap_angle rounded, and still in [-180, 180): what rounds to 180 is -180, whatever the last bit of the difference."""
    x = F.round(wrap_angle(a, b), places)
    return F.when(x >= 180.0, x - 360.0).otherwise(x)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2) - col(lon1))
    h = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) * F.sin(dl / 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def clip(c: str | Column, low: float, high: float) -> Column:
    """Bounded; a null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def implied_mps(dist: str | Column, dt: str | Column) -> Column:
    """Metres per second; null for a gap of 0."""
    return F.try_divide(col(dist), col(dt))


def implied_knots(dist: str | Column, dt: str | Column) -> Column:
    return implied_mps(dist, dt) * KNOTS_EXPLAIN


def implied_knots_or_zero(dist: str | Column, dt: str | Column) -> Column:
    """As the rules want it where a table has no implied speed: 0 for a gap of 0."""
    return F.coalesce(implied_mps(dist, dt) * KNOTS_FALLBACK, F.lit(0.0))


def course_or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def heading_or_zero(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.isNull() | (c == HEADING_UNKNOWN), 0.0).otherwise(c)


def blank_to_zero(c: str | Column) -> Column:
    """An absent or empty text is 0; other texts are numbers or null (the row is then rejected)."""
    c = col(c)
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(to_number(c))


def blank_only_to_zero(c: str | Column) -> Column:
    """As blank_to_zero, with texts of blanks only as 0 too."""
    c = col(c)
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(0.0)).otherwise(to_number(c))


def parse_time(c: str | Column) -> Column:
    """A timestamp from either of two formats, or null."""
    t = F.trim(col(c))
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS))


def strict_epoch(c: str | Column, fmt: str = TIME_FORMATS[1]) -> Column:
    """Seconds since the epoch of texts of one format; any other text is an error, a null stays null."""
    return F.unix_micros(F.to_timestamp(col(c), fmt)) / 1e6


def midpoint(a: str | Column, b: str | Column) -> Column:
    """The middle of an interval of numbers."""
    return col(a) + (col(b) - col(a)) / 2.0


def clock(seconds: str | Column) -> Column:
    """HH:MM of epoch seconds, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(F.floor(col(seconds))), "HH:mm")


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Seconds since the epoch of a column of numbers (taken as they are), timestamps or texts of either time format."""
    kind = df.schema[name].dataType.typeName()
    if kind not in ("string", "timestamp", "timestamp_ntz", "date"):
        return F.col(name)
    return F.unix_micros((parse_time(name) if kind == "string" else F.col(name)).cast("timestamp")) / 1e6


def ratio_to_threshold(value: str | Column, threshold: Column) -> Column:
    return F.coalesce(col(value), F.lit(0.0)) / F.greatest(threshold, F.lit(THRESHOLD_FLOOR))
