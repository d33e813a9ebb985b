"""Timestamp text parsing and normal forms.

All parsers are ANSI-safe (``try_*``): bad text gives NULL, never an error.
Text without a zone is read as UTC whatever the session time zone is, and
``utc_wall_clock`` / ``utc_date`` turn instants into UTC wall-clock values,
so no result depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted ISO-8601 layouts, tried in this order. The first
# three carry a zone (``Z`` or an offset); the last two are naive (UTC).
ZONED_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
)
NAIVE_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
)
# The usual zoned text. A cast reads it alike and raises nothing inside, while every layout of the
# ladder that does not fit costs an exception a row.
USUAL_ISO_REGEX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$"
# Epoch-millisecond text: an optional minus sign and digits only.
EPOCH_MILLIS_REGEX = r"^-?[0-9]+$"
# Normal form of an event time on the wire: UTC, millisecond precision.
NORMAL_FORM = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_wall_clock(ts: Column | str) -> Column:
    """TIMESTAMP (an instant) -> TIMESTAMP_NTZ holding its UTC wall clock."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), _col(ts).cast("timestamp_ntz"))


def from_utc_wall_clock(ntz: Column | str) -> Column:
    """TIMESTAMP_NTZ read as UTC wall clock -> TIMESTAMP (instant)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), _col(ntz)).cast("timestamp")


def utc_date(ts: Column | str) -> Column:
    """Calendar date of an instant in UTC (T6 without session-zone drift)."""
    return F.to_date(utc_wall_clock(ts))


def parse_iso_timestamp(text: Column | str) -> Column:
    """ISO text -> TIMESTAMP, as ``iso_ladder`` reads it; the usual zoned text by a cast. Garbage -> NULL."""
    c = _col(text)
    return F.coalesce(F.when(c.rlike(USUAL_ISO_REGEX), c.try_cast("timestamp")), iso_ladder(c))


def iso_ladder(text: Column | str) -> Column:
    """Zoned layouts first, naive ones as UTC, then a lenient cast (zone kept when given, UTC otherwise)."""
    c = _col(text)
    zoned = [F.try_to_timestamp(c, F.lit(p)) for p in ZONED_PATTERNS]
    naive = [
        from_utc_wall_clock(F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz"))
        for p in NAIVE_PATTERNS
    ]
    # Lenient fallback: a cast honours an explicit zone; a naive text is
    # taken as UTC by casting to NTZ first.
    has_zone = c.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    lenient = F.when(has_zone, c.try_cast("timestamp")).otherwise(
        from_utc_wall_clock(c.try_cast("timestamp_ntz"))
    )
    return F.coalesce(*zoned, *naive, lenient)


def epoch_millis_to_timestamp(text: Column | str) -> Column:
    """Epoch-millisecond text or number -> TIMESTAMP (T4); out of range -> NULL."""
    millis = _col(text).try_cast("bigint")
    # timestamp_millis overflows beyond +-2^63 micros; keep the safe range.
    safe = F.when(millis.between(-9_223_372_036_854_775, 9_223_372_036_854_775), millis)
    return F.timestamp_millis(safe)


def timestamp_from_text(text: Column | str) -> Column:
    """Millis-or-ISO ladder (T1, T3): digits are epoch millis, else ISO."""
    c = _col(text)
    return F.when(c.rlike(EPOCH_MILLIS_REGEX), epoch_millis_to_timestamp(c)).otherwise(
        parse_iso_timestamp(c)
    )


def normalize_ts_text(ts: Column | str) -> Column:
    """Instant -> ``yyyy-MM-ddTHH:mm:ss.SSSZ`` in UTC, truncated to millis (V2)."""
    return F.date_format(utc_wall_clock(F.date_trunc("millisecond", _col(ts))), NORMAL_FORM)


def whole_seconds(ts: Column | str) -> Column:
    """Epoch seconds, truncated (T7); session-zone independent."""
    return F.unix_timestamp(_col(ts))
