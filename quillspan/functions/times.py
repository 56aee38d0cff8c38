"""Times of transcripts: tolerant reading, ISO output and durations, all in UTC whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import iso

# Numbers above this are milliseconds, others seconds.
MILLISECONDS_FROM = 1e11
_ISO = r"^(\d{4}-?\d{2}-?\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def instant(text: Column) -> Column:
    """A timestamp without zone, in UTC, of an ISO 8601 text or of a number of seconds or milliseconds since 1970.

    Times without a zone are UTC. Null, blank and other texts, and impossible dates, are null.
    """
    t = F.trim(text.cast("string"))
    part = lambda k: F.nullif(F.regexp_extract(t, _ISO, k), F.lit(""))
    day = F.regexp_replace(F.replace(part(1), F.lit("-"), F.lit("")), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    two = lambda k: F.coalesce(part(k), F.lit("00"))
    fraction = F.rpad(F.substring(F.coalesce(part(5), F.lit("0")), 1, 6), 6, "0")
    wall = F.concat(day, F.lit(" "), two(2), F.lit(":"), two(3), F.lit(":"), two(4), F.lit("."), fraction).try_cast("timestamp_ntz")
    zone = F.replace(F.coalesce(F.nullif(part(6), F.lit("Z")), F.lit("+0000")), F.lit(":"), F.lit(""))
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    minutes = sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.coalesce(F.nullif(F.substring(zone, 4, 2), F.lit("")).cast("int"), F.lit(0)))
    zero = F.lit(0)
    dated = wall - F.make_dt_interval(zero, zero, minutes, F.lit(0).cast("decimal(18,6)"))
    number = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    seconds = F.when(number > MILLISECONDS_FROM, number / 1000.0).otherwise(number)
    # Years 1 to 9999 only.
    seconds = F.when(seconds.between(-62135596800.0, 253402300799.0), seconds).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(t.rlike(_ISO), dated).otherwise(epoch + F.make_dt_interval(zero, zero, zero, seconds))


def iso_instant(text: Column) -> Column:
    """instant() as ISO 8601 text."""
    return iso(instant(text))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one text to another, to milliseconds; null if one can't be read or the end comes first."""
    micros = F.timestamp_diff("MICROSECOND", instant(start), instant(end))
    return F.when(micros >= 0, F.round(micros / 1e6, 3))


def duration_ms(number: Column, secs: Column, nanos: Column) -> Column:
    """Whole milliseconds: of a number as it stands, else of seconds and nanoseconds; null without either."""
    return F.coalesce(number.cast("long"), (secs * 1000 + F.coalesce(nanos, F.lit(0)) / 1e6).cast("long"))
