"""Date strings of many formats to ``yyyy-MM-dd HH:mm`` in the edition's zone.

Every format is parsed to an instant with an explicit offset and shifted with zone-less arithmetic, so the result does
not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions.fold import let

# Spark formats; the offset is always the last part.
_WITH_OFFSET = [
    "d MMM yyyy H:mm:ss xx",
    "yyyy-MM-dd'T'H:mm:ss xx",
    "yyyy-MM-dd'T'H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S] xx",
    "yyyy-MM-dd H:mm:ss xx",
    "yyyy/MM/dd H:mm:ss xx",
    "yyyy-MM-dd xx",
    "d MMM yyyy H:mm xx",
    "yyyy-MM-dd'T'H:mm xx",
    "yyyy-MM-dd H:mm xx",
]


def _zoned(seconds: Column) -> Column:
    """Epoch seconds to wall-clock text of the edition zone."""
    utc = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    local = F.convert_timezone(F.lit("UTC"), F.lit(fv.EDITION_ZONE), utc)
    return F.left(local.cast("string"), F.lit(16))


def from_epoch(value: Column) -> Column:
    """Numeric epoch in seconds, or in milliseconds above the fixed bound."""
    v = value.cast("double")
    seconds = F.when(v > fv.EPOCH_MS_ABOVE, F.floor(v / 1000)).otherwise(F.floor(v))
    return F.when(seconds.between(-62135596800, 253402300799), _zoned(seconds.cast("decimal(18,6)")))


def _normal_form(text: Column) -> Column:
    """Bring the offset to `` +hhmm``: weekday removed, named zones and missing zones read as UTC."""
    t = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"([0-9])\s*(?:[A-Za-z]{3,5}|Z)\z", "$1 +0000")
    t = F.regexp_replace(t, r"([0-9]:[0-9]{2}(?:\.[0-9]+)?)\s*([+-][0-9]{2}):?([0-9]{2})\z", "$1 $2$3")
    return F.when(t.rlike(r" [+-][0-9]{4}\z"), t).otherwise(F.concat(t, F.lit(" +0000")))


def normalize(text: Column) -> Column:
    """Epoch digits, mail-style, ISO and slash dates; anything else is returned unchanged, null and empty give ''."""
    return let(text, _normalize)


def _normalize(text: Column) -> Column:
    parsed = let(_normal_form(text), lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in _WITH_OFFSET]))
    digits = F.when(text.rlike(r"^[0-9]{1,18}\z"), from_epoch(text.try_cast("double")))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
        .otherwise(F.coalesce(digits, _zoned(F.unix_seconds(parsed).cast("decimal(18,6)")), text))
    )


def as_of_day(as_of: Column) -> Column:
    """Edition day text of an instant, in the edition zone."""
    return F.left(_zoned(F.unix_seconds(as_of).cast("decimal(18,6)")), F.lit(10))
