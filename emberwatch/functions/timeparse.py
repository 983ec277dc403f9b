"""Event times as epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
BASIC = r"^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})(Z?)$"


def epoch(text: Column) -> Column:
    """Seconds since 1970 of a number (milliseconds if above 1e11) or an ISO 8601 text (UTC unless it says
    otherwise); null where it is neither, or a number outside (0, 4e10)."""
    own = F.trim(text)
    number = F.when(F.rlike(own, F.lit(NUMBER)), own.try_cast("double"))
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    iso = F.when(F.rlike(own, F.lit(BASIC)), F.regexp_replace(own, BASIC, "$1-$2-$3T$4:$5:$6$7")).when(F.rlike(own, F.lit(ISO)), own)
    iso = F.regexp_replace(iso, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    iso = F.regexp_replace(iso, r"(\.[0-9]{6})[0-9]+", "$1")
    moment = F.unix_micros(iso.try_cast("timestamp")) / 1e6
    return F.when(number.isNotNull(), F.when((seconds > 0) & (seconds < 4e10), seconds)).otherwise(moment)
