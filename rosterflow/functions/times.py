"""Times of records: from the texts and numbers that sources send, and back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# From this number on an epoch counts milliseconds, below it seconds.
_LEAST_EPOCH_MILLIS = 100_000_000_000


def parse_time(text: Column) -> Column:
    """UTC time of an ISO text, with or without zone and fraction, or of an epoch number; null if it is neither."""
    is_number = text.rlike(r"^-?[0-9]+(\.[0-9]+)?(?i:e\+?[0-9]+)?$")
    number = F.when(is_number, text.cast("decimal(38,6)"))
    millis = F.when(F.abs(number) >= _LEAST_EPOCH_MILLIS, number).otherwise(number * 1000)
    has_zone = text.rlike(r"(?i)[0-9](z|[+-][0-9]{2}:?([0-9]{2})?)$") & text.contains(":")
    zoned = F.convert_timezone(None, F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(millis / 1000).cast("decimal(18,6)"))
    return F.when(is_number, epoch).when(has_zone, zoned).otherwise(text.try_cast("timestamp_ntz"))


def instant_text(ts: Column) -> Column:
    """UTC time with as many digits of the second as it has: none, three or six."""
    micros = F.date_format(ts, "SSSSSS")
    second = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(micros == "000000", F.lit("")).when(
        micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(second, fraction, F.lit("Z"))
