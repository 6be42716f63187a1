"""Dates as the memory of facts writes them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:\d{2})?)?$"


def parse_when(raw: Column, end_of_day: bool = False) -> Column:
    """A date or time, with an offset or in UTC, as a UTC timestamp; null if it is none. end_of_day: a bare date's end."""
    text = F.trim(raw)
    day, clock, seconds, zone = (F.regexp_extract(text, _DATE, k) for k in range(1, 5))
    bare = clock == ""
    stamp = F.concat(day, F.lit(" "), F.when(bare, F.lit("00:00")).otherwise(clock), F.lit(":"), F.when(seconds == "", F.lit("00")).otherwise(seconds))
    at = F.try_to_timestamp(F.when(text.rlike(_DATE), stamp), F.lit("yyyy-MM-dd HH:mm:ss"))
    minutes = F.when((zone == "") | (zone == "Z"), 0).otherwise(
        F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    ) * F.when(zone.startswith("-"), -1).otherwise(1)
    at = F.timestamp_seconds(F.unix_timestamp(at) - F.coalesce(minutes, F.lit(0)) * 60)
    return F.when(bare, F.timestamp_seconds(F.unix_timestamp(at) + 86400)).otherwise(at) if end_of_day else at


def show_when(at: Column) -> Column:
    midnight = F.date_format(at, "HH:mm:ss") == "00:00:00"
    return F.when(midnight, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))


def show_end(at: Column) -> Column:
    """An exclusive end; at midnight the day before is the last."""
    midnight = F.date_format(at, "HH:mm:ss") == "00:00:00"
    return F.when(midnight, F.concat(F.lit("through "), F.date_format(F.date_sub(F.to_date(at), 1), "yyyy-MM-dd"))).otherwise(
        F.concat(F.lit("until "), F.date_format(at, "yyyy-MM-dd HH:mm"))
    )
