"""Document dates (``D:YYYYMMDDHHmmSSOHH'mm'``) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every field after the year may be missing, with all that follow it.
PATTERN = r"^D:(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2}))?)?)?)?)?(?:([+\-Z])(?:(\d{2})(?:'(?:(\d{2})'?)?)?)?)?$"


def parse_date(value: Column) -> Column:
    """struct(ts timestamp_ntz in UTC, offset_seconds int); null for an invalid date."""
    part = lambda i, default: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(value, PATTERN, i), F.lit("")), F.lit("9999")).cast("int"), F.lit(default))
    sign = F.regexp_extract(value, PATTERN, 7)
    hour, minute = part(8, 0), part(9, 0)
    offset = (hour * 3600 + minute * 60) * F.when(sign == "-", -1).otherwise(1)
    local = F.try_make_timestamp_ntz(part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0).cast("decimal(8,6)"))
    good = value.rlike(PATTERN) & (hour <= 23) & (minute <= 59) & ~((sign == "Z") & (offset != 0)) & (part(6, 0) <= 59) & local.isNotNull()
    return F.when(good, F.struct((local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset.cast("decimal(18,6)"))).alias("ts"), offset.cast("int").alias("offset_seconds")))


def format_date(ts: Column) -> Column:
    """A UTC timestamp as a document date."""
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("Z"))
