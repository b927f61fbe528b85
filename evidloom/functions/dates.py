"""Column functions on dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_date(c: Column) -> Column:
    """Seconds or milliseconds since 1970, or one of five written forms, as a UTC timestamp; else null."""
    s = F.trim(c.cast("string"))
    n = s.try_cast("double")
    epoch = F.timestamp_seconds(F.when(n > 1e10, n / 1000).otherwise(n))
    forms = [F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "d MMMM yyyy")]
    return F.when(s.rlike(r"^[0-9]{9,13}(\.[0-9]+)?$"), epoch).otherwise(F.coalesce(*forms))


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def quarter(c: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(c))


def quarter_number(c: Column) -> Column:
    """1 to 4 from texts such as ``Q3`` or ``3rd quarter``."""
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(F.lower(c), r"q\s*([1-4])", 1), F.lit("")), F.regexp_extract(F.lower(c), r"([1-4])\s*(?:st|nd|rd|th)?\s*quarter", 1)), F.lit("")).cast("int")


def age_days(c: Column, now: Column) -> Column:
    return F.datediff(now, c)


def seconds_between(a: Column, b: Column) -> Column:
    """Never negative; null where either is."""
    return F.greatest(F.lit(0.0), b.cast("timestamp").cast("double") - a.cast("timestamp").cast("double")) + F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(0.0)
