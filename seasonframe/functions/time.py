"""Date helpers. The run time is always a parameter, so a rerun gives the same answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_of_date(day: Column) -> Column:
    """Season a date belongs to: January and February still count to the year before."""
    return (F.year(day) - F.when(F.month(day) <= 2, 1).otherwise(0)).cast("int")


def snapshot_date_of(file_name: Column) -> Column:
    """Date inside ``snapshot-YYYY-MM-DD.json``; NULL when the name does not parse."""
    text = F.regexp_extract(file_name, r"snapshot-(\d{4}-\d{2}-\d{2})\.json", 1)
    return text.try_cast("date")


def age_days(run_time: Column, day: Column) -> Column:
    """Fractional days from midnight UTC of ``day`` to ``run_time``; NULL for an unknown day."""
    midnight = F.unix_date(day).cast("long") * F.lit(86400000)
    return (F.unix_millis(run_time.cast("timestamp")) - midnight) / F.lit(86400000.0)
