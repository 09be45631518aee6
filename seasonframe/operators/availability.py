"""Availability measures from a weekly status array. Narrow: no shuffle.

Functions take the name of the array column and return SQL expressions over it. Lambda
variables end in an underscore, so that they cannot hide a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.constants import ABSENCE_CAUSE, DNP, PLAYED, WEEKS
from seasonframe.schemas import AVAILABILITY, SEGMENTS


def _first(status: str) -> str:
    return f"CAST(nullif(array_position({status}, '{PLAYED}'), 0) AS INT)"


def _last(status: str) -> str:
    from_end = f"nullif(array_position(reverse({status}), '{PLAYED}'), 0)"
    return f"CAST(size({status}) + 1 - {from_end} AS INT)"


def _segments(status: str) -> str:
    first, last = _first(status), _last(status)
    inside = f"CASE WHEN {first} IS NOT NULL THEN sequence({first}, {last}) ELSE CAST(array() AS ARRAY<INT>) END"
    missed = f"filter({inside}, wk_ -> get({status}, wk_ - 1) = '{DNP}')"
    starts = f"filter({missed}, wk_ -> get({status}, wk_ - 2) != '{DNP}')"
    ends = f"filter({missed}, wk_ -> get({status}, wk_) != '{DNP}')"
    return f"CAST(zip_with({starts}, {ends}, (from_, to_) -> struct(from_, to_, to_ - from_ + 1)) AS {SEGMENTS})"


def first_played(status: str) -> Column:
    return F.expr(_first(status))


def last_played(status: str) -> Column:
    return F.expr(_last(status))


def absence_segments(status: str) -> Column:
    """Maximal runs of D strictly between the first and the last played week.

    Both ends of the window are played weeks, so a run starts where the week before is
    not D and ends where the week after is not D. B and X break a run. Without a played
    week the window is empty, which has to be said: its bounds are NULL.
    """
    return F.expr(_segments(status))


def availability(status: str, segments: str | None = None) -> Column:
    """The availability record; ``segments`` names a column that already holds them."""
    found = segments or _segments(status)
    last = _last(status)
    return F.expr(
        f"""CAST(struct(
            coalesce(array_max(transform({found}, seg_ -> seg_.length)), 0),
            {found},
            {_first(status)},
            {last},
            coalesce(exists({found}, seg_ -> seg_.end < {last}), false),
            '{ABSENCE_CAUSE}') AS {AVAILABILITY})"""
    )


def long_absence_flag(longest: Column, weeks: int = 3) -> Column:
    """Three missed weeks in a row suggest an injury; the data cannot prove one."""
    return longest >= weeks


def shown_status(status: str, season: str) -> Column:
    """Status array for display: seasons before 2021 had 17 weeks."""
    return F.expr(f"slice({status}, 1, CASE WHEN {season} < 2021 THEN {WEEKS - 1} ELSE {WEEKS} END)")


def segment_rows(totals: DataFrame) -> DataFrame:
    """One row per absence segment: ``season, player_id, start, end, length``.

    The outer form keeps the optimizer from inferring a "not empty" filter, which it would
    push down by copying the whole segment expression.
    """
    rows = totals.select("season", "player_id", F.inline_outer("availability.absenceSegments"))
    return rows.filter("start IS NOT NULL")
