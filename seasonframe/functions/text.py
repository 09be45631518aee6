"""Text helpers, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\p{Z}\x{FEFF}]+"
_INK = r"[^\s\p{Z}\x{FEFF}]"


def js_trim(text: Column) -> Column:
    """Trim every Unicode blank; Spark's ``trim`` only knows the space character."""
    return F.regexp_replace(text, f"^{_BLANK}|{_BLANK}$", "")


def is_blank(text: Column) -> Column:
    """Nothing but Unicode blanks. Stops at the first other character, however long the text."""
    return ~text.rlike(_INK)


def position_code(text: Column) -> Column:
    """First position code at the start of a word, upper-cased; NULL when absent.

    Only ASCII letters, digits and the underscore make words; Java's own word boundary
    depends on its version there. There is deliberately no boundary after the code, so
    ``kc RB1`` gives ``K``.
    """
    found = F.regexp_extract(text, r"(?i)(?<![A-Za-z0-9_])(QB|RB|WR|TE|K)", 1)
    return F.upper(F.nullif(found, F.lit("")))


def normalized_name(name: Column) -> Column:
    """Lower-case letters and digits of a name without a generation suffix."""
    plain = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", "")
    plain = F.regexp_replace(js_trim(plain), r"\s+(jr|sr|ii|iii|iv|v)$", "")
    return F.regexp_replace(plain, r"\s+", "")


def document_key(key: Column, position: Column | None = None) -> Column:
    """Text that sorts keys the way a JSON document lists them.

    Canonical non-negative integers below 2^32-1 come first in numeric order; every other
    key follows in ``position`` order, or by its text when no position is known.
    """
    number = F.when(key.rlike(r"^(0|[1-9]\d{0,9})$"), key.try_cast("bigint"))
    tail = key if position is None else F.lpad(position.cast("string"), 19, "0")
    return F.when(number < 4294967295, F.concat(F.lit("0"), F.lpad(key, 10, "0"))).otherwise(
        F.concat(F.lit("1"), F.coalesce(tail, F.lit("")))
    )


def player_key(season: str, player_id: str) -> Column:
    """One text for a player of a season, so that a join needs no second column."""
    return F.concat_ws("/", F.col(season).cast("string"), player_id)
