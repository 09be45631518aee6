"""Listing pages: block extraction and the rule that says where a crawl ends."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.constants import LISTING_PAGE_ROWS
from seasonframe.functions import js_trim, position_code, prefix_int

# Class names of a listing block and its fields.
BLOCK_CLASS = "onePlayer"
NAME_CLASS = "player-name"
TEAM_CLASS = "player-team"
VALUE_CLASS = "value"
POSITION_CLASS = "position-team"

_TAG = r"<[^>]*>"


# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

# Named entities of listing texts.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "\u2013", "mdash": "\u2014",
    "lsquo": "\u2018", "rsquo": "\u2019", "eacute": "\u00e9", "ntilde": "\u00f1", "uuml": "\u00fc", "amp": "&",
}
_ENTITY = r"&(#[xX]?[0-9a-fA-F]{1,6}|[a-z]{2,6});"


def _has_class(name: str) -> str:
    """A class attribute with the name, in double, single or no quotes."""
    quoted = "|".join(f"{q}(?:[^{q}]*\\s)?{name}(?:\\s[^{q}]*)?{q}" for q in ('"', "'"))
    return rf"class\s*=\s*(?:{quoted}|{name}(?=[\s>]))"


def _character(entity: Column) -> Column:
    """The text that an entity such as ``amp``, ``#39`` or ``#x27`` stands for."""
    number = F.when(entity.rlike("^#[xX]"), F.conv(F.substring(entity, 3, 8), 16, 10)).otherwise(F.substring(entity, 2, 8))
    code = F.when(entity.startswith("#"), number.try_cast("int"))
    wide = F.concat(F.lpad(F.hex(code), 8, "0"))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), entity)
    # 32-bit code points; numbers that are none stay as they are written.
    sign = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(wide), "UTF-32"))
    return F.coalesce(sign, named, F.concat(F.lit("&"), entity, F.lit(";")))


def _plain(html: Column) -> Column:
    """Visible text of a fragment: tags dropped, entities resolved, each once."""
    text = F.regexp_replace(html, _TAG, "")
    rest = F.split(text, _ENTITY)
    found = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1))
    whole = F.array_join(F.zip_with(rest, found, lambda a, e: F.concat(a, F.when(e.isNull(), "").otherwise(_character(e)))), "")
    return js_trim(F.when(F.size(found) == 0, text).otherwise(whole))


def split_blocks(html: Column, block_class: str = BLOCK_CLASS) -> Column:
    """Array of listing blocks: each runs from its opening tag to the next block's."""
    opening = rf"<div\b[^>]*{_has_class(block_class)}[^>]*>"
    pieces = F.split(html, f"(?={opening})")
    return F.filter(pieces, lambda p: p.rlike(f"^{opening}"))


_CLASSES = r"""class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def tokens(html: Column) -> Column:
    """Array of ``name, step, classes, text``: tags and the texts between them, in order.

    ``step`` is 1 for a tag that opens an element, -1 for one that closes it and 0 for text,
    comments and elements without content. Names are in lower case; ``classes`` has a blank
    before and behind each. Comments have no text.
    """
    pieces = F.regexp_extract_all(html, F.lit(r"(?s)<!--.*?-->|<[^>]*>|[^<]+"), F.lit(0))

    def token(text: Column) -> Column:
        name = F.when(text.startswith("<"), F.lower(F.regexp_extract(text, r"^</?([A-Za-z][\w-]*)", 1))).otherwise("")
        empty = (name == "") | name.isin(*VOID) | text.endswith("/>")
        step = F.when(empty, 0).when(text.startswith("</"), -1).otherwise(1)
        said = F.concat(*[F.regexp_extract(text, _CLASSES, i) for i in (1, 2, 3)])
        classes = F.when(text.startswith("<"), F.concat(F.lit(" "), F.regexp_replace(said, r"\s+", " "), F.lit(" "))).otherwise("")
        shown = F.when(text.startswith("<!--"), "").otherwise(text)
        return F.struct(name.alias("name"), step.cast("int").alias("step"), classes.alias("classes"), shown.alias("text"))

    return F.transform(pieces, token)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def field_html(found: Column, cls: str, *path: str) -> Column:
    """What is inside the first element of a class, or the first of each tag of ``path``, one inside the other.

    One fold over the tokens. ``stage`` says how much of the path is entered; ``depth`` counts the
    open elements that have the name of the one entered last, which ends at its own closing tag.
    Where that is a paragraph it also ends where the next one begins, as one can't hold another.
    If it ends before the next of the path is found the field is empty; one that is never closed
    goes on to the end.
    """
    whole = len(path) + 1
    start = F.struct(
        F.lit(0).alias("stage"), F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("text")
    )

    def step(state: Column, t: Column) -> Column:
        stage, own = state["stage"], t["name"] == state["name"]
        wanted = F.when(stage == 0, F.contains(t["classes"], F.lit(f" {cls} ")))
        for k, tag in enumerate(path, 1):
            wanted = wanted.when(stage == k, t["name"] == tag)
        enters = ~state["done"] & (t["step"] == 1) & F.coalesce(wanted, F.lit(False))
        over = (stage > 0) & own & (((state["name"] == "p") & (t["step"] == 1)) | ((t["step"] == -1) & (state["depth"] == 1)))
        # 0: goes in, 1: comes out, 2: neither
        turn = F.when(enters, 0).when(over, 1).otherwise(2)

        def moved(turn: Column) -> Column:
            return F.struct(
                F.when(turn == 0, stage + 1).otherwise(stage).alias("stage"),
                F.when(turn == 0, t["name"]).otherwise(state["name"]).alias("name"),
                F.when(turn == 0, 1).when(own, state["depth"] + t["step"]).otherwise(state["depth"]).alias("depth"),
                (state["done"] | (turn == 1)).alias("done"),
                F.when((stage == whole) & (turn == 2) & ~state["done"], F.concat(state["text"], t["text"])).otherwise(state["text"]).alias("text"),
            )

        return _let(turn, moved)

    return F.aggregate(found, start, step, lambda s: s["text"])


# How deep elements of one name may lie in each other for a pattern to follow them.
NESTED = 4


def _field_pattern(cls: str, path: Sequence[str]) -> str:
    """``field_html`` as one pattern, whose group 2 is the field; it does not match where nesting is too deep.

    It starts at the first character and goes on token by token, as ``tokens`` cuts them, in
    possessive loops: there is one way to match, in one pass, and no backtracking over a block. Where
    the path ends early, or there is no such class, it matches with an empty group.
    """
    text, comment, stray = r"[^<]++", r"<!--.*?-->", r"<(?![^>]*+>)"
    quoted = "|".join(f"{q}(?:[^{q}>]*\\s)?{re.escape(cls)}(?:\\s[^{q}>]*)?{q}" for q in ('"', "'"))
    attribute = r"""class\s*+=\s*+(?:"[^">]*+"|'[^'>]*+'|[^\s>"'])"""
    wanted = rf"""(?=(?:(?!{attribute})[^>])*+class\s*+=\s*+(?:{quoted}|{re.escape(cls)}(?=[\s>"'])))"""
    void = f"(?!(?i:{'|'.join(VOID)})(?![\\w-]))"
    paragraph = r"<(?i:p)(?![\w-])"

    def tag(start: str, name: str) -> str:
        return rf"{start}(?i:{name})(?![\w-])[^>]*+(?<!/)>"

    def inside(own: str, sought: str, depth: int) -> str:
        """Tokens and whole elements in ``own`` before its end or the tag ``sought``."""
        tokens = rf"{text}|{comment}|(?!{tag('</?', own)}){sought}<[^>]*+>|{stray}"
        if depth:
            tokens += rf"|(?!{paragraph}){sought}{tag('<', own)}{inside(own, sought, depth - 1)}(?:{tag('</', own)}|\z)"
        return f"(?:{tokens})*+"

    def up_to(own: str, name: str, depth: int) -> str:
        """All in ``own`` up to the first tag ``name``, which may lie in elements like ``own``."""
        sought = f"(?!{tag('<', name)})"
        deeper = rf"|(?!{paragraph}){sought}{tag('<', own)}{up_to(own, name, depth - 1)}" if depth else ""
        return f"{inside(own, sought, depth)}(?:{tag('<', name)}{deeper})"

    def rest(own: str, names: Sequence[str]) -> str:
        end = rf"(?:\z|{tag('</', own)}|(?={paragraph}){tag('<', own)})"
        if not names:
            return f"({inside(own, '', NESTED)}){end}"
        sought = f"(?!{tag('<', names[0])})"
        missing = inside(own, sought, NESTED) + sought + end
        return f"(?:{up_to(own, names[0], NESTED)}{rest(names[0], names[1:])}|{missing})"

    before = rf"(?:{text}|{comment}|(?!<{wanted}{void}[A-Za-z][^>]*+(?<!/)>)<[^>]*+>|{stray})*+"
    opening = rf"<{wanted}{void}([A-Za-z][\w-]*+)[^>]*+(?<!/)>"
    return rf"(?s)\A{before}(?:\z|{opening}{rest(chr(92) + '1', path)})"


def _field(block: Column, cls: str, *path: str) -> Column:
    """``field_html`` of a block's text, by one pattern; the tokens decide where nesting is too deep for it."""
    found = F.get(F.regexp_extract_all(block, F.lit(_field_pattern(cls, path)), F.lit(2)), F.lit(0))
    shown = F.regexp_replace(found, r"(?s)<!--.*?-->|<!--[^>]*+>|(<[^>]*+>)|<", "$1")
    return F.coalesce(shown, field_html(tokens(block), cls, *path))


def listing_rows(pages: DataFrame, keys: Sequence[str] = ("page",)) -> DataFrame:
    """``keys, pos, name, team, value, position`` of every valid block of the pages.

    Blocks are cut from the page text by a pattern, and so are fields, tag by tag, so that a field ends
    at its own closing tag whatever it holds; those nested too deep for that are taken apart as a
    stream of tags. A row without a name or a numeric value is dropped and an empty team is NULL. The fields pass through ``inline``, which
    keeps the optimizer from working them out once more for the filter.
    """
    blocks = pages.select(*keys, F.posexplode(split_blocks(F.col("html"))).alias("pos", "block"))
    block = F.col("block")
    raw = {
        "name": _field(block, NAME_CLASS, "p", "a"), "team": _field(block, TEAM_CLASS),
        "value": _field(block, VALUE_CLASS, "p"), "position": _field(block, POSITION_CLASS),
    }
    blocks = blocks.select(*keys, "pos", F.inline(F.array(F.struct(*[html.alias(f"_{c}") for c, html in raw.items()]))))
    row = F.struct(
        _plain(F.col("_name")).alias("name"),
        F.nullif(_plain(F.col("_team")), F.lit("")).alias("team"),
        prefix_int(_plain(F.col("_value"))).alias("value"),
        position_code(_plain(F.col("_position"))).alias("position"),
    )
    rows = blocks.select(*keys, "pos", F.inline(F.array(row)))
    return rows.filter("name <> '' AND value IS NOT NULL")


def link_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, pos, href, label``: the same extraction for list items that hold one link.

    One pass over the page finds the items; their fields are cut from the short matches.
    """
    pattern = '<li><a href="([^"]*)">([^<]*)</a></li>'
    items = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    rows = pages.select(key, F.posexplode(items).alias("pos", "item"))
    return rows.select(
        key,
        "pos",
        F.regexp_extract("item", pattern, 1).alias("href"),
        F.regexp_extract("item", pattern, 2).alias("label"),
    ).filter("href <> ''")


def crawl_cutoff(
    rows: DataFrame,
    keys: Sequence[str] = ("name", "team"),
    page: str = "page",
    by: Sequence[str] = (),
    page_rows: int = LISTING_PAGE_ROWS,
    max_pages: int | None = None,
) -> DataFrame:
    """First-seen rows of the pages a sequential reader would have taken.

    Pages count from 0. The last page taken is the first that is short, brings nothing
    new, or has no successor with rows. ``by`` names the columns that tell crawls apart.
    ``max_pages`` is for readers that fetch: landed pages are all used. A missing key field
    counts as the text "null". First-seen and the page counts are
    aggregates with a map-side combine; what is joined back is one row per crawl.
    """
    if max_pages is not None:
        rows = rows.filter(F.col(page) < max_pages)
    single = not by
    if single:
        by = ("_crawl",)
        rows = rows.withColumn("_crawl", F.lit(0))
    key_cols = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("null")) for i, k in enumerate(keys)}
    columns = rows.columns
    # Both the row counts and the first-seen rows come from this aggregate. The filter
    # drops nothing; it keeps both columns in either reader, so that they share one
    # exchange and pages are scanned and parsed once.
    per_key = (
        rows.withColumns(key_cols)
        .groupBy(*by, *key_cols, page)
        .agg(F.min_by(F.struct(*columns), "pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_first IS NOT NULL AND _n > 0")
    )
    firsts = (
        per_key.groupBy(*by, *key_cols)
        .agg(F.min_by("_first", page).alias("_first"))
        .select("_first.*")
    )
    per_page = [*by, page]
    taken = per_key.groupBy(*per_page).agg(F.sum("_n").alias("_rows"))
    fresh = firsts.groupBy(*per_page).agg(F.count(F.lit(1)).alias("_new"))
    ends = (F.col("_rows") < page_rows) | F.col("_new").isNull()
    sealed = taken.join(fresh, per_page, "left").withColumn("_ends", ends)

    # Each page expects its successor, and a crawl expects page 0. An expected page
    # without rows ends the crawl before itself.
    at = F.col(page).cast("long")
    visits = F.array(
        F.struct(F.lit(0).cast("long").alias("_at"), F.lit(False).alias("_have")),
        F.struct((at + 1).alias("_at"), F.lit(False).alias("_have")),
        F.struct(at.alias("_at"), F.lit(True).alias("_have")),
    )
    gaps = (
        sealed.select(*by, F.inline(visits))
        .groupBy(*by, "_at")
        .agg(F.bool_or("_have").alias("_have"))
        .filter("NOT _have")
    )
    stops = (
        sealed.filter("_ends").select(*by, at.alias("_stop"))
        .union(gaps.select(*by, (F.col("_at") - 1).alias("_stop")))
        .groupBy(*by)
        .agg(F.min("_stop").alias("_stop"))
    )
    # Without ``by`` there is one crawl, so ``stops`` is a single row.
    kept = firsts.join(F.broadcast(stops) if single else stops, [*by])
    kept = kept.filter(F.col(page) <= F.col("_stop")).drop("_stop")
    return kept.drop("_crawl") if single else kept
