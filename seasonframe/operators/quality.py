"""Data-quality rules as rows.

A rule yields rows of schema ``VIOLATIONS``. All rules of a data set run in one pass: each
input row carries an array of rule outcomes that is filtered and unfolded in place.
``first_failures`` gives the failure a stop-at-first checker would report, and
``enforce`` raises on it.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe import constants as K
from seasonframe.functions import document_key, is_blank
from seasonframe.operators.injuries import injury_outcomes
from seasonframe.operators.skew import salted_lookup


@dataclass(frozen=True)
class Rule:
    rule_id: str
    failed: Column
    observed: Column
    expected: str
    message: Column
    severity: str = "error"


def apply_rules(
    df: DataFrame,
    dataset: str | Column,
    partition: Column,
    rules: Sequence[Rule],
    *,
    phase: int = 1,
    key: Column | None = None,
    sort_key: Column | None = None,
    keep_passed: bool = False,
) -> DataFrame:
    """Outcomes of ``rules`` on every row of ``df``: failures, or all with ``keep_passed``.

    ``phase``, ``sort_key`` and the position of a rule say in which order a sequential
    checker would have come across the failures. The outer form of ``inline`` keeps the
    optimizer from evaluating all rules a second time as a pushed-down filter.
    """
    def outcome(rank: int, rule: Rule) -> Column:
        failed = F.coalesce(rule.failed, F.lit(False))
        facts = F.struct(
            failed.alias("failed"),
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rank).alias("rank"),
            rule.observed.cast("string").alias("observed"),
            F.lit(rule.expected).alias("expected"),
            rule.message.alias("message"),
        )
        # Texts are only put together for rows that fail.
        return facts if keep_passed else F.when(failed, facts)

    outcomes = F.array_compact(F.array(*[outcome(rank, rule) for rank, rule in enumerate(rules)]))
    none = F.lit(None).cast("string")
    rows = df.select(
        (dataset if isinstance(dataset, Column) else F.lit(dataset)).alias("dataset"),
        partition.cast("string").alias("partition"),
        F.lit(phase).alias("phase"),
        F.coalesce(sort_key if sort_key is not None else F.lit(""), F.lit("")).alias("sort_key"),
        (key if key is not None else none).cast("string").alias("key"),
        F.inline_outer(outcomes),
    ).filter("rule_id IS NOT NULL")
    cols = [
        "dataset", "partition", "rule_id", "severity", "phase", "sort_key", "rank", "key",
        "observed", "expected", "message",
    ]
    return rows.select(*cols, *(["failed"] if keep_passed else []))


def first_failures(violations: DataFrame) -> DataFrame:
    """The failure met first per data set and partition; warnings do not stop a run."""
    order = F.struct("phase", "sort_key", "rank")
    rest = F.struct(*[c for c in violations.columns if c not in ("dataset", "partition")])
    return (
        violations.filter("severity = 'error'")
        .groupBy("dataset", "partition")
        .agg(F.min_by(rest, order).alias("v"))
        .select("dataset", "partition", "v.*")
    )


class QualityError(ValueError):
    """Raised by ``enforce`` with the message of the first failure."""


def enforce(violations: DataFrame) -> None:
    """Raise on the first error. Brings a single row to the driver."""
    types = F.array(*[F.lit(k) for k in K.OVERLAY_TYPES])
    order = ["dataset", F.array_position(types, F.col("partition")), "partition"]
    worst = first_failures(violations).orderBy(*order).limit(1).collect()
    if worst:
        raise QualityError(f"{worst[0].dataset} {worst[0].partition}: {worst[0].message}")


def _text(*parts: str | Column) -> Column:
    """Message text; a NULL part reads "null" instead of blanking the message."""
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    )


# Season totals --------------------------------------------------------------------------


def _with_expected(counts: DataFrame, expected: DataFrame | None, on: str) -> DataFrame:
    """Counts with a zero row for each expected partition that is missing altogether."""
    if expected is None:
        return counts
    filled = expected.select(on).distinct().join(counts, on, "left")
    numbers = [c for c in counts.columns if c != on]
    return filled.select(on, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def season_size_rules(
    totals: DataFrame,
    *,
    min_players: int = K.SEASON_MIN_PLAYERS,
    full_games: int = K.SEASON_FULL_GAMES,
    min_full: int = K.SEASON_MIN_FULL,
    seasons: DataFrame | None = None,
    keep_passed: bool = False,
) -> DataFrame:
    """Enough players, and enough of them with a full season (DQ-1, DQ-2)."""
    counts = totals.groupBy("season").agg(
        F.count(F.lit(1)).alias("players"),
        F.count_if(F.col("gamesPlayed") >= full_games).alias("full"),
    )
    players, full = F.col("players"), F.col("full")
    rules = [
        Rule("DQ-1", players < min_players, players, f">= {min_players}",
             _text("only ", players, f" players, expected at least {min_players}")),
        Rule("DQ-2", full < min_full, full, f">= {min_full}",
             _text("only ", full, f" players with {full_games} games, expected at least {min_full}")),
    ]
    counts = _with_expected(counts, seasons, "season")
    return apply_rules(counts, "season", F.col("season"), rules, phase=1, keep_passed=keep_passed)


def _code_count(code: str) -> Column:
    return F.coalesce(F.size(F.filter("weeklyStatus", lambda s: s == code)), F.lit(0))


def player_rules() -> list[Rule]:
    """A record must agree with its own weekly status (DQ-3 to DQ-8)."""
    length = F.size("weeklyStatus")

    def agrees(rule_id: str, name: str, value: Column, code: str) -> Rule:
        count = _code_count(code)
        return Rule(rule_id, ~value.eqNullSafe(count), value, f"count of {code}",
                    _text(f"{name}=", value, f" but {code} occurs ", count, " times"))

    points = F.coalesce(F.size("weeklyPoints"), F.lit(0))
    return [
        Rule("DQ-3", F.col("weeklyStatus").isNull() | (length != K.WEEKS), length, str(K.WEEKS),
             _text("weekly status has length ", length)),
        Rule("DQ-4", F.col("availability").isNull(), F.lit(None), "availability", _text("availability is missing")),
        agrees("DQ-5", "gamesPlayed", F.col("gamesPlayed"), K.PLAYED),
        agrees("DQ-6", "byeWeeks", F.col("byeWeeks"), K.BYE),
        agrees("DQ-7", "dnpWeeks", F.col("dnpWeeks"), K.DNP),
        agrees("DQ-8", "weeklyPoints", points, K.PLAYED),
    ]


def season_record_rules(totals: DataFrame) -> DataFrame:
    key = F.col("player_id")
    return apply_rules(
        totals, "season", F.col("season"), player_rules(), phase=2, key=key, sort_key=document_key(key)
    )


def sentinel_rules(totals: DataFrame, sentinels: DataFrame, keep_passed: bool = False) -> DataFrame:
    """Known regulars are present with enough games (DQ-9, DQ-10); seasons without any warn (DQ-11).

    ``sentinels`` is ``season, player_id, min_games, name``: a short hand-kept list, looked
    through in the order of ``place`` if it has that column, else of the ids. The totals
    side is only narrowed to the listed ids.
    """
    place = F.lpad(F.col("place").cast("string"), 9, "0") if "place" in sentinels.columns else F.col("player_id")
    listed = sentinels.withColumn("_season", F.col("season"))
    games = totals.select("season", "player_id", "gamesPlayed")
    seasons = totals.select("season").distinct()
    found = listed.join(games, ["season", "player_id"], "left").join(seasons, "season", "left_semi")
    played = F.col("gamesPlayed")
    rules = [
        Rule("DQ-9", played.isNull(), played, "present",
             _text("sentinel ", F.col("name"), " (", F.col("player_id"), ") not found")),
        Rule("DQ-10", played < F.col("min_games"), played, "min games",
             _text(F.col("name"), " has ", played, " games, expected at least ", F.col("min_games"))),
    ]
    checked = apply_rules(
        found, "season", F.col("season"), rules, phase=3, key=F.col("player_id"),
        sort_key=place, keep_passed=keep_passed,
    )
    silent = seasons.join(sentinels.select("season").distinct(), "season", "left_anti")
    warning = Rule("DQ-11", F.lit(True), F.lit(0), "sentinels", _text("no sentinels for this season"), "warning")
    warned = apply_rules(silent, "season", F.col("season"), [warning], phase=3, keep_passed=keep_passed)
    return checked.unionByName(warned)


def season_rules(
    totals: DataFrame, sentinels: DataFrame | None = None, seasons: DataFrame | None = None, **limits: int
) -> DataFrame:
    """All season rules."""
    out = season_size_rules(totals, seasons=seasons, **limits).unionByName(season_record_rules(totals))
    if sentinels is not None:
        out = out.unionByName(sentinel_rules(totals, sentinels))
    return out


def default_sentinels(spark) -> DataFrame:
    return spark.createDataFrame(
        [(*row, place) for place, row in enumerate(K.SEASON_SENTINELS)],
        "season INT, player_id STRING, min_games INT, name STRING, place INT",
    )


# Document shape -------------------------------------------------------------------------


def array_document_rules(documents: DataFrame, dataset: str, rule_id: str) -> DataFrame:
    """Each source document is a JSON array (DQ-12, DQ-16). ``documents``: ``partition, value``."""
    rule = Rule(rule_id, F.json_array_length("value").isNull(), F.lit(None), "array",
                _text("the document is not an array"))
    return apply_rules(documents, dataset, F.col("partition"), [rule], phase=0)


def quarantine_rules(aside: DataFrame, dataset: str) -> DataFrame:
    """Nothing of a partition was put aside when it was landed.

    The shape rules (DQ-12, DQ-16) speak of documents that are no array or cut off, the type rule
    (FN-18) of records. One row for each partition, file and reason, with the first position.
    """
    found = aside.groupBy("partition", "file", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("at"))
    shape = {"college": "DQ-12", "market": "DQ-16"}.get(dataset, "DQ-0")
    whole = F.col("reason") == "document"
    document = Rule(shape, whole, F.col("reason"), "array", _text(F.col("file"), " is not an array"))
    record = Rule("FN-18", ~whole, F.col("n"), "0",
                  _text(F.col("file"), ": ", F.col("n"), " records put aside (", F.col("reason"), "), the first at ", F.col("at")))
    return apply_rules(found, dataset, F.col("partition"), [document, record], phase=0, key=F.col("file"), sort_key=F.col("file"))


# College rows ---------------------------------------------------------------------------


def college_rules(
    rows: DataFrame,
    *,
    min_rows: int = K.COLLEGE_MIN_ROWS,
    min_players: int = K.COLLEGE_MIN_PLAYERS,
    partitions: DataFrame | None = None,
    keep_passed: bool = False,
) -> DataFrame:
    """Row count, required fields and distinct players per category and season (DQ-13 to DQ-15).

    The distinct count runs on rows already reduced to one per player, so both
    aggregates combine on the map side. A NULL id counts as one player.
    """
    part = F.concat_ws("/", "category", F.col("season").cast("string")).alias("partition")
    missing = F.col("playerId").isNull() | F.col("statType").isNull() | F.col("stat").isNull()
    per_player = rows.groupBy(part, "playerId").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("bad")
    )
    counts = per_player.groupBy("partition").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("players")
    )
    counts = _with_expected(counts, partitions, "partition")
    n, bad, players = F.col("n"), F.col("bad"), F.col("players")
    rules = [
        Rule("DQ-13", n < min_rows, n, f">= {min_rows}", _text(n, f" rows, expected at least {min_rows}")),
        Rule("DQ-14", bad > 0, bad, "0", _text(bad, " rows lack playerId, statType or stat")),
        Rule("DQ-15", players < min_players, players, f">= {min_players}",
             _text("only ", players, f" distinct players, expected at least {min_players}")),
    ]
    return apply_rules(counts, "college", F.col("partition"), rules, keep_passed=keep_passed)


# Market snapshots -----------------------------------------------------------------------


def market_size_rules(
    market: DataFrame,
    *,
    rows: tuple[int, int] = K.MARKET_ROWS,
    dates: DataFrame | None = None,
    keep_passed: bool = False,
) -> DataFrame:
    """Plausible snapshot size (DQ-17); ``dates`` without any row count 0."""
    low, high = rows
    counts = market.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))
    counts = _with_expected(counts, dates, "snapshot_date")
    n = F.col("n")
    rule = Rule("DQ-17", (n < low) | (n > high), n, f"{low}..{high}", _text(n, f" rows, expected {low} to {high}"))
    return apply_rules(counts, "market", F.col("snapshot_date"), [rule], phase=1, keep_passed=keep_passed)


def market_position_rules(
    market: DataFrame,
    *,
    positions: Sequence[str] = K.MARKET_POSITIONS,
    least: int = K.MARKET_MIN_PER_POSITION,
    keep_passed: bool = False,
) -> DataFrame:
    """Enough rows of each required position, absent ones counting 0 (DQ-18).

    One conditional count per position in a single aggregate over the snapshots.
    """
    position = F.col("position")
    counts = market.groupBy("snapshot_date").agg(
        *[F.count_if(position == p).alias(f"_{i}") for i, p in enumerate(positions)]
    )
    per_position = counts.select(
        "snapshot_date",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("place"), F.lit(p).alias("position"), F.col(f"_{i}").alias("n"))
                    for i, p in enumerate(positions)
                ]
            )
        ),
    )
    n = F.col("n")
    rule = Rule("DQ-18", n < least, n, f">= {least}", _text("only ", n, " rows at ", position))
    return apply_rules(
        per_position, "market", F.col("snapshot_date"), [rule], phase=2, key=position,
        sort_key=F.lpad(F.col("place").cast("string"), 3, "0"), keep_passed=keep_passed,
    )


def out_of_range(value: Column, bounds: tuple[int, int]) -> Column:
    return value.isNull() | (value < bounds[0]) | (value > bounds[1])


def range_samples(market: DataFrame, bounds: tuple[int, int] = K.MARKET_VALUE_RANGE, n: int = 3) -> DataFrame:
    """The first n offending rows per snapshot, in input order.

    The rank filter becomes a group limit before the shuffle: n rows per task and date.
    """
    order = Window.partitionBy("snapshot_date").orderBy("ord")
    bad = market.filter(out_of_range(F.col("value"), bounds)).select("snapshot_date", "ord", "name", "value")
    return bad.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def market_range_rules(
    market: DataFrame,
    *,
    bounds: tuple[int, int] = K.MARKET_VALUE_RANGE,
    samples: int = 3,
    keep_passed: bool = False,
) -> DataFrame:
    """Values are numbers in range; the message shows the first offenders (DQ-19)."""
    counts = market.groupBy("snapshot_date").agg(
        F.count_if(out_of_range(F.col("value"), bounds)).alias("bad")
    )
    shown = (
        range_samples(market, bounds, samples)
        .groupBy("snapshot_date")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "name", "value"))).alias("s"))
        .select(
            "snapshot_date",
            F.array_join(
                F.transform("s", lambda r: _text(r["name"], "=", r["value"])), ", "
            ).alias("samples"),
        )
    )
    low, high = bounds
    joined = counts.join(shown, "snapshot_date", "left")
    rule = Rule("DQ-19", F.col("bad") > 0, F.col("bad"), f"{low}..{high}",
                _text(F.col("bad"), f" rows with a value outside {low} to {high}: ", F.col("samples")))
    return apply_rules(joined, "market", F.col("snapshot_date"), [rule], phase=3, keep_passed=keep_passed)


def top_rows(market: DataFrame, n: int = K.MARKET_TOP) -> DataFrame:
    """Top n rows per snapshot by value, ties in input order."""
    order = Window.partitionBy("snapshot_date").orderBy(F.desc("value"), "ord")
    return market.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def market_sentinel_rules(
    market: DataFrame,
    *,
    is_sentinel: Column | None = None,
    label: Column | None = None,
    top: int = K.MARKET_TOP,
    least: int = K.MARKET_MIN_SENTINELS,
    keep_passed: bool = False,
) -> DataFrame:
    """At least three known names among the top ten (DQ-20)."""
    label = F.col("name") if label is None else label
    known = F.col("name").isin(*K.MARKET_SENTINELS) if is_sentinel is None else is_sentinel
    hits = top_rows(market, top).groupBy("snapshot_date").agg(
        F.count_distinct(F.when(known, label)).alias("hits"),
        F.array_sort(F.collect_list(F.struct("rn", label.alias("name")))).alias("top"),
    )
    names = F.array_join(F.transform("top", lambda t: t["name"]), ", ")
    rule = Rule("DQ-20", F.col("hits") < least, F.col("hits"), f">= {least}",
                _text("only ", F.col("hits"), f" sentinels in the top {top} (", names, ")"))
    return apply_rules(hits, "market", F.col("snapshot_date"), [rule], phase=4, keep_passed=keep_passed)


def market_delta_rules(ratios: DataFrame, *, max_ratio: float = K.MARKET_MAX_CHANGED, keep_passed: bool = False) -> DataFrame:
    """Not too many rows changed since the snapshot before (DQ-21). ``ratios``: see ``change_ratio``."""
    ratio = F.col("ratio")
    rule = Rule("DQ-21", ratio > max_ratio, ratio, f"<= {max_ratio}",
                _text(F.col("changed_n"), "/", F.col("prev_n"), " rows changed"))
    return apply_rules(ratios, "market", F.col("snapshot_date"), [rule], phase=5, keep_passed=keep_passed)


def market_rules(market: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """DQ-17 to DQ-20 with the fixed limits."""
    return (
        market_size_rules(market, dates=dates)
        .unionByName(market_position_rules(market))
        .unionByName(market_range_rules(market))
        .unionByName(market_sentinel_rules(market))
    )


# Overlay --------------------------------------------------------------------------------


def wrapper_rules(documents: DataFrame) -> DataFrame:
    """Wrapper of each overlay document (DQ-22). ``documents``: ``overlay, value`` (JSON text)."""
    doc = F.try_parse_json("value")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(doc, path, "variant")), F.lit("missing"))

    version = kind("$.schemaVersion")
    bad = (
        ~kind("$").startswith("OBJECT")
        | (version != "BIGINT")
        | ~kind("$.entries").startswith("ARRAY")
    )
    rule = Rule("DQ-22", bad, version, "wrapper",
                _text("expected an object with an integer schemaVersion and an entries array"))
    return apply_rules(documents, "overlay", F.col("overlay"), [rule], phase=0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n`` for each key combination that occurs more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _duplicate_rules(entries: DataFrame, kind: str, keys: Sequence[str], rule_id: str, phase: int) -> DataFrame:
    key = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    rule = Rule(rule_id, F.lit(True), F.col("n"), "1", _text("duplicate ", ", ".join(keys), ": ", key))
    repeated = duplicate_keys(entries, keys)
    met = key
    if "ord" in entries.columns:  # a reader in document order fails at the second entry of a key
        firsts = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).filter("n > 1")
        firsts = firsts.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        later = entries.join(firsts, same).filter("ord > first")
        repeated = later.groupBy(*keys, "n").agg(F.min("ord").alias("second"))
        met = F.lpad(F.col("second").cast("string"), 19, "0")
    return apply_rules(
        repeated, "overlay", F.lit(kind), [rule], phase=phase, key=key, sort_key=met
    )


def year_invalid(current_year: int) -> Column:
    """Outside 2012 to next year; NULL, which stands for "not an integer", is invalid too."""
    year = F.col("year")
    return year.isNull() | ~year.between(K.MIN_YEAR, current_year + 1)


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def entry_rules(kind: str, current_year: int) -> list[Rule]:
    """Rules that need nothing but the entry itself (DQ-26 to DQ-31, DQ-35, 36, 38, 39)."""
    team, year, role, body = (F.col(c) for c in ("team", "year", "role", "body"))
    rules = [Rule("DQ-26", _blank("id"), F.col("id"), "id", _text("entry without an id"))]
    for name in K.REQUIRED_FIELDS[kind]:
        rules.append(Rule("DQ-27", F.col(name).isNull(), F.lit(None), name, _text(f"missing required field {name}")))
    bad_year = year_invalid(current_year)
    span = f"{K.MIN_YEAR}..{current_year + 1}"
    year_message = _text("year ", year, f" is not in {span}")
    team_message = _text("unknown team ", team)
    bad_team = ~F.coalesce(team.isin(*K.TEAMS), F.lit(False))
    if kind in ("coaching", "scheme"):
        rules.append(Rule("DQ-28", bad_team, team, "team code", team_message))
        rules.append(Rule("DQ-29", bad_year, year, span, year_message))
    if kind == "injuries":
        rules.append(Rule("DQ-29", bad_year, year, span, year_message))
    if kind == "coaching":
        bad_role = ~F.coalesce(role.isin(*K.COACHING_ROLES), F.lit(False))
        rules.append(Rule("DQ-30", bad_role, role, "HC, OC, DC", _text("unknown role ", role)))
    if kind == "scheme":
        empty = _blank("offense") & _blank("defense") & _blank("tempo")
        rules.append(Rule("DQ-31", empty, F.lit(None), "content", _text("none of offense, defense, tempo is set")))
    if kind == "notes":
        owners = F.col("playerId").isNotNull().cast("int") + team.isNotNull().cast("int")
        rules.append(Rule("DQ-35", owners != 1, owners, "1", _text("exactly one of playerId and team must be set")))
        rules.append(Rule("DQ-36", team.isNotNull() & bad_team, team, "team code", team_message))
        rules.append(Rule("DQ-38", year.isNotNull() & bad_year, year, span, year_message))
        blank_body = F.coalesce(is_blank(body), F.lit(True))
        rules.append(Rule("DQ-39", blank_body, F.lit(None), "text", _text("body is blank")))
    return rules


def unknown_players(entries: DataFrame, players: DataFrame) -> DataFrame:
    """Entries whose ``playerId`` is set but not in the player dimension (DQ-32, DQ-37).

    The anti join is salted: one player may have any number of entries.
    """
    known = players.select(F.col("player_id").alias("playerId")).distinct()
    asked = entries.filter("playerId IS NOT NULL")
    spread = [c for c in entries.columns if c != "playerId"]
    return salted_lookup(asked, known, ["playerId"], spread, "left_anti")


def overlay_entry_violations(
    entries: DataFrame,
    kind: str,
    current_year: int,
    *,
    totals: DataFrame | None = None,
    players: DataFrame | None = None,
) -> DataFrame:
    """Per-entry rules of one type; look-ups run when their table is given.

    Entries keep their document order through ``ord`` if they have it.
    """
    df = entries
    for name, type_ in (("team", "STRING"), ("role", "STRING"), ("body", "STRING"), ("playerId", "STRING")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(type_))
    order = F.lpad(F.col("ord").cast("string"), 19, "0") if "ord" in df.columns else F.col("id")
    common = {"phase": 3, "key": F.col("id"), "sort_key": order}
    out = apply_rules(df, "overlay", F.lit(kind), entry_rules(kind, current_year), **common)
    if kind == "notes":  # the player is looked up before the year is checked
        out = out.withColumn("rank", F.when(F.col("rank") >= 4, F.col("rank") + 1).otherwise(F.col("rank")))

    def more(rows: DataFrame, rule: Rule, rank: int) -> DataFrame:
        found = apply_rules(rows, "overlay", F.lit(kind), [rule], **common)
        return out.unionByName(found.withColumn("rank", F.lit(rank)))

    player = F.col("playerId")
    if players is not None and kind in ("injuries", "notes"):
        rule_id, rank = ("DQ-32", 5) if kind == "injuries" else ("DQ-37", 4)
        rule = Rule(rule_id, F.lit(True), player, "known player", _text("player ", player, " is not known"))
        out = more(unknown_players(df, players), rule, rank)
    if totals is not None and kind == "injuries":
        starts = F.array_join(F.transform("starts", lambda s: F.concat(F.lit("w"), s.cast("string"))), ", ")
        outcome = F.col("outcome")
        looked_up = [
            Rule("DQ-33", outcome == "no_season", outcome, "season row",
                 _text("no season totals for player ", player, " in ", F.col("year"))),
            Rule("DQ-34", outcome == "no_segment", F.col("segmentStartWeek"), "segment",
                 _text("no absence segment starts at week ", F.col("segmentStartWeek"), ", available: ",
                       F.coalesce(F.nullif(starts, F.lit("")), F.lit("none")))),
        ]
        found = apply_rules(injury_outcomes(df, totals), "overlay", F.lit(kind), looked_up, **common)
        out = out.unionByName(found.withColumn("rank", F.col("rank") + 6))
    return out


def overlay_violations(
    overlays: dict[str, DataFrame],
    current_year: int,
    *,
    totals: DataFrame | None = None,
    players: DataFrame | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """All overlay rules of all types (DQ-22 to DQ-39).

    Without a player table the player rules are skipped; without totals the segment rules.
    """
    out = None if documents is None else wrapper_rules(documents)
    for kind in K.OVERLAY_TYPES:
        if kind not in overlays:
            continue
        entries = overlays[kind]
        parts = [_duplicate_rules(entries, kind, ["id"], "DQ-23", 1)]
        if kind == "coaching":
            parts.append(_duplicate_rules(entries, kind, ["year", "team", "role"], "DQ-24", 2))
        if kind == "scheme":
            parts.append(_duplicate_rules(entries, kind, ["year", "team"], "DQ-25", 2))
        parts.append(
            overlay_entry_violations(entries, kind, current_year, totals=totals, players=players)
        )
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out
