"""Explicit schemas as DDL text.

Nothing is inferred: keyed objects would become wide structs.
"""

from __future__ import annotations



def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def array_of(columns: str) -> str:
    return f"ARRAY<STRUCT<{columns}>>"


def map_of(columns: str) -> str:
    return f"MAP<STRING, STRUCT<{columns}>>"


WEEKLY_DOCUMENT = "player_id STRING, team STRING, stats MAP<STRING, DOUBLE>"
WEEKLY_ENTRIES = (
    "season INT, week INT, ord LONG, player_id STRING, team STRING, stats MAP<STRING, DOUBLE>"
)

SEGMENTS = "ARRAY<STRUCT<start: INT, end: INT, length: INT>>"
AVAILABILITY = (
    f"STRUCT<longestAbsence: INT, absenceSegments: {SEGMENTS}, firstWeek: INT, lastWeek: INT, "
    "returnedFromAbsence: BOOLEAN, absenceCause: STRING>"
)
SEASON_RECORD = (
    "stats MAP<STRING, DOUBLE>, gamesPlayed INT, gamesStarted INT, byeWeeks INT, dnpWeeks INT, "
    "weeklyPoints MAP<INT, DOUBLE>, fantasyPoints DOUBLE, scoringBasis STRING, "
    f"weeklyStatus ARRAY<STRING>, availability {AVAILABILITY}"
)
# JSON objects only have text keys.
SEASON_DOCUMENT = SEASON_RECORD.replace("MAP<INT, DOUBLE>", "MAP<STRING, DOUBLE>")
SEASON_TOTALS = f"season INT, player_id STRING, {SEASON_RECORD}"

COLLEGE_STATS = (
    "season INT, playerId STRING, player STRING, position STRING, team STRING, conference STRING, "
    "category STRING, statType STRING, stat STRING"
)

MARKET_ROW = "name STRING, team STRING, value INT, position STRING"
MARKET_VALUES = (
    "snapshot_date DATE, ord LONG, name STRING, team STRING, value INT, position STRING"
)
MARKET_CHECKS = "checkedAt TIMESTAMP, identical BOOLEAN, file STRING, snapshot_date DATE"
MARKET_REJECTS = "file STRING, message STRING, rejectedAt TIMESTAMP, snapshot_date DATE"

OVERLAY_ENTRIES = {
    "coaching": {
        "id": "STRING", "year": "INT", "team": "STRING", "role": "STRING", "name": "STRING",
        "tenureStart": "INT", "isNew": "BOOLEAN", "predecessor": "STRING", "source": "STRING",
        "notes": "STRING",
    },
    "scheme": {
        "id": "STRING", "year": "INT", "team": "STRING", "offense": "STRING",
        "defense": "STRING", "tempo": "STRING", "changedFromPrev": "BOOLEAN",
        "source": "STRING", "notes": "STRING",
    },
    "injuries": {
        "id": "STRING", "playerId": "STRING", "year": "INT", "segmentStartWeek": "INT",
        "segmentEndWeek": "INT", "type": "STRING", "bodyPart": "STRING", "severity": "STRING",
        "dateInjured": "STRING", "dateReturned": "STRING", "source": "STRING", "notes": "STRING",
    },
    "notes": {
        "id": "STRING", "playerId": "STRING", "team": "STRING", "year": "INT", "tag": "STRING",
        "body": "STRING", "source": "STRING",
    },
}

MANIFEST_RECORD = (
    "originalKey STRING, recordCount LONG, inProgress BOOLEAN, schemaVersion INT, "
    "lastModified TIMESTAMP"
)
MANIFEST = f"path STRING, {MANIFEST_RECORD}"

STATE = (
    "week INT, leg INT, season STRING, season_type STRING, league_season STRING, "
    "previous_season STRING, season_start_date STRING, display_week INT, "
    "league_create_season STRING, season_has_scores BOOLEAN"
)
LEAGUE = (
    "league_id STRING, name STRING, season STRING, season_type STRING, sport STRING, "
    "status STRING, total_rosters INT, draft_id STRING, previous_league_id STRING, "
    "last_message_time LONG, roster_positions ARRAY<STRING>, settings MAP<STRING, DOUBLE>, "
    "scoring_settings MAP<STRING, DOUBLE>, metadata MAP<STRING, STRING>"
)
ROSTER = (
    "league_id STRING, roster_id INT, owner_id STRING, co_owners ARRAY<STRING>, "
    "players ARRAY<STRING>, starters ARRAY<STRING>, taxi ARRAY<STRING>, reserve ARRAY<STRING>, "
    "settings MAP<STRING, DOUBLE>, metadata MAP<STRING, STRING>"
)
USER = (
    "league_id STRING, user_id STRING, display_name STRING, avatar STRING, is_bot BOOLEAN, "
    "is_owner BOOLEAN, metadata MAP<STRING, STRING>"
)
DRAFT = (
    "league_id STRING, draft_id STRING, season STRING, season_type STRING, status STRING, "
    "type STRING, created LONG, last_message_time LONG, draft_order MAP<STRING, INT>, "
    "settings MAP<STRING, DOUBLE>, metadata MAP<STRING, STRING>"
)
PLAYER = (
    "first_name STRING, last_name STRING, full_name STRING, position STRING, team STRING"
)

VIOLATIONS = (
    "dataset STRING, partition STRING, rule_id STRING, severity STRING, phase INT, "
    "sort_key STRING, rank INT, key STRING, observed STRING, expected STRING, message STRING"
)
