"""Codes, limits and name lists that results depend on."""

from __future__ import annotations

WEEKS = 18

# Weekly status codes: played, did not play, bye, absent.
PLAYED, DNP, BYE, ABSENT = "P", "D", "B", "X"

POINTS_KEY = "pts_half_ppr"
SCORING_BASIS = "half_ppr"
ABSENCE_CAUSE = "unknown"

# The 32 team codes.
TEAMS = (
    "ARI", "ATL", "BAL", "BUF", "CAR", "CHI", "CIN", "CLE",
    "DAL", "DEN", "DET", "GB", "HOU", "IND", "JAX", "KC",
    "LAC", "LAR", "LV", "MIA", "MIN", "NE", "NO", "NYG",
    "NYJ", "PHI", "PIT", "SEA", "SF", "TB", "TEN", "WAS",
)

# Overlay types in scan order, with the prefix of their ids.
OVERLAY_PREFIX = {"coaching": "coach", "scheme": "scheme", "injuries": "inj", "notes": "note"}
OVERLAY_TYPES = tuple(OVERLAY_PREFIX)

COACHING_ROLES = ("HC", "OC", "DC")
MIN_YEAR = 2012

# Fields an overlay entry must carry besides its id.
REQUIRED_FIELDS = {
    "coaching": ("year", "team", "role", "name"),
    "scheme": ("year", "team"),
    "injuries": ("playerId", "year", "segmentStartWeek"),
    "notes": ("body",),
}

# Fixed values: (season, player id, least games, name) that a season must hold.
SEASON_SENTINELS = (
    (2024, "6783", 15, "Lamar Jackson"),
    (2024, "4866", 14, "Tyreek Hill"),
    (2024, "6794", 14, "Justin Jefferson"),
    (2023, "6783", 16, "Lamar Jackson"),
    (2023, "4866", 14, "Tyreek Hill"),
    (2023, "6794", 8, "Justin Jefferson"),
)

# Names of which at least three belong in the top ten by value.
MARKET_SENTINELS = (
    "Josh Allen", "Drake Maye", "Caleb Williams",
    "Jalen Hurts", "Jayden Daniels", "Patrick Mahomes",
)
MARKET_POSITIONS = ("QB", "RB", "WR", "TE")

# statType codes by college category.
COLLEGE_STAT_TYPES = {
    "passing": ("YDS", "TD", "YPA", "COMPLETIONS", "INT", "PCT", "ATT"),
    "receiving": ("YDS", "TD", "REC", "YPR", "LONG"),
    "rushing": ("YDS", "TD", "CAR", "YPC", "LONG"),
}

# Quality limits.
SEASON_MIN_PLAYERS = 400
SEASON_FULL_GAMES = 14
SEASON_MIN_FULL = 30
COLLEGE_MIN_ROWS = 500
COLLEGE_MIN_PLAYERS = 200
MARKET_ROWS = (250, 600)
MARKET_MIN_PER_POSITION = 5
MARKET_VALUE_RANGE = (0, 9999)
MARKET_TOP = 10
MARKET_MIN_SENTINELS = 3
MARKET_MAX_CHANGED = 0.70
MARKET_MAX_AGE_DAYS = 8

POINTS_TOLERANCE = 0.01
LISTING_PAGE_ROWS = 50
LISTING_MAX_PAGES = 10
SUPPORTED_SCHEMA_VERSION = 2
SEASON_SCHEMA_VERSION = 2
