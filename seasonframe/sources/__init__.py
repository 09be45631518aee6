from seasonframe.sources.documents import (
    array_documents, keyed_documents, read_college, read_manifest, read_overlay, read_overlays,
    read_players, read_season_totals, read_snapshots, read_state, read_weekly,
)
from seasonframe.sources.league import (
    read_drafts, read_leagues, read_rosters, read_users, roster_players, scoring_weights,
)
from seasonframe.sources.tables import path_or_empty, read_or_empty

__all__ = [
    "array_documents", "keyed_documents", "path_or_empty", "read_college", "read_drafts",
    "read_leagues", "read_manifest", "read_or_empty", "read_overlay", "read_overlays",
    "read_players", "read_rosters", "read_season_totals", "read_snapshots", "read_state",
    "read_users", "read_weekly", "roster_players", "scoring_weights",
]
