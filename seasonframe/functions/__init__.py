from seasonframe.functions.hashing import canonical_json, entry_digest, multiset_fingerprint
from seasonframe.functions.numeric import ordered_sum, prefix_int, round_cents, weighted_sum
from seasonframe.functions.text import document_key, is_blank, js_trim, normalized_name, player_key, position_code
from seasonframe.functions.time import age_days, season_of_date, snapshot_date_of

__all__ = [
    "age_days", "canonical_json", "document_key", "entry_digest", "is_blank", "js_trim",
    "multiset_fingerprint", "normalized_name", "ordered_sum", "player_key", "position_code", "prefix_int",
    "round_cents", "season_of_date", "snapshot_date_of", "weighted_sum",
]
