"""The operators applied to the given tables, each beside the SQL that must agree with it."""

from seasonframe.analog.registry import ORACLES, QUERIES
from seasonframe.analog import catalog, documents, files, landing, league, market, overlay, quality, stream, weekly  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
