"""Season statistics on Spark: totals, availability, markets, overlays, quality rules."""

__version__ = "0.1.0"
