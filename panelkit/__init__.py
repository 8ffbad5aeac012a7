"""panelkit: Spark-native panel and time-series analytics.

Ingest per-entity delimited files into one typed table, build an entity x day
panel with static attributes and region x day covariates, profile its
quality, draw reproducible samples and splits, and fit/evaluate statistical
models whose row passes run as Spark jobs (only coefficient-sized results
reach the driver).
"""

__version__ = "0.1.0"
