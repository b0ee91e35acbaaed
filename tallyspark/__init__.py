"""tallyspark: ledger, supply-chain and workforce reporting operators on Spark.

Every operator is a plain function from DataFrames (and parameters) to a
DataFrame, built only from Spark SQL expressions so that Catalyst can push
filters into the Parquet scan, prune columns and pick join strategies.

Layout
------
functions/  column-level helpers (Oracle-compatible scalars, parameters)
sources/    table access, stand-in business tables, constants, calendars, sinks
operators/  generic relational building blocks (joins, effective dating,
            latest-version selection, rollups, windows, aging, chains, quality)
plans/      report compositions and the query catalogue used by the driver
streaming/  Structured Streaming variants of the alert reports
"""

from tallyspark.session import get_session, tune_session, checkpoint_dir

__all__ = ["get_session", "tune_session", "checkpoint_dir"]
