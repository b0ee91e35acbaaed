"""Scans of the named source tables.

``Tables`` reads one Parquet dataset per table lazily.  Nothing is selected
here: every consumer projects the columns it needs, and Catalyst prunes the
scan down to them (``ReadSchema`` in the plan) and pushes row filters into
the Parquet reader (``PushedFilters``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.params import Params

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Tables:
    """Lazy access to the source tables of one data folder, for one set of
    report parameters; organisation and customer lists limit the customer
    scan, and through the joins what hangs on it."""

    def __init__(self, spark: SparkSession, root: str, params: Params | None = None):
        self.spark = spark
        self.root = root
        self.params = params or Params()
        self._cache: dict[str, DataFrame] = {}

    def with_params(self, params: Params) -> Tables:
        """The same tables for other parameters; files are not listed again."""
        out = Tables(self.spark, self.root, params)
        out._cache = {n: df for n, df in self._cache.items() if n != "customer"}
        return out

    def path(self, name: str) -> str:
        direct = os.path.join(self.root, f"{name}.parquet")
        return direct

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            df = self.spark.read.parquet(self.path(name))
            for column, values in self.params.customer_limits().items() if name == "customer" else ():
                df = df.filter(F.col(column).isin(values))
            self._cache[name] = df
        return self._cache[name]

    def exists(self, name: str) -> bool:
        """S10 helper: is the optional source present?"""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(conf).exists(path) or self.spark.catalog.tableExists(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)
