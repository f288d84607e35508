"""The whole warehouse as stored tables: raw vault appended, everything above it rebuilt.

A run reads what is stored, appends the new keys, relationships and changed payloads, and rebuilds
business vault and marts from the stored raw vault. Running the same input again appends nothing.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.plans.warehouse import LOAD_TS, Build

RAW_VAULT = ["hub_company", "hub_concept", "hub_filing", "link_company_filing", "link_filing_concept_period", "sat_filing_metadata", "sat_company_metadata", "sat_concept_canonical", "sat_concept_value"]
REBUILT = ["pit", "bridge", "pl_trend", "peer_benchmark", "financial_health", "forecasts", "growth_forecast"]


def stored(spark: SparkSession, target: str, name: str) -> DataFrame | None:
    """A stored table, or None before its first load."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}/_SUCCESS")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{target}/{name}") if there else None


class Stored(Build):
    """``Build`` over a stored raw vault."""

    def __init__(self, spark: SparkSession, d: str, target: str, load_ts: datetime):
        super().__init__(spark, d, load_ts)
        self.target = target


def _reader(name: str) -> cached_property:
    def read(self: Stored) -> DataFrame:
        return stored(self.spark, self.target, name)

    prop = cached_property(read)
    prop.__set_name__(Stored, name)
    return prop


for _name in RAW_VAULT:
    setattr(Stored, _name, _reader(_name))


def run(spark: SparkSession, d: str, target: str, load_ts: datetime = LOAD_TS) -> dict[str, int]:
    """Load one delivery into ``target``; returns the rows appended (raw vault) or stored (rest)."""
    build = Build(spark, d, load_ts, lambda name: stored(spark, target, name))
    rows: dict[str, int] = {}
    for name in RAW_VAULT:
        old = stored(spark, target, name)
        before = old.count() if old is not None else 0
        getattr(build, name).write.mode("append").parquet(f"{target}/{name}")
        rows[name] = stored(spark, target, name).count() - before
    above = Stored(spark, d, target, load_ts)
    for name in REBUILT:
        getattr(above, name).write.mode("overwrite").parquet(f"{target}/{name}")
        rows[name] = spark.read.parquet(f"{target}/{name}").count()
    return rows
