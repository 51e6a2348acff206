"""The five warehouse tables, read from parquet (or any DataFrame source)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reviewcap.sources.schemas import conform


@dataclass(frozen=True)
class ReviewTables:
    dd_case: DataFrame
    case_state_change: DataFrame
    merchants: DataFrame
    payments: DataFrame
    requests: DataFrame

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> "ReviewTables":
        """Read each table with ``spark.read`` (columns pruned and filters pushed by Catalyst)."""
        def read(name: str) -> DataFrame:
            return conform(spark.read.format(fmt).load(paths[name]), name)
        return cls(*(read(n) for n in ("dd_case", "case_state_change", "merchants", "payments", "requests")))

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str]) -> "ReviewTables":
        """Use metastore tables (e.g. bucketed by profile id) by name."""
        def read(name: str) -> DataFrame:
            return conform(spark.table(names[name]), name)
        return cls(*(read(n) for n in ("dd_case", "case_state_change", "merchants", "payments", "requests")))
