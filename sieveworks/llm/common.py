"""What the operators of this subpackage share: scratch tables in the shared folder, sizes, table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveworks.operators.graph import written as materialize

__all__ = ["materialize", "shuffle_partitions", "table"]


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
