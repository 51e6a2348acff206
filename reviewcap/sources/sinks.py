"""Result sinks: results stay distributed and are written by Spark, never collected."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewcap.session import ensure_checkpoint_dir


def store_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the folder that the cluster shares, and read back.

    For a result that several branches of a plan read: it is computed once,
    and later stages do not depend on the executors that computed it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/reviewcap-stored/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: Sequence[str] = ()) -> None:
    """Write a result table (e.g. per-unit plans partitioned by unit group) with ``df.write``."""
    w = df.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


POINTER = "_current"


def publish_result(df: DataFrame, folder: str) -> str:
    """Write ``df`` as a new version under ``folder`` and make it the current one; its path.

    Readers follow a pointer, a small table of its own that is written after
    the version is complete and names it.  So a writer that fails leaves an
    unfinished version that nobody reads, and a rerun adds a version and
    replaces the result, never doubles it.  Of several complete pointers the
    latest counts.
    """
    spark = df.sparkSession
    version = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(version)
    (spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published")).coalesce(1)
     .write.mode("append").parquet(f"{folder.rstrip('/')}/{POINTER}"))
    return version


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a published result."""
    pointers = spark.read.schema("version string, published timestamp").parquet(f"{folder.rstrip('/')}/{POINTER}")
    return spark.read.parquet(pointers.orderBy(F.desc("published")).first()["version"])


def preview(df: DataFrame, n: int = 20) -> str:
    """A bounded text preview (the console table of the source); only ``n`` rows reach the driver."""
    return df.limit(n).toPandas().to_string(index=False)
