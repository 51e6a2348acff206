"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}


def col(name: str) -> Column:
    """A column by its exact name (dots and spaces are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on a local master without that setting (tests) gets a
    scratch folder of its own, one per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: point it at a folder every executor shares")
    app = spark.conf.get("spark.app.id")
    return _LOCAL_SHARED.setdefault(app, tempfile.mkdtemp(prefix="reviewcap-llm-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under ``reviewcap-llm/<application id>``."""
    return f"{shared_folder(spark)}/reviewcap-llm/{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: later stages read the files, also after executors
    were lost.  The schema is given on reading, so an empty table works.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def one_of_repeated(docs: DataFrame, key: Column, tie: Column, again: DataFrame) -> DataFrame:
    """``docs`` with one row of each (key, tie) that ``again`` (columns key, tie) lists, and all other rows."""
    again = stored(again.toDF("_again_key", "_again_tie"), "repeated-rows")
    if again.isEmpty():
        return docs
    same = key.eqNullSafe(F.col("_again_key")) & (tie == F.col("_again_tie"))
    one = docs.join(again, same, "left_semi").withColumns({"_again_key": key, "_again_tie": tie}).dropDuplicates(["_again_key", "_again_tie"])
    return docs.join(again, same, "left_anti").union(one.drop("_again_key", "_again_tie"))
