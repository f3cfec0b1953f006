"""Access to the test tables by name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share.

    Only where it is unset and one machine does all (local tests) a temporary folder serves; on a
    cluster executors wouldn't see each other's files there, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="presswork-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and committed files survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
