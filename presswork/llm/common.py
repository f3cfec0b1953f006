"""Shared pieces of the training-data operators: scratch tables, tokenising, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space, so
#: that ``text.encode().translate(WORDS).split()`` gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORDS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256)).translate(LOWER)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's spark.checkpoint.dir.

    Only where that is unset and one machine does all (local tests) a temporary folder is made and
    set; on a cluster executors wouldn't see each other's files there, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="presswork-")
    sc.setCheckpointDir(where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    This cuts lineage and fixes values that a recomputation could change; committed files
    survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with releasing(spark):
        df.write.option("compression", "zstd").parquet(path)
    for made in _made:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: With this a query's shuffle files are deleted as it ends; otherwise they stay until the driver happens to collect its garbage.
RELEASES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Queries that are run whole in the block (writes, collects) leave no shuffle files behind."""
    before = spark.conf.get(RELEASES, None)
    spark.conf.set(RELEASES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASES)
        else:
            spark.conf.set(RELEASES, before)


#: Lists of the tables written within discarding() blocks that are open.
_made: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the table of a materialized frame that nothing will read any more."""
    remove(df.sparkSession, df.scratch_path)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is materialized in the block at its end, but for the frames given to what it yields.

    All that reads such a table has to be materialized in the block too.
    """
    mine: list[str] = []
    kept: set[str] = set()
    _made.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch_path)
        return df

    try:
        yield keep
    finally:
        _made.remove(mine)
        for path in mine:
            if path not in kept:
                remove(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as keep it apart from df's columns in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(column: str, modulus: int) -> F.Column:
    """crc32 of an id's text, modulo; null ids have no fold."""
    return F.crc32(F.col(column).cast("string")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
