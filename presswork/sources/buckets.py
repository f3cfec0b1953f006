"""Keyed tables that are merged in place: rows in buckets of their key's hash, versions in small manifests.

A table is a folder: ``data`` holds Parquet files, each of rows of one bucket, and ``manifests`` a JSON file for each version that
names the files of every bucket. A merge reads and rewrites the buckets that new rows fall into and no other, and
becomes visible when its manifest is put in place by one rename, which fails if another version came first; then the merge is done again
on that version. Whatever fails before leaves the old version as it is, and files that no manifest names are
never read (``vacuum`` removes them). A writer numbers its merges; one whose number was already committed changes nothing.

How rows are merged is a function of (stored rows of those buckets, new rows): sinks.upsert, update_existing and carry_forward are such.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Combine = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET = "__bucket"
#: Times that a merge is done again because another one was committed meanwhile.
RETRIES = 5


class VersionTaken(Exception):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Manifest:
    """version; key column; number of buckets; the rows' schema; files of each bucket that has any; latest merge of each writer."""

    version: int
    key: str
    buckets: int
    schema: str
    files: dict[str, list[str]] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)


class Table:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self.jvm, self.at = jvm, jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> Table:
        """A table of rows (version 1), one for each key; buckets: so many that one is a task's work."""
        table = cls(rows.sparkSession, path)
        if table.versions():
            raise VersionTaken(path)
        empty = Manifest(0, key, buckets, rows.schema.json())
        table.commit(replace(empty, version=1, files=table.write(rows, empty)))
        return table

    def versions(self) -> list[int]:
        where = self.at(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        stream = self.fs.open(self.at(f"{self.path}/manifests/{version or self.versions()[-1]}.json"))
        try:
            return Manifest(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def commit(self, manifest: Manifest) -> None:
        """Put a manifest in place, whole or not at all."""
        draft = self.at(f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(asdict(manifest)), "utf-8"))
        finally:
            stream.close()
        names = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if ":" in self.path else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            names.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.at(f"{self.path}/manifests/{manifest.version}.json")), none)
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                raise VersionTaken(manifest.version) from error
            raise

    def bucket_of(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def write(self, rows: DataFrame, manifest: Manifest) -> dict[str, list[str]]:
        """New files of rows, by bucket; nobody reads them before a manifest names them."""
        name = f"{manifest.version + 1}-{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self.bucket_of(F.col(manifest.key), manifest.buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, manifest.key)
        dealt.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        out: dict[str, list[str]] = {}
        for folder in self.fs.listStatus(self.at(f"{self.path}/data/{name}")):
            bucket = folder.getPath().getName()
            if bucket.startswith(f"{BUCKET}="):
                out[bucket.split("=")[1]] = [f"{name}/{bucket}/{f.getPath().getName()}" for f in self.fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
        return out

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The rows of a version (the newest), or of some of its buckets."""
        return self.rows(self.manifest(version), buckets)

    def rows(self, manifest: Manifest, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        files = [f"{self.path}/data/{f}" for b, some in manifest.files.items() if buckets is None or b in buckets for f in some]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def touched(self, new: DataFrame, manifest: Manifest) -> list[str]:
        """Buckets that new rows fall into: at most as many as there are."""
        return [str(r[0]) for r in new.select(self.bucket_of(F.col(manifest.key), manifest.buckets).alias("b")).distinct().collect()]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the keys (column as the table's key), from their buckets only."""
        manifest = self.manifest()
        return self.rows(manifest, self.touched(keys, manifest)).join(keys.select(manifest.key).distinct(), manifest.key, "left_semi")

    def merge(self, new: DataFrame, combine: Combine, writer: str = "", number: int | None = None) -> Manifest:
        """The version that holds combine(stored, new) in the buckets of new and what was there in the others.

        new is read twice (its buckets, its rows): deterministic. With a number, a merge of a writer that has committed it or a later one is nothing.
        """
        for _ in range(RETRIES):
            before = self.manifest()
            if number is not None and before.writers.get(writer, -1) >= number:
                return before
            buckets = self.touched(new, before)
            if not buckets and number is None:
                return before
            made = self.write(combine(self.rows(before, buckets), new), before)
            strays = set(made) - set(buckets)
            if strays:
                raise ValueError(f"a merge gave rows of buckets that new rows don't fall into: {sorted(strays)}")
            files = {b: some for b, some in before.files.items() if b not in buckets} | made
            after = replace(before, version=before.version + 1, files=files, writers=before.writers | ({writer: number} if number is not None else {}))
            try:
                self.commit(after)
                return after
            except VersionTaken:
                continue
        raise VersionTaken(f"{RETRIES} merges were overtaken")

    def resize(self, buckets: int) -> Manifest:
        """The same rows in another number of buckets, as a new version."""
        before = self.manifest()
        wider = replace(before, buckets=buckets)
        after = replace(wider, version=before.version + 1, files=self.write(self.rows(before), wider))
        self.commit(after)
        return after

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` versions and the folders of files that none of them names; how many folders went."""
        kept = self.versions()[-keep:]
        used = {f.split("/")[0] for v in kept for some in self.manifest(v).files.values() for f in some}
        for v in self.versions()[:-keep]:
            self.fs.delete(self.at(f"{self.path}/manifests/{v}.json"), False)
        gone = [s.getPath() for s in self.fs.listStatus(self.at(f"{self.path}/data")) if s.getPath().getName() not in used]
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)


def merging_sink(table: Table, combine: Combine, writer: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: each micro-batch is one merge, numbered by the batch, so that one that is repeated after a failure changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        table.merge(batch, combine, writer, number)

    return write
