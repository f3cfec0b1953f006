"""A message queue in a shared folder, as a stream source with offsets and acknowledgements, and its consumer.

Messages are published as Parquet files that a log names in order, so a message's number is its place in the log. The source
hands on at most ``in_flight`` messages at a time; how far it has handed on and what has been acknowledged is kept by
consumer in the queue's folder. Spark's checkpoint repeats a batch that failed as it was.

The consumer keeps what has to come again (busy, failed) in a bucketed table, with how often it was delivered and not before
when it comes; done messages leave no row, malformed ones and those over the limit are its bad rows. A batch is one numbered
merge, so a repeated batch counts no delivery twice and adds no bad row twice.

After a crash between handing on and Spark's log, the next batch may hold twice ``in_flight`` messages; none is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .buckets import Table
from .tables import stored

SCHEMA = "number long, payload string"
PENDING = "number long, payload string, deliveries int, not_before double, status string, reason string"
# Fixed values. Seconds until a failed message comes again.
WAIT_SECONDS = 20


class Folder:
    """Small JSON files of a queue, by any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.types = fs

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(self.types.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == self.types.FileType.File and not f.base_name.startswith((".", "_")))

    def read(self, name: str, default: dict) -> dict:
        if self.fs.get_file_info(f"{self.path}/{name}").type != self.types.FileType.File:
            return default
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def write(self, name: str, value: dict) -> None:
        """Whole or not at all: written beside and moved over."""
        draft = f"{self.path}/{name}.{uuid.uuid4().hex}.draft"
        self.fs.create_dir(draft.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(draft, f"{self.path}/{name}")

    def log(self) -> list[dict]:
        """Entries in order: first number, files with their rows."""
        return [self.read(f"log/{n}", {}) for n in self.names("log") if n.endswith(".json")]

    def end(self) -> int:
        log = self.names("log")
        if not log:
            return 0
        last = self.read(f"log/{[n for n in log if n.endswith('.json')][-1]}", {})
        return last["first"] + sum(rows for _, rows in last["files"])


def publish(messages: DataFrame, path: str, payload: str = "payload") -> int:
    """Append messages (a string column); the number after the last. One publisher at a time; files are a task's rows."""
    from pyarrow import parquet

    name, folder = f"data/{uuid.uuid4().hex}", Folder(path)
    messages.select(F.col(payload).cast("string").alias("payload")).write.parquet(f"{path}/{name}")
    files = [f"{name}/{n}" for n in folder.names(name) if n.endswith(".parquet")]
    sizes = [(f, parquet.read_metadata(folder.fs.open_input_file(f"{folder.path}/{f}")).num_rows) for f in files]
    first = folder.end()
    if sum(n for _, n in sizes):
        folder.write(f"log/{first:020d}.json", {"first": first, "files": [x for x in sizes if x[1]]})
    return folder.end()


class Part(InputPartition):
    """Rows of a file: which, and the number of its first one."""

    def __init__(self, path: str, file: str, first: int, begin: int, end: int) -> None:
        self.path, self.file, self.first, self.begin, self.end = path, file, first, begin, end


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.consumer, self.limit = options["path"], options.get("consumer", "default"), int(options.get("in_flight", 1000))
        self.folder = Folder(self.path)
        self.handed = self.folder.read(f"consumers/{self.consumer}.handed", {}).get("number", 0)

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        now = max(self.handed, min(self.handed + self.limit, self.folder.end()))
        if now > self.handed:
            self.handed = now
            self.folder.write(f"consumers/{self.consumer}.handed", {"number": now})
        return {"number": now}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        begin, till = start["number"], end["number"]
        self.handed = max(self.handed, till)
        out = []
        for entry in self.folder.log():
            first = entry["first"]
            for file, rows in entry["files"]:
                if first < till and first + rows > begin:
                    out.append(Part(self.path, file, first, max(begin, first), min(till, first + rows)))
                first += rows
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        folder, at = Folder(partition.path), partition.first
        with folder.fs.open_input_file(f"{folder.path}/{partition.file}") as f:
            for batch in parquet.ParquetFile(f).iter_batches(8192):
                a, b = max(partition.begin - at, 0), min(partition.end - at, len(batch))
                if a < b:
                    yield pa.RecordBatch.from_arrays([pa.array(range(at + a, at + b), pa.int64()), batch.column(0).slice(a, b - a).cast(pa.string())], ["number", "payload"])
                at += len(batch)

    def commit(self, end: dict) -> None:
        self.folder.write(f"consumers/{self.consumer}.acknowledged", end)

    def stop(self) -> None:
        pass


class Queue(DataSource):
    """Format ``presswork_queue``. Options: path, consumer, in_flight."""

    @classmethod
    def name(cls) -> str:
        return "presswork_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))


def messages(spark: SparkSession, path: str, consumer: str = "default", in_flight: int = 1000) -> DataFrame:
    """number, payload of the queue's messages as a stream."""
    spark.dataSource.register(Queue)
    return spark.readStream.format("presswork_queue").option("path", path).option("consumer", consumer).option("in_flight", in_flight).load()


def consumer(spark: SparkSession, path: str, work: Callable[[DataFrame], DataFrame], most: int = 5, wait: float = WAIT_SECONDS, buckets: int = 16, clock: Callable[[], float] | None = None) -> tuple[Callable[[DataFrame, int], None], Table]:
    """(foreachBatch writer; the table of messages that come again or are bad).

    work: a batch (number, payload, deliveries) with a column outcome: done, busy (comes again, no delivery counted), error (again after ``wait`` seconds, a delivery
    counted), malformed (bad at once). After ``most`` deliveries a message is bad. Its own effects have to stand being repeated.
    """
    import time

    now = clock or time.time
    table = Table(spark, path)
    if not table.versions():
        table = Table.create(spark.createDataFrame([], PENDING), path, "number", buckets)

    def write(batch: DataFrame, number: int) -> None:
        if table.manifest().writers.get("consumer", -1) >= number:
            return
        at = now()
        due = table.read().where((F.col("status") == "pending") & (F.col("not_before") <= at)).select("number", "payload", "deliveries")
        every = batch.select("number", "payload", F.lit(0).alias("deliveries")).unionByName(due)
        told = stored(work(every).select("number", "payload", "deliveries", "outcome"), "outcomes")  # work runs once, however often its outcomes are read
        tried = F.col("deliveries") + F.when(F.col("outcome") == "error", 1).otherwise(0)
        over = (F.col("outcome") == "malformed") | (tried >= most)
        kept = told.where(F.col("outcome") != "done").select(
            "number", "payload", tried.cast("int").alias("deliveries"), (F.lit(float(at)) + F.when(F.col("outcome") == "error", float(wait)).otherwise(0.0)).alias("not_before"),
            F.when(over, "bad").otherwise("pending").alias("status"), F.when(over, F.when(F.col("outcome") == "malformed", "malformed").otherwise("deliveries")).alias("reason"),
        )
        ended = told.where(F.col("outcome") == "done").select("number")

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select("number"), "number", "left_anti").unionByName(kept)

        table.merge(kept.select("number").unionByName(ended.join(table.read().select("number"), "number", "left_semi")), combine, "consumer", number)

    return write, table


def bad(table: Table) -> DataFrame:
    """number, payload, deliveries, reason of messages that don't come again."""
    return table.read().where("status = 'bad'").select("number", "payload", "deliveries", "reason")
