"""Exactly-once sinks of micro-batches into Parquet tables, by a ledger of the batches that are in.

A batch is written to a folder of its own number and only then entered in the ledger; readers take what the ledger holds. A
batch that is run again, after a crash before its entry or a replay, overwrites its own folder or, if it is entered, is
passed over. So each row is in once, whatever is repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder


class LedgerSink:
    """A table below `path`, a folder that all executors share. One query writes to it at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_folder(spark)}/sink-{uuid.uuid4().hex}"

    def _read(self, folder: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}") if there else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """(batch, rows) of every batch that is in."""
        return self._read("ledger", "batch long, rows long")

    def table(self, schema: str) -> DataFrame:
        """The rows of all batches that are in, with their batch."""
        return self._read("rows", f"{schema}, batch long").join(F.broadcast(self.ledger().select("batch")), "batch", "left_semi")

    def append(self, batch: DataFrame, number: int) -> bool:
        """Write a batch; False if it is in already."""
        if not self.ledger().filter(F.col("batch") == number).isEmpty():
            return False
        folder = f"{self.path}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        rows = self.spark.read.schema(batch.schema).parquet(folder).count()
        self.spark.createDataFrame([(number, rows)], "batch long, rows long").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return True


def into(stream: DataFrame, write: Callable[[DataFrame, int], None], place: str | None = None) -> None:
    """Take all that a stream has now, a micro-batch at a time; the progress is kept in `place`."""
    place = place or f"{checkpoint_folder(stream.sparkSession)}/progress-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def documents_sink(sink: LedgerSink) -> Callable[[DataFrame, int], None]:
    """Get or create: rows (content_hash, document_id, ...) of which the sink keeps the least of each hash that it lacks."""
    schema = "content_hash string, document_id long"

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.filter("content_hash is not null").groupBy("content_hash").agg(F.min("document_id").alias("document_id"))
        known = sink.table(schema).filter(F.col("batch") < number).select("content_hash")  # a batch run again does not meet its own rows
        sink.append(fresh.join(known, "content_hash", "left_anti"), number)

    return write


def documents_in(sink: LedgerSink) -> DataFrame:
    return sink.table("content_hash string, document_id long").drop("batch")


def appended(sink: LedgerSink) -> Callable[[DataFrame, int], None]:
    """Every row of every batch, once: audit entries, frames of events."""
    return lambda batch, number: sink.append(batch, number) and None
