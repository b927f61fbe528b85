"""Structured Streaming forms of the demand counts, in append mode: windows leave the state once the watermark has passed them.

Each form has a batch twin that gives the same rows. A bounded stream is closed by a mark, a row of
nulls but for a time far ahead, which moves the watermark over all windows; its own is never written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from evidloom.tables import dropped, new_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DELAY = "1 day"
END = "2250-01-01 00:00:00"  # within what pandas can hold


def events(spark: SparkSession, path: str) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)


def tumbling(df: DataFrame, width: str = "1 hour") -> DataFrame:
    return df.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sliding(df: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    return df.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return df.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(df: DataFrame, key: str = "event_id") -> DataFrame:
    """At-least-once delivery made exactly-once by key; a key is forgotten once the watermark has passed it."""
    return df.dropDuplicatesWithinWatermark([key])


def _with(schema: StructType, **columns: str) -> StructType:
    more = StructType()
    for name, kind in columns.items():
        more.add(name, kind)
    return StructType([*schema.fields, *more.fields])


class Appended:
    """A stream with a watermark and a mark at its end, run in append mode over whatever is there, as often as called."""

    def __init__(self, stream: DataFrame, build: Callable[[DataFrame], DataFrame], time: str = "ts", delay: str = DELAY):
        self.spark, self.schema, self.time = stream.sparkSession, stream.schema, time
        self.folder = new_folder(self.spark, "stream")
        self.spark.createDataFrame([], self.schema).write.parquet(f"{self.folder}/marks")
        marks = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/marks")
        self.out = build(stream.unionByName(marks).withWatermark(time, delay))
        self.progress: list[dict] = []

    def run(self) -> None:
        query = self.out.writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/state").option("path", f"{self.folder}/rows").format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress += query.recentProgress

    def close(self) -> DataFrame:
        """Moves the watermark past all, and reads all that was written."""
        mark = self.spark.range(1).select(*[(F.lit(END).cast("timestamp") if f.name == self.time else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema])
        mark.write.mode("append").parquet(f"{self.folder}/marks")
        self.run()
        return self.rows()

    def rows(self) -> DataFrame:
        out = self.spark.read.schema(self.out.schema).parquet(f"{self.folder}/rows")
        return out.where(F.col(self.time) < F.lit(END).cast("timestamp")) if self.time in out.columns else out  # without the mark itself

    def state_rows(self) -> list[int]:
        """Rows in state after each batch."""
        return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in self.progress]


def drained(stream: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that a stream gives over what is there."""
    run = Appended(stream, build)
    run.run()
    return run.close()


def drained_rows(stream: DataFrame) -> DataFrame:
    """All rows of a stream that needs no state, once it has run over what is there."""
    path = new_folder(stream.sparkSession, "stream")
    query = stream.writeStream.option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


class Arrivals:
    """Takes in a stream and keeps rows that come too late apart: those no later than the watermark, the latest time of all batches before less the delay.

    Rows go to ``<folder>/rows/late=false`` or ``late=true``. A batch writes its own part, so one that is run again replaces what it
    wrote; the latest time so far goes on with each batch. What is in time may be streamed on: an operator with the same delay drops none of it.
    """

    def __init__(self, stream: DataFrame, time: str = "ts", delay: str = DELAY):
        self.spark, self.stream, self.time, self.delay = stream.sparkSession, stream, time, delay
        self.folder = new_folder(self.spark, "arrivals")

    def _batch(self, batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, f"{self.folder}/latest/{number}"
        latest = spark.read.parquet(f"{self.folder}/latest/{number - 1}").first()[0] if number else None
        mark = F.lit(latest) - F.expr(f"INTERVAL {self.delay}") if latest is not None else None
        late = F.coalesce(F.col(self.time) <= mark, F.lit(False)) if mark is not None else F.lit(False)
        part = f"{self.folder}/rows/batch={number}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(part)
        now = spark.read.schema(_with(batch.schema, late="boolean")).parquet(part).agg(F.max(self.time).alias("t"))
        now.select(F.greatest("t", F.lit(latest).cast("timestamp")).alias("t")).write.mode("overwrite").parquet(path)
        if number > 1:
            dropped(spark, f"{self.folder}/latest/{number - 2}")

    def run(self) -> None:
        query = self.stream.writeStream.option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(self._batch).start()
        query.awaitTermination()

    def _schema(self) -> StructType:
        return _with(self.stream.schema, batch="integer", late="boolean")

    def late_rows(self) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(f"{self.folder}/rows").where("late").drop("late")

    def in_time(self) -> DataFrame:
        """The other rows, as a stream."""
        return self.spark.readStream.schema(self._schema()).parquet(f"{self.folder}/rows").where("NOT late").drop("late", "batch")
