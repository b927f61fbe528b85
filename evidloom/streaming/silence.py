"""Keys that fall silent, and that are heard again, by event-time timers.

For each key the state holds the last time that is final and times still ahead of the watermark, since
earlier rows may yet come between them. A time becomes final once the watermark has passed it. A key is
marked stale once, when it was silent for ``silence`` up to the watermark, and recovers with its next row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, as timers ask for."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Silence(StatefulProcessor):
    """Rows are (key, heard: epoch microseconds); a null time is a mark that only moves the watermark."""

    def __init__(self, key: str, silence: int):
        self.key, self.silence = key, silence

    def init(self, handle) -> None:
        self.handle = handle
        # One value a key, since each call to a state is a message to the JVM: the last final time, whether it was marked, the timer that is set, times ahead.
        self.state = handle.getValueState("state", "last long, stale boolean, timer long, ahead array<long>")

    def _settled(self, key, before, ahead: list[int], watermark: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        """Makes final what the watermark has passed, and sets a timer for what comes next."""
        last, stale, timer = before[:3] if before else (None, False, None)
        out, rest = [], []
        for at in sorted(ahead):
            if at > watermark:
                rest.append(at)
                continue
            if last is not None and at - last > self.silence and not stale:
                out.append((key, "stale", last + self.silence))
                stale = True
            if stale:
                out.append((key, "recovered", at))
            last, stale = at, False
        if last is not None and not stale and last + self.silence <= watermark:
            out.append((key, "stale", last + self.silence))
            stale = True
        following = rest[:1] + ([last + self.silence] if last is not None and not stale else [])
        due = -(-min(following) // 1000) if following else None  # milliseconds
        if timer == expired:
            timer = None  # it is gone once it has run
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((last, stale, due, rest))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "state", "at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.state.get()
        final, ahead = (before[0], list(before[3])) if before else (None, [])
        for frame in rows:
            times = frame["heard"].dropna().astype("int64")
            ahead += (times if final is None else times[times > final]).tolist()
        yield from self._settled(key[0], before, ahead, 1000 * timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.state.get()
        yield from self._settled(key[0], before, list(before[3]) if before else [], 1000 * timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def silences(stream: DataFrame, key: str, time: str = "ts", silence_minutes: int = 5) -> DataFrame:
    """(key, state, at): 'stale' at the end of each silence and 'recovered' at the row that ends it. The stream has a watermark, and starts within ``rocksdb``."""
    rows = stream.select(F.coalesce(key, F.lit(-1)).cast("long").alias(key), time, F.when(F.col(key).isNotNull(), F.unix_micros(time)).alias("heard"))
    out = f"{key} long, state string, at long"
    found = rows.groupBy(key).transformWithStateInPandas(Silence(key, silence_minutes * 60_000_000), out, "Append", "EventTime")
    return found.select(key, "state", F.timestamp_micros("at").alias("at"))


def silences_of_batch(rows: DataFrame, key: str, time: str = "ts", silence_minutes: int = 5) -> DataFrame:
    """The same rows by a window over a whole table, to whose end all keys fall silent."""
    from pyspark.sql import Window

    at = F.unix_micros(time)
    w = Window.partitionBy(key).orderBy("_t")
    gaps = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), at.alias("_t")).withColumn("_next", F.lead("_t").over(w))
    gaps = gaps.where(F.col("_next").isNull() | (F.col("_next") - F.col("_t") > silence_minutes * 60_000_000))
    ends = F.array(F.struct(F.lit("stale").alias("state"), (F.col("_t") + silence_minutes * 60_000_000).alias("at")), F.struct(F.lit("recovered").alias("state"), F.col("_next").alias("at")))
    return gaps.select(key, F.explode(F.filter(ends, lambda e: e["at"].isNotNull())).alias("e")).select(key, "e.state", F.timestamp_micros("e.at").alias("at"))
