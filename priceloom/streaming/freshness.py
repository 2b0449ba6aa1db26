"""The last event of each key and whether it is still fresh, as a stream with a state and a timer for each key.

A key's state is its last event, by time and then by the order given. An event that is later than it replaces it, is given out
as fresh, and sets the timer to the time at which it goes stale; when the watermark passes that time, the event is given out
once more as stale. Earlier and repeated events change nothing, in whatever batch they come. Events of no time or key go, and
so do those that come more than `late` after later ones: the watermark drops them, and with them what has gone stale already.

The states are kept by Spark's state store (RocksDB) and written with each batch, so a query that is started again from its
checkpoint, on other executors, goes on where it was. `standing` reads what the stream has given out so far.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: at: the time in microseconds.
STATE = "at long, place long, value double"
OUTPUT = "key string, at long, place long, value double, fresh boolean, step long"


class Freshness(StatefulProcessor):
    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        # How many rows the key has given out, which orders them.
        self.steps = handle.getValueState("steps", "step long")

    def _given(self, key, event, fresh: bool) -> Iterator[Row]:
        step = (self.steps.get()[0] if self.steps.exists() else 0) + 1
        self.steps.update((step,))
        yield Row(key=key[0], at=event[0], place=event[1], value=event[2], fresh=fresh, step=step)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(((r.at, r.place, r.value) for r in rows), key=lambda e: e[:2])
        known = self.last.get() if self.last.exists() else None
        if known is None or newest[:2] > (known[0], known[1]):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update(newest)
            # Stale from the first millisecond after the last fresh one.
            self.handle.registerTimer(newest[0] // 1000 + self.seconds * 1000 + 1)
            yield from self._given(key, newest, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._given(key, tuple(self.last.get()), False)


def freshness(events: DataFrame, seconds: int, late: str = "2 hours") -> DataFrame:
    """key, ts, place, value, fresh, step of a stream of events (key, ts, place, value); place orders events of one time."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("place").cast("long"), F.lit(0)).alias("place"), F.col("value").cast("double").alias("value"))
    rows = rows.filter("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_micros("ts"))
    given = rows.groupBy("key").transformWithState(Freshness(seconds), OUTPUT, "append", "eventTime")
    return given.select("key", F.timestamp_micros("at").alias("ts"), "place", "value", "fresh", "step")


def standing(given: DataFrame) -> DataFrame:
    """key, ts, value, fresh: of what the stream has given out the last row of each key."""
    return given.groupBy("key").agg(F.max_by(F.struct("ts", "value", "fresh"), "step").alias("last")).select("key", "last.*")


def run(spark: SparkSession, events: DataFrame, seconds: int, folder: str, checkpoint: str, late: str = "2 hours") -> None:
    """Process what there is and stop; the next run goes on from the checkpoint."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        out = freshness(events, seconds, late)
        out.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)
