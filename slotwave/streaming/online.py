"""Slot counts and recursive scores on streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_slot_counts(stream: DataFrame, ts: str, item: str, slot: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """timestamp, item_id, count per slot in append mode; rows later than the watermark are dropped."""
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, slot), F.col(item).cast("string").alias("item_id")).agg(F.count("*").alias("count"))
    return counts.select(F.col("window.start").alias("timestamp"), "item_id", "count")


def fold(sums: dict[int, float], last: int | None, af: float, ewma: float, alpha: float) -> tuple[int, float, float]:
    """Last slot and scores after the counts of some slots; slots already passed are added with the decay they would have by now."""
    for slot, n in sorted(sums.items()):
        gap = 0 if last is None else slot - last
        if last is None:
            af, ewma, last = n, n, slot
        elif gap > 0:
            af, ewma, last = n + af * 0.5**gap, alpha * n + ewma * (1 - alpha) ** gap, slot
        else:
            af, ewma = af + n * 0.5 ** (-gap), ewma + alpha * n * (1 - alpha) ** (-gap)
    return last, af, ewma


def stream_decay_scores(counts: DataFrame, slot_seconds: int, alpha: float = 0.2) -> DataFrame:
    """Untruncated AF and EWMA of each item after its newest slot, from (timestamp, item_id, count).

    AF halves and EWMA shrinks by 1 - alpha for every empty slot since the item's last one; the
    state of an item is its last slot and the two scores. Counts of a slot already passed are
    added with the decay they would have by now.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, af, ewma = state.get if state.exists else (None, 0.0, 0.0)
        sums: dict[int, float] = {}  # one entry a slot, whatever the number of rows
        for rows in batches:
            slots = (rows["timestamp"].astype("datetime64[s]").astype("int64") // slot_seconds).to_numpy()
            for slot, n in pd.Series(rows["count"].to_numpy(float)).groupby(slots).sum().items():
                sums[slot] = sums.get(slot, 0.0) + n
        last, af, ewma = fold(sums, last, af, ewma, alpha)
        state.update((int(last), float(af), float(ewma)))
        yield pd.DataFrame({"item_id": [key[0]], "slot": [int(last)], "af": [af], "ewma": [ewma]})

    return counts.groupBy("item_id").applyInPandasWithState(step, "item_id string, slot long, af double, ewma double", "slot long, af double, ewma double", "update", "NoTimeout")


class Decay(StatefulProcessor):
    """State of stream_expiring_scores: last slot, AF and EWMA of an item, and one event-time timer."""

    def __init__(self, slot_seconds: int, dormant: int, alpha: float):
        self.slot_seconds, self.dormant, self.alpha = slot_seconds, dormant, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("scores", "slot long, af double, ewma double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, af, ewma = self.state.get() if self.state.exists() else (None, 0.0, 0.0)
        sums: dict[int, float] = {}
        for batch in rows:
            slots = (batch["timestamp"].astype("datetime64[s]").astype("int64") // self.slot_seconds).to_numpy()
            for slot, n in pd.Series(batch["count"].to_numpy(float)).groupby(slots).sum().items():
                sums[slot] = sums.get(slot, 0.0) + n
        last, af, ewma = fold(sums, last, af, ewma, self.alpha)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # due when the watermark has passed the last of the empty slots
        self.handle.registerTimer((last + self.dormant + 1) * self.slot_seconds * 1000)
        self.state.update((int(last), float(af), float(ewma)))
        yield self._row(key, last, af, ewma, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, af, ewma = self.state.get()
        self.state.clear()
        yield self._row(key, last + self.dormant, af * 0.5**self.dormant, ewma * (1 - self.alpha) ** self.dormant, True)

    def close(self) -> None:
        pass

    def _row(self, key: tuple, slot: int, af: float, ewma: float, dropped: bool) -> pd.DataFrame:
        return pd.DataFrame({"item_id": [key[0]], "slot": [int(slot)], "af": [float(af)], "ewma": [float(ewma)], "dropped": [dropped]})


def stream_expiring_scores(counts: DataFrame, slot_seconds: int, dormant: int, delay: str = "6 hours", alpha: float = 0.2) -> DataFrame:
    """stream_decay_scores whose state is bounded: an item without counts for `dormant` slots is let go.

    Each item has one event-time timer. When the watermark (the newest timestamp less `delay`) has passed
    `dormant` empty slots after the item's last one, its scores are decayed up to there and given out with
    dropped true, and its state is removed. What an item that comes back starts without
    is at most AF x 2^-dormant and EWMA x (1 - alpha)^dormant. Rows behind the watermark do not
    reach the state; Spark counts them (state_sizes reads both numbers). Start it inside rocksdb().
    """
    step = Decay(slot_seconds, dormant, alpha)
    return counts.withWatermark("timestamp", delay).groupBy("item_id").transformWithStateInPandas(
        step, "item_id string, slot long, af double, ewma double, dropped boolean", "update", "eventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that timers need, for the queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def state_sizes(progress: list) -> list[tuple[int, int]]:
    """(rows in state, rows passed over as late) of each micro-batch, from a query's recentProgress."""
    return [(s["numRowsTotal"], s["numRowsDroppedByWatermark"]) for p in progress for s in p["stateOperators"]]


def counted(stream: DataFrame, folder: str) -> DataFrame:
    """A stream of (timestamp, item_id, count) from a bounded stream of (timestamp, item_id): each micro-batch is aggregated by Spark and written to a shared folder first."""
    count = lambda batch, i: batch.groupBy("timestamp", "item_id").agg(F.count("*").alias("count")).write.mode("overwrite").parquet(f"{folder}/rows/batch={i}")
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(count).start().awaitTermination()
    return stream.sparkSession.readStream.schema("timestamp timestamp, item_id string, count long").parquet(f"{folder}/rows/batch=*")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All results of a bounded stream as a table in a shared folder: what a file source holds now is processed, then the query ends.

    In update mode each micro-batch adds its rows, so a key may have several.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/rows").outputMode("append")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}"))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
