"""A limit on requests as they arrive: a sliding log per client, kept as state, which a timer drops when it has run empty."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingLog(StatefulProcessor):
    """Admits a request if fewer than ``most`` admitted ones lie less than ``seconds`` before it; a refused one is not counted.

    A client's state is the times of its admitted requests of the last ``seconds``: ``most`` numbers at most."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")  # a client's requests of one batch
        log, out = deque(x[0] for x in self.log.get()) if self.log.exists() else deque(), []
        for at in held["at"].tolist():
            while log and log[0] <= at - self.seconds:
                log.popleft()
            out.append(len(log) < self.most)
            if out[-1]:
                log.append(at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if log:
            self.log.put([(x,) for x in log])
            self.handle.registerTimer((log[-1] + self.seconds) * 1000)
        else:
            self.log.clear()
        yield held.assign(allowed=out)[["client", "at", "id", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_admitted(spark: SparkSession, folder: str, schema: StructType, requests, out: str, log: str, most: int, seconds: int, delay: str) -> DataFrame:
    """client, at, id, allowed of all requests that have come to ``folder``; requests that are later than ``delay`` get no answer.

    ``requests`` makes rows (client, at in seconds, id, ts) of a stream of the folder's Parquet files. Decisions follow the order of batches, and within one
    that of (at, id). A batch writes its decisions below its own number, over what an earlier attempt left."""
    arriving = requests(spark.readStream.schema(schema).parquet(folder)).withWatermark("ts", delay)
    kinds = ", ".join(f"{c} {arriving.schema[c].dataType.simpleString()}" for c in ("client", "at", "id"))
    decided = arriving.groupBy("client").transformWithStateInPandas(SlidingLog(most, seconds), f"{kinds}, allowed boolean", "append", "eventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the state store that such processors need
    try:
        decided.writeStream.outputMode("append").option("checkpointLocation", log).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.parquet(out).drop("batch")
