"""A response cache over a stream of requests, with a lifetime for each outcome.

Requests of a key are decided in order of time: one that finds an answer in force is a hit; any other is a real call, and its
answer is kept for as long as its outcome allows (success long, failure short), from its own time on. An expired key is
revived by its next request. The state holds one entry for each key whose answer is in force; a timer takes it out once the
watermark has passed its end, so state grows with live answers, not with keys ever seen. The entry and its timer are in
the checkpoint: a stream that begins anew goes on as if it had not stopped.

Defined cases: a lifetime of nothing or less keeps no answer, as does an outcome that has none and no default; of equal times
the smaller id comes first; a request that arrives late, with a time before the answer in force was given, is a hit, and one
that is later than ``late`` behind all others is dropped by the watermark; null keys are one key; requests without a time are real calls and keep nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that an answer is kept.
LIVES = {"success": 30 * 24 * 3600, "failed": 600}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """State with timers needs the RocksDB store: asked for while a stream starts, the session's own choice after that."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Answers(StatefulProcessor):
    def __init__(self, lives: Mapping[str, int], default: int) -> None:
        self.lives, self.default = dict(lives), default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["ms", "request_id"], na_position="last", kind="stable")
        held = self.end.get()
        first = end = int(held[0]) if held is not None else None
        hits = []
        for ms, status in zip(asked["ms"], asked["status"]):
            hit = end is not None and ms == ms and ms <= end
            if not hit and ms == ms:
                life = self.lives.get(status, self.default)
                end = int(ms) + life * 1000 if life > 0 else end
            hits.append(hit)
        if end != first:
            if first is not None:
                self.handle.deleteTimer(first + 1)
            self.end.update((end,))
            self.handle.registerTimer(end + 1)
        yield pd.DataFrame({"request_id": asked["request_id"].to_numpy(), "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.end.get()
        if held is not None and int(held[0]) < expiredTimerInfo.getExpiryTimeInMs():
            self.end.clear()
        yield pd.DataFrame({"request_id": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def decided(stream: DataFrame, lives: Mapping[str, int] = LIVES, default: int = 0, late: str = "10 minutes") -> DataFrame:
    """(request_id, hit) of a stream of requests: request_id (long), cache_key, created_at and status, the outcome of the call
    if it is made. Start it within ``keyed_state``."""
    rows = stream.select(F.col("request_id").cast("long").alias("request_id"), F.coalesce("cache_key", F.lit("")).alias("cache_key"), "created_at", "status", F.unix_millis("created_at").alias("ms"))
    state = rows.withWatermark("created_at", late).groupBy("cache_key")
    return state.transformWithStateInPandas(Answers(lives, default), "request_id long, hit boolean", "Append", "EventTime")
