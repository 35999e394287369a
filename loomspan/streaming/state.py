"""Folds with state per stream, on Structured Streaming's state store.

A fold is a plain class: made from its saved value, fed the rows of one batch in order, and
saved again. Batches and streams run the same class, so both can be compared.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from loomspan.streaming import captions, segments

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UTTERANCE = "stream string, index bigint, version bigint, final boolean, at double, first bigint, last bigint"
CAPTION = "stream string, place int, key string, text string, source string"


class Utterances(segments.Open):
    """Frames (seq, speech, power) in, showings out. A row without seq ends the stream."""

    def feed(self, rows: pd.DataFrame) -> list[dict]:
        out: list[dict] = []
        for r in rows.sort_values("seq", na_position="last").itertuples():
            out += self.end() if pd.isna(r.seq) else self.take(bool(r.speech), float(r.power))
        return out

    def ended(self) -> list[dict]:
        return self.end()


class Captions:
    """Rows (now, key, text, source) in; the screen after each batch out, oldest row first."""

    def __init__(self, saved: list | None, **how):
        self.screen = captions.Screen(saved, **how)

    @property
    def state(self) -> list:
        return self.screen.rows

    def ended(self) -> list[dict]:
        return []

    def feed(self, rows: pd.DataFrame) -> list[dict]:
        now = 0.0
        for r in rows.sort_values(["now", "key"]).itertuples():
            now = float(r.now)
            self.screen.show(r.key, r.text, now, r.source)
        return [{"place": i, "key": k, "text": t, "source": s} for i, (k, t, s) in enumerate(self.screen.visible(now), 1)]


class Fold(StatefulProcessor):
    """Runs a fold per stream; its value is kept as JSON. A stream that is silent for ``idle``
    milliseconds is ended: the fold closes what is open and its state goes."""

    def __init__(self, make: Callable, columns: list[str], idle: int | None = None):
        self.make, self.columns, self.idle = make, columns, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", StructType([StructField("json", StringType())]))

    def _fold(self):
        return self.make(json.loads(self.saved.get()[0]) if self.saved.exists() else None)

    def _shown(self, key, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{"stream": key[0], **o} for o in out], columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        fold, out = self._fold(), []
        for part in _in_order(rows):
            out += fold.feed(part)
        self.saved.update((json.dumps(fold.state),))
        if self.idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._shown(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        fold = self._fold()
        out = fold.ended()
        self.saved.clear()
        yield self._shown(key, out)

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key's rows of one batch, which must be folded in order, so they are taken together; a
    batch is bounded by the source's limits (``maxFilesPerTrigger`` and the like)."""
    held = [*rows]
    yield pd.concat(held) if len(held) > 1 else held[0]


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def run(rows: DataFrame, make: Callable, schema: str, idle: int | None = None) -> DataFrame:
    """A streaming frame through a fold per ``stream``; versions are updates of their keys. With
    ``idle``, streams without rows for so many milliseconds are ended and forgotten."""
    mode = "None" if idle is None else "ProcessingTime"
    return rows.groupBy("stream").transformWithStateInPandas(statefulProcessor=Fold(make, names(schema), idle), outputStructType=schema, outputMode="Update", timeMode=mode)


def start(spark: SparkSession, out: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], tick: str | None = None):
    """The running query: each batch goes to ``take``, every ``tick`` (such as "500 milliseconds"),
    or over what there is now."""
    # over what there is now, batches without rows must not follow each other for timers' sake
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB} | ({} if tick else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        how = {"processingTime": tick} if tick else {"availableNow": True}
        return out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**how).foreachBatch(take).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def drain(spark: SparkSession, out: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what there is now, batch by batch into ``take``."""
    start(spark, out, checkpoint, take).awaitTermination()
