"""Where a stream's results go. Each function makes a taker (frame, batch number) for
``foreachBatch``; batches may come twice after a failure, so a taker replaces what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import transcript
from loomspan.sources import frames
from loomspan.streaming import captions

Taker = Callable[[DataFrame, int], None]


def scroll(say: Callable[[str], None] = print) -> Taker:
    """Finals of (at, lang, said, final) as lines, in order; drafts never scroll."""

    def take(df: DataFrame, k: int) -> None:
        lines = captions.finals(df).select("at", transcript.entry(F.col("at"), F.col("lang"), F.col("said")).alias("line"))
        for r in lines.orderBy("at", "line").toLocalIterator():
            say(r.line)

    return take


def _replace(df: DataFrame, path: str, stream: str) -> None:
    """One text file a stream; streams that the batch does not name keep theirs."""
    df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(stream).text(path)


def current(path: str, said: Column, translation: Column, style: str = "both") -> Taker:
    """What a titler shows now: the newest row of each stream's screen (stream, place, ...), over
    what stood there before."""

    def take(df: DataFrame, k: int) -> None:
        shown = df.select("stream", "place", transcript.caption_line(said, translation, style).alias("value"))
        _replace(shown.groupBy("stream").agg(F.max_by("value", "place").alias("value")), path, "stream")

    return take


def broadcast(path: str) -> Taker:
    """The whole window of each stream as one JSON array, sent anew with every batch and tick, so
    that who comes late gets it too."""

    def take(df: DataFrame, k: int) -> None:
        row = F.struct("place", *[c for c in df.columns if c not in ("stream", "place")])
        _replace(df.groupBy("stream").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value")), path, "stream")

    return take


def tee(path: str, then: Taker, samples: str = "samples") -> Taker:
    """Frames kept as 16-bit samples and passed on unchanged, computed once: what goes on is read
    back from what was kept beside them."""

    def take(df: DataFrame, k: int) -> None:
        at = f"{path}/batch={k}"
        df.withColumn("pcm", frames.pcm16(F.col(samples))).write.mode("overwrite").parquet(at)
        then(df.sparkSession.read.parquet(at).drop("pcm"), k)

    return take


def append(path: str) -> Taker:
    """A log of rows as JSON lines, a folder a batch: edits to learn from, or finals."""

    def take(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").json(f"{path}/batch={k}")

    return take


def notes(rows: DataFrame, path: str, session: str = "session") -> None:
    """(session, notes) as one text file a session."""
    _replace(rows.select(session, F.col("notes").alias("value")), path, session)
