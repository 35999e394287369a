"""Audio as rows: frames of a fixed size, levels, and a tee that keeps what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME, RATE = 512, 16_000
SILENCE, AUDIBLE = 0.001, 0.0005
#: Frames of one second, for the level shown.
RECENT = 31


def frames(samples: Column, size: int = FRAME) -> Column:
    """Whole frames of a sample array; a rest that fills none is dropped."""
    n = F.floor(F.size(samples) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(samples, i * size + 1, F.lit(size)))


def mono(channels: Column) -> Column:
    """The mean of several channels of equal length."""
    first = F.element_at(channels, 1)
    return F.transform(first, lambda x, i: F.aggregate(channels, F.lit(0.0), lambda acc, c: acc + F.element_at(c, i + 1)) / F.size(channels))


def rms(samples: Column) -> Column:
    square = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(F.when(F.size(samples) > 0, square / F.size(samples)).otherwise(0.0))


def is_silent(samples: Column) -> Column:
    return rms(samples) < SILENCE


def levels(rows: DataFrame, stream: str, order: str, level: str) -> DataFrame:
    """With ``peak``, the highest level of the last second's frames."""
    recent = Window.partitionBy(stream).orderBy(order).rowsBetween(-(RECENT - 1), 0)
    return rows.withColumn("peak", F.max(level).over(recent))


def probe(rows: DataFrame, stream: str, level: str, least: float = AUDIBLE) -> DataFrame:
    """(stream, loudest, audible): whether anything at all is heard on a source."""
    return rows.groupBy(stream).agg(F.max(level).alias("loudest")).withColumn("audible", F.coalesce(F.col("loudest") >= least, F.lit(False)))


def pcm16(samples: Column) -> Column:
    """Samples as 16-bit integers, clipped to -1 and 1."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))
