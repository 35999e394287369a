"""Captions on screen: rows replaced by key, held for a reader's sake, bounded in number and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.streaming.segments import seconds_of

LINES, DWELL, RETAIN = 2, 1.5, 30.0


class Screen:
    """The rows on screen, in plain values that a state store can keep.

    A new key adds a row and the oldest goes where there are too many. A known key replaces its
    row, but not within ``dwell`` seconds of the row's first showing: then text and source wait
    and are applied by a later call. A rewrite that changes nothing, or comes late enough, drops
    what waits. Rows older than ``retain`` seconds go from the oldest on."""

    def __init__(self, rows: list | None = None, lines: int = LINES, dwell: float = DWELL, retain: float | None = None):
        self.rows = rows or []  # [key, text, source, first shown, waiting (text, source) or None]
        self.lines, self.dwell, self.retain = lines, dwell, retain

    def settle(self, now: float) -> None:
        for row in self.rows:
            if row[4] and now - row[3] >= self.dwell:
                row[1], row[2] = row[4]
                row[4] = None
        while self.retain and self.rows and now - self.rows[0][3] > self.retain:
            del self.rows[0]

    def show(self, key, text: str, now: float, source: str | None = None) -> None:
        self.settle(now)
        row = next((r for r in self.rows if r[0] == key), None)
        if row is None:
            self.rows = [*self.rows, [key, text, source, now, None]][-self.lines :]
        elif text != row[1] and now - row[3] < self.dwell:
            row[4] = [text, source or row[2]]
        else:
            row[1], row[2], row[4] = text, source or row[2], None

    def visible(self, now: float) -> list[tuple]:
        """(key, text, source), the oldest first."""
        self.settle(now)
        return [tuple(r[:3]) for r in self.rows]


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key, with the time of its first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"), F.min(version).alias("first_shown")).select(*keys, "r.*", "first_shown")


def window(rows: DataFrame, stream: str, shown: str, tie: str, lines: int = LINES, retain: float | None = None) -> DataFrame:
    """The last ``lines`` rows of each stream, none older than ``retain`` seconds before the newest."""
    place = F.row_number().over(Window.partitionBy(stream).orderBy(F.desc(shown), F.desc(tie)))
    out = rows.withColumn("place", place).where(F.col("place") <= lines)
    if retain is not None:
        newest = F.max(seconds_of(F.col(shown))).over(Window.partitionBy(stream))
        out = out.withColumn("__newest", newest).where(F.col("__newest") - seconds_of(F.col(shown)) <= retain).drop("__newest")
    return out


def described(rows: DataFrame, metadata: DataFrame, key: str, **defaults) -> DataFrame:
    """Rows with what is known of their keys; a key without metadata, or an empty field, has the
    default."""
    out = rows.join(metadata.select(key, *defaults), key, "left")
    return out.select(*rows.columns, *[F.coalesce(name, F.lit(value)).alias(name) for name, value in defaults.items()])


def finals(rows: DataFrame) -> DataFrame:
    """What a transcript or any lasting record may take."""
    return rows.where("final")


def enrich(rows: DataFrame, rough: Column, careful: Column) -> DataFrame:
    """With ``translation``: a quick one for drafts, a checked one for finals."""
    return rows.withColumn("translation", F.when(F.col("final"), careful).otherwise(rough))
