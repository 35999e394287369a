"""Connected components by large and small stars, and joins that spread hot keys.

A join on a key sends all rows of the key to one task. Where a few keys hold a good part of the
rows, :func:`spread` deals theirs over several tasks; which keys that are follows from their
counts, and their number has a bound, so that they can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import Scratch

#: Rows of one key that a join takes in one piece, and keys at most that have more.
HOT_ROWS, HOT_KEYS = 200, 20_000


def fair(total: int) -> int:
    """Rows of a key that are no more than a fair share of ``total``."""
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def hot(counted: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """Of (key, n), ``total`` rows in all: (key, parts) of keys with more than a fair share, at
    most ``HOT_KEYS``; None for no such key."""
    most = fair(total)
    out = counted.where(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias("parts"))
    return None if out.isEmpty() else out


def spread(rows: DataFrame, other: DataFrame, keys: DataFrame | None, key: str, deal: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other``, a row per key, on the key. A key of ``keys`` (key, parts),
    from :func:`hot`, is dealt over that many parts by the column ``deal``."""
    if keys is None:
        return rows.join(other, key, how)
    parted = lambda df: df.join(F.broadcast(keys), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    l = parted(rows).withColumn("part", F.pmod(F.xxhash64(deal), F.col("parts")).cast("int")).drop("parts")
    r = parted(other).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return l.join(r, [key, "part"], how).drop("part")


def spread_sized(rows: DataFrame, other: DataFrame, most: int, key: str, size: str, deal: str, how: str = "inner") -> DataFrame:
    """As :func:`spread`, where both sides carry the size of the row's key: a key of more than
    ``most`` rows is dealt without any look-up. The size stays that of ``rows``."""
    parts = F.greatest(F.ceil(F.col(size) / most), F.lit(1)).cast("int")
    l = rows.withColumn("part", F.pmod(F.xxhash64(deal), parts).cast("int"))
    r = other.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(size)
    return l.join(r, [key, "part"], how).drop("part")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Of (a, b): (node, component), the least node that a node reaches; the least has no row.

    Every node is hung to the least node it sees, its greater neighbours first, then its smaller
    ones, until all trees are stars. The centre of a star has as many edges as the star has nodes,
    so its edges are spread."""
    scratch = scratch or Scratch(edges.sparkSession)
    state = None
    e = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    total = e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = scratch.table(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "degrees")
        centres = hot(seen, "u", "n", 2 * total)
        least = seen.select("u", F.least("u", "m").alias("m"))
        large = spread(both, least, centres, "u", "v").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large, down, centres, "u", "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = scratch.table(small, "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state, total = tuple(now), now[0]
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
