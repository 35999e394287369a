"""Tables kept up to date without MERGE: upsert, replacement, pruning and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surrogate(path: Column) -> Column:
    return F.xxhash64(path)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: the one of the highest version, new before old at equal versions. A
    partial maximum per task comes before the shuffle."""
    names = old.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*names).withColumn("__new", F.lit(1)))
    best = F.max_by(F.struct(*names), F.struct(F.col(version), F.col("__new")))
    return both.groupBy(F.col(key).alias("__key")).agg(best.alias("r")).select("r.*")


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """``children`` without those of parents in ``fresh``, and the fresh ones."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh.select(*children.columns))


def prune(docs: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Documents whose file is still there."""
    return docs.join(present.select(key).distinct(), key, "left_semi")


def compare(local: DataFrame, live: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, removed, changed or same."""
    a, b = local.select(key, F.col(digest).alias("__a")), live.select(key, F.col(digest).alias("__b"))
    status = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def edits(drafts: DataFrame, finals: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of draft and final text that differ, to learn from."""
    a, b = drafts.select(key, F.col(text).alias("draft")), finals.select(key, F.col(text).alias("final"))
    return a.join(b, key).where(~F.col("draft").eqNullSafe(F.col("final")))
