"""How good rankings, labels and sources are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(results: DataFrame, matches: Column, within: int = 5) -> DataFrame:
    """Of (query_id, place from 1): the first place within ``within`` that matches; 0 is a miss."""
    return results.groupBy("query_id").agg(F.coalesce(F.min(F.when(matches & (F.col("place") <= within), F.col("place"))), F.lit(0)).alias("first"))


def metrics(first: DataFrame) -> DataFrame:
    """P@1, P@3 and the mean reciprocal rank of (query_id, first)."""
    hit = F.col("first")
    return first.agg(
        F.count(F.lit(1)).alias("n"), F.avg((hit == 1).cast("double")).alias("p_at_1"), F.avg(hit.between(1, 3).cast("double")).alias("p_at_3"),
        F.avg(F.when(hit > 0, 1.0 / hit).otherwise(0.0)).alias("mrr"),
    )


def names_match(name: Column, expected: Column) -> Column:
    """Whether a file name holds the expected part, in any case."""
    return F.contains(F.lower(name), F.lower(expected))


def majority(neighbours: DataFrame, label: str = "label") -> DataFrame:
    """Of (query_id, label): the label most neighbours have, ties to the smaller one."""
    votes = neighbours.groupBy("query_id", label).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("query_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(label).alias("l")))["l"].alias("predicted"))


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Share of right labels by class."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def shares(rows: DataFrame, group: str) -> DataFrame:
    """Items and their share of all by group; the total is one row, sent to all tasks."""
    total = rows.agg(F.count(F.lit(1)).alias("__all"))
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(total)).select(group, "n", (F.col("n") / F.col("__all")).alias("share"))


def precision(rows: DataFrame, source: str, published: Column, least: int = 1) -> DataFrame:
    """Published of collected by source, for sources of at least ``least`` items."""
    out = rows.groupBy(source).agg(F.count(F.lit(1)).alias("collected"), F.sum(published.cast("bigint")).alias("published"))
    return out.where(F.col("collected") >= least).withColumn("precision", F.col("published") / F.col("collected"))


def folds(key: Column, n: int = 5, run: int = 50) -> Column:
    """The fold of a key: runs of neighbouring keys stay together. One function for both sides."""
    return F.pmod(F.floor(key / run), F.lit(n)).cast("int")


def concentration(rows: DataFrame, group: str, member: str) -> DataFrame:
    """How much of a group comes from few members: items, members, the largest one's share and the
    sum of squared shares (1 for a single member)."""
    counted = rows.groupBy(group, member).agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy(group).agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("members"), F.max("n").alias("most"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return out.select(group, "items", "members", (F.col("most") / F.col("items")).alias("largest"), (F.col("squares") / (F.col("items") * F.col("items"))).alias("concentration"))


def agreement(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Of two labels of the same items: share of equal ones, what chance would give, and kappa.
    Nulls take no part."""
    both = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    cells = both.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    ours, theirs = (cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}")) for c in ("a", "b"))
    chance = ours.join(theirs, "label").agg(F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0)).alias("products"))
    out = total.crossJoin(chance).select(F.col("all").alias("n"), (F.col("same") / F.col("all")).alias("observed"), (F.col("products") / F.col("all") / F.col("all")).alias("chance"))
    return out.withColumn("kappa", F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))))


def rollup(rows: DataFrame, *groups: str) -> DataFrame:
    """Items by all leading parts of the groups; ``level`` counts the groups that a row leaves out."""
    return rows.rollup(*groups).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__id")).withColumn("level", F.bit_count("__id").cast("int")).drop("__id")
