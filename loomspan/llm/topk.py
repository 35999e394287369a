"""Exact top-k search by a three-phase uniform threshold.

A vector's components are dealt into ``LISTS`` lists, and a score is the sum of one partial
score from each. Phase 1: every task reads, for each query, the list in which the query is
strongest, resolves the full scores of its best entries and reports the k best; the k-th best of
all reports is a cutoff that the true k-th score cannot be under. Phase 2: with the cutoff c
broadcast, an entry can reach it only if one of its partial scores reaches c / LISTS. A task
keeps each list sorted by the length of the entries' parts, which bounds their partial scores,
and reads it only down to where that bound falls below the threshold; it collects the entries
whose partial score reaches it. Phase 3 resolves the full scores of the collected entries alone,
exactly, in integers, and ranks them.

Queries are cut into blocks of at most ``BLOCK`` vectors and about ``BLOCK_BYTES``; a block and
its cutoffs are all that is broadcast, and each block passes all candidates. Its entries are
written, so the plan of the result does not grow with the number of blocks. A task reports at
most k entries a query, so copies of one vector, however many, stay in bounds.

Rows: vectors that are null or hold a null, NaN or infinity take no part, nor do empty ones.
Only vectors of the query's length are compared. Rows with the query's own id are no
candidates; other repeated ids count row by row. Of repeated query ids the least vector asks.
Rows with a null id take no part. Scores must fit a 64-bit integer, as the column is one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import Scratch, materialize

K, SCALE, LISTS = 10, 1024, 4
#: Queries in one block and about their bytes; candidates that share sorted lists; queries
#: that are held against them at once.
BLOCK, BLOCK_BYTES, CHUNK, STRIP = 16384, 1 << 24, 2048, 256
#: Groups in which reports meet before they meet by query.
SALTS = 64
EXACT = 2.0**53
#: The cutoff of a query with fewer than k entries: everything reaches it.
NONE = -(2**63)


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows of one length); null vectors and null components are gone by now."""
    ends = np.asarray(vectors.offsets)
    flat, own = np.asarray(vectors.flatten(), np.int64), np.asarray(ids, np.int64)
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    for n in np.unique(sizes).tolist():
        if n:
            at = np.flatnonzero(sizes == n)
            yield own[at], flat[starts[at][:, None] + np.arange(n)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles where no sum passes 2 ** 53, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < EXACT else a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score, then id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def spans(size: int, lists: int) -> list[slice]:
    """The components of each list that has any."""
    cut = [round(i * size / lists) for i in range(lists + 1)]
    return [slice(x, y) for x, y in zip(cut, cut[1:], strict=False) if x < y]


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def resolve(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Full scores of pairs of places."""
    if 8 * len(q) > len(queries) * len(rows):
        return products(queries, rows)[q, r]
    step = max(1, (1 << 20) // max(1, rows.shape[1]))
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", queries[q[lo : lo + step]], rows[r[lo : lo + step]]) for lo in range(0, len(q), step)]])


class Search:
    """What one task keeps of the entries for each query of a block."""

    def __init__(self, block: list[tuple], k: int, lists: int):
        self.k, self.lists = k, lists
        self.read = self.resolved = 0  # entries of lists, and scores
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {len(q[1]) for q in block}:
            own = [q for q in block if len(q[1]) == n]
            cutoffs = np.array([NONE if q[2] is None else q[2] for q in own], np.int64)
            self.groups[n] = np.array([q[0] for q in own], np.int64), np.array([q[1] for q in own], np.int64), cutoffs
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.held:
            ids, scores = np.concatenate([self.held[query][0], ids]), np.concatenate([self.held[query][1], scores])
        at = best(scores, ids, self.k)
        self.held[query] = ids[at], scores[at]

    def _resolved(self, asks: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray, least: np.ndarray | None = None) -> None:
        """Take the entries ``r`` for the queries ``q``, sorted by query."""
        other = ids[r] != asks[q]
        q, r = q[other], r[other]
        total = resolve(queries, rows, q, r)
        self.resolved += len(q)
        if least is not None:
            enough = total >= least[q]
            q, r, total = q[enough], r[enough], total[enough]
        cut = np.flatnonzero(np.diff(q)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(q)], strict=True):
            if lo < hi:
                self._add(int(asks[q[lo]]), ids[r[lo:hi]], total[lo:hi])

    def report(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Phase 1: the head of each query's strongest list, resolved."""
        if rows.shape[1] not in self.groups:
            return
        asks, queries, _ = self.groups[rows.shape[1]]
        lists = spans(rows.shape[1], self.lists)
        strongest = np.argmax([lengths(queries[:, s]) for s in lists], axis=0)
        top = min(2 * self.k + 1, len(ids))
        for j, s in enumerate(lists):
            own = np.flatnonzero(strongest == j)
            for lo in range(0, len(own), STRIP):
                some = own[lo : lo + STRIP]
                partial = products(queries[some, s], rows[:, s])
                self.read += partial.size
                heads = np.argpartition(-partial, top - 1, axis=1)[:, :top]
                self._resolved(asks[some], queries[some], ids, rows, np.repeat(np.arange(len(some)), top), heads.ravel())

    def collect(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Phases 2 and 3: entries with a partial score at the uniform threshold, resolved."""
        if rows.shape[1] not in self.groups:
            return
        asks, queries, least = self.groups[rows.shape[1]]
        lists = spans(rows.shape[1], self.lists)
        # least is at most the sum of the parts, so one part is at least its share, rounded down
        share = least // len(lists)
        sorted_lists = []
        for s in lists:
            size = lengths(rows[:, s])
            order = np.argsort(-size, kind="stable")
            sorted_lists.append((s, order, -size[order], lengths(queries[:, s])))
        for lo in range(0, len(asks), STRIP):
            some = slice(lo, lo + STRIP)
            enough = np.zeros((len(asks[some]), len(ids)), bool)
            for s, order, falling, strength in sorted_lists:
                # |q| |x| bounds a partial score; a little more than that, for rounding
                least_size = np.where(share[some] > 0, (share[some] - 1.0) / np.maximum(strength[some], 1e-300) * (1 - 1e-9), 0.0)
                depths = np.searchsorted(falling, -least_size, side="right")
                grade = np.frexp(depths)[1]  # queries that read about as far go together
                for g in np.unique(grade).tolist():
                    at = np.flatnonzero(grade == g)
                    near = order[: int(depths[at].max())]
                    if len(near):
                        partial = products(queries[some][at, s], rows[near, s])
                        self.read += partial.size
                        enough[np.ix_(at, near)] |= partial >= share[some][at, None]
            q, r = np.nonzero(enough)
            self._resolved(asks[some], queries[some], ids, rows, q, r, least[some])


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, in doubles; null if the vector takes no part."""
    wide = vector.cast("array<double>")
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(wide) > 0)
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(wide, lambda x: F.floor(x * float(scale)).cast("bigint")))


def search(rows: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """For the rows for which ``asks`` holds: (query_id, rank, vec_id, score)."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    held = rows.select(rows[id_col].cast("bigint").alias("id"), integers(rows[vector_col], scale).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    queries = scratch.table(held.where("asks").groupBy("id").agg(F.min("v").alias("v")), "queries")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("components")).first()
    n = max(1, math.ceil(size.n / block), math.ceil(8 * size.components / BLOCK_BYTES))
    n = 2 * n if n > 1 else 1  # about half full: never over the bound by much
    order = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    candidates = held.select("id", "v")

    def passed(block: list[tuple], phase: str) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = Search(sent.value, k, lists)
            step = getattr(task, phase)
            for batch in batches:
                for lo in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(lo, CHUNK)
                    for ids, vectors in matrices(part.column(0), part.column(1)):
                        step(ids, vectors)
            if task.held:
                kept = [*task.held.items()]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in kept], pa.int64()), pa.array([x[0] for _, x in kept], pa.list_(pa.int64())), pa.array([x[1] for _, x in kept], pa.list_(pa.int64()))], names=["query_id", "ids", "scores"])

        return candidates.mapInArrow(run, "query_id bigint, ids array<bigint>, scores array<bigint>")

    highest = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k).alias("scores")
    kth = F.when(F.size("scores") >= k, F.element_at("scores", k)).alias("cutoff")
    schema, paths = "query_id bigint, ids array<bigint>, scores array<bigint>", []
    for b in range(n):
        own = [(r.id, r.v) for r in order.where(F.col("block") == b).collect()]  # bounded by ``block``
        if not own:
            continue
        reports = passed([(q, v, None) for q, v in own], "report").select("query_id", "scores", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
        reports = reports.groupBy("query_id", "salt").agg(highest).groupBy("query_id").agg(highest)
        cutoffs = {r.query_id: r.cutoff for r in reports.select("query_id", kth).collect()}
        paths.append(materialize(passed([(q, v, cutoffs.get(q)) for q, v in own], "collect"), "entries")[1])
    scratch.release()
    if not paths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    entries = spark.read.schema(schema).parquet(*paths)
    entries = entries.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("query_id", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the rows of the registered query.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
