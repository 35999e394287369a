"""Similarity join of all items with all: links counted, classes of items that links connect.

Equal vectors are one node. Nodes are packed in blocks, one row a block. Each block is compared
with itself first, and its nodes get the class they have within it; then each pair of blocks is
compared once, as one matrix product. No pair of items becomes a row: a task gives back the
links of each node and a spanning forest over the classes of its blocks, so what is linked
within a block adds no edge to any task that meets the block again.

Rows: a vector that is null, has no length or holds null, NaN or infinity is linked with
nothing, and so are vectors of different sizes. A null id has no links and no class; its row is
kept. Ids are the key of the items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.components import components
from loomspan.session import materialize

#: Most nodes and about most bytes of a block; blocks that are broadcast together; rows of a
#: block compared at once; nodes that a task remembers.
BLOCK, BLOCK_BYTES, TOGETHER, STRIP, KNOWN = 4096, 1 << 21, 16, 256, 1_000_000


def _unpack(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of one block: nodes, copies and, by size of vector, places and vectors of length 1."""
    items = blocks.flatten()
    vectors = items.field("vector")
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    parts = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        v = values[starts[at][:, None] + np.arange(size)]
        parts.append((at, v / np.sqrt((v * v).sum(1))[:, None]))
    return items.field("node").to_numpy(), items.field("copies").to_numpy(), parts


def _forest(hits: Iterator[tuple[int, np.ndarray]], label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over classes of places, of (place, places linked with it);
    ``label`` holds the class of each place and is brought up to date."""
    for i, linked in hits:
        seen = np.unique(label[linked])
        other = seen[seen != label[i]]
        if len(other):
            first = {int(label[j]): int(j) for j in linked[np.isin(label[linked], other)]}
            yield from ((i, j) for j in first.values())
            label[np.isin(label, other)] = label[i]


def _hits(parts, rivals, copies, their, mine, theirs, least: float, same: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places of the other block linked with it); links are added to ``mine`` and, unless
    both blocks are the same, to ``theirs``."""
    for at, v in parts:
        for where, w in rivals:
            if v.shape[1] != w.shape[1]:
                continue
            for lo in range(0, len(at), STRIP):
                rows = at[lo : lo + STRIP]
                sim = v[lo : lo + STRIP] @ w.T
                close = sim >= least - 1e-6
                edge = close & (sim < least + 1e-6)
                close[edge] = np.round(sim[edge], 6) >= least
                if same:
                    close[np.arange(len(rows)), lo + np.arange(len(rows))] = False
                mine[rows] += close @ their[where]
                if not same:
                    theirs[where] += copies[rows] @ close
                for k in np.flatnonzero(close.any(1)):
                    yield int(rows[k]), where[close[k]]


class _Task:
    """Links of nodes and a forest over the classes of all tiles since the last ``drain``."""

    def __init__(self, least: float):
        self.least, self.links, self.parent, self.edges = least, {}, {}, []

    def top(self, a: int) -> int:
        while (up := self.parent.setdefault(a, a)) != a:
            self.parent[a] = a = self.parent[up]
        return a

    def tile(self, left, right, label: np.ndarray, rivals_label: np.ndarray) -> None:
        """Two blocks, with the class that each node has within its block."""
        (nodes, copies, parts), (others, their, rivals) = left, right
        mine, theirs = np.zeros(len(nodes), np.int64), np.zeros(len(others), np.int64)
        classes = np.concatenate([label, rivals_label])
        met = _hits(parts, rivals, copies, their, mine, theirs, self.least)
        for i, j in _forest(((i, linked + len(nodes)) for i, linked in met), classes.copy()):
            a, b = int(classes[i]), int(classes[j])
            x, y = self.top(a), self.top(b)
            if x != y:
                self.parent[y] = x
                self.edges.append((a, b))
        for who, more in ((nodes, mine), (others, theirs)):
            for k in np.flatnonzero(more):
                self.links[int(who[k])] = self.links.get(int(who[k]), 0) + int(more[k])

    def drain(self) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, links): an edge where b is given, else the links of a."""
        rows = [(a, b, None) for a, b in self.edges] + [(a, None, n) for a, n in self.links.items()]
        self.links, self.parent, self.edges = {}, {}, []
        for lo in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 10_000], strict=True)], names=["a", "b", "links"])


def _compared(nodes: DataFrame, least: float) -> DataFrame | None:
    """Of (node, copies, vector): edges and links as rows (a, b, links); None without nodes."""
    held = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    if not held.n:
        return None
    most = max(STRIP, min(BLOCK, BLOCK_BYTES // (8 * held.size)))
    m = math.ceil(held.n / most)
    block = F.pmod(F.xxhash64("node"), F.lit(m)).cast("int").alias("block")
    packed, _ = materialize(nodes.groupBy(block).agg(F.collect_list(F.struct("node", "copies", "vector")).alias("items")), "blocks")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, items = (c.slice(k, 1) for c in batch.columns)
                nodes, copies, parts = _unpack(items)
                mine, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                for _ in _forest(_hits(parts, parts, copies, copies, mine, mine, least, same=True), label):
                    pass
                yield pa.RecordBatch.from_arrays([block, items, pa.array([nodes[label]], pa.list_(pa.int64())), pa.array([mine], pa.list_(pa.int64()))], names=["block", "items", "label", "links"])

    kind = packed.schema["items"].dataType.simpleString()
    packed, _ = materialize(packed.repartition(m).mapInArrow(within, f"block int, items {kind}, label array<bigint>, links array<bigint>"), "block-classes")
    inner = packed.select(F.col("items.node").alias("a"), F.col("label").alias("b"), "links").select(F.inline(F.arrays_zip("a", "b", "links")))
    none = F.lit(None).cast("bigint")
    out = inner.where("a <> b").withColumn("links", none).unionByName(inner.where("links > 0").withColumn("b", none))
    left = packed.select("block", "items", "label").repartition(m)
    right = packed.select(F.col("block").alias("other"), F.col("items").alias("rivals"), F.col("label").alias("rivals_label"))
    # blocks in a circle: each meets those of the half that follows it, so all have as much to do
    ahead = F.pmod(F.col("other") - F.col("block"), F.lit(m))
    once = (ahead > 0) & ((ahead * 2 < m) | ((ahead * 2 == m) & (F.col("block") < F.col("other"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(least)
        for batch in batches:
            _, items, label, _, rivals, rivals_label = batch.columns
            for k in range(batch.num_rows):
                labels = (c.slice(k, 1).flatten().to_numpy() for c in (label, rivals_label))
                task.tile(_unpack(items.slice(k, 1)), _unpack(rivals.slice(k, 1)), *labels)
                if len(task.links) > KNOWN:
                    yield from task.drain()
        yield from task.drain()

    for lo in range(0, m if m > 1 else 0, TOGETHER):
        some = right.where((F.col("other") >= lo) & (F.col("other") < lo + TOGETHER))
        found = left.crossJoin(F.broadcast(some)).where(once).mapInArrow(run, "a bigint, b bigint, links bigint")
        out = out.unionByName(found)
    return out


def near_classes(items: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """Per item: key, ``class_id`` (the least key that links connect it with, or its own) and
    ``links``, the number of other items whose cosine, rounded to 6 places, is at least ``least``."""
    if least <= 0:
        raise ValueError("cosines of 0 stand for vectors without length, so least must be above 0")
    rows = items.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    length = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v)
    sound = F.col("id").isNotNull() & (length > 0) & (length < float("inf"))
    nodes, _ = materialize(rows.where(sound).groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors")
    met = _compared(nodes, least)
    if met is None:
        return rows.select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    met, _ = materialize(met, "links")
    links = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("more"))
    known = nodes.join(links, "node", "left").join(components(met.where("b is not null").select("a", "b")), "node", "left")
    known, _ = materialize(known.select("vector", F.coalesce("component", "node").alias("class"), (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")
    has = F.col("id").isNotNull()
    return rows.join(known, "vector", "left").select(F.col("id").alias(key), F.when(has, F.coalesce("class", "id")).alias("class_id"), F.when(has, F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("links"))
