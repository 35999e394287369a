"""MinHash near-dedup with circulant permutations.

Two permutations make a whole signature: the first, multiplication by an odd number, permutes
the 64-bit fingerprints of shingles, whose leading bits then name one of ``SLOTS`` places; the
second numbers the places, and coordinate k reads the numbering circularly shifted by k. One
shingle thus adds one contiguous slice of a table to all coordinates at once. Sets of nearly
``SLOTS`` shingles fill most places and become candidates of each other more often, which costs
comparisons, never links. ``BANDS`` bands of ``ROWS`` coordinates propose candidates; a pair
with Jaccard 0.8 shares no band with a chance below 8 in a million, and every proposed link is
confirmed on the full shingle sets.

Texts with equal sets are one node. In each bucket (texts that share a band) members are first
held against one centre, the member with most company over all its buckets, which gives each
member's exact Jaccard distance to it; connected texts need no further pairs. Buckets that still
hold more than one component are finished exactly. Their centre has met all members and drops
out; the rest of a bucket is a group, and buckets with the same rest are one. Where a bucket holds
part of a large component, its other members become that component's visitors; they are compared
with the members of it that share such a bucket, and with each other. Jaccard distance is a metric,
so members of the component whose distances to the centre differ from those of all visitors by
more than a link allows are left out. Groups of all sizes are compared in tiles, a block of texts
by a block of texts at once, a small group in one; so no group's pairs are ever emitted as rows.

Rows: a text without words has an empty set and no links. A null id is linked with nothing: its
component is null and the row is kept. Rows that share an id are one document: a link of one is
a link of all, and they stay or go together. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.components import components, fair, spread_sized
from loomspan.session import Scratch

#: Words in a shingle and percent of similarity, where nothing else is asked for.
WIDTH, PERCENT = 5, 80
BANDS, ROWS = 64, 8
SLOTS = 1 << 22
#: Texts and bytes of one side of a tile; larger components and buckets are compared in tiles.
BLOCK, BLOCK_BYTES = 128, 8_000_000
#: Shared shingles of a tile that are counted at once.
COLUMNS = 1 << 14
#: Rounding of distances.
EPSILON = 1e-9
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANKS = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_MIX = np.random.default_rng(8).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: bytes | None) -> list[bytes]:
    """Runs of anything but blanks and U+0009 to U+000D, A-Z lower-cased."""
    return [w for w in text.translate(_LOWER).translate(_BLANKS).split(b" ") if w] if text else []


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct shingles."""
    import xxhash

    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    m = min(width, len(w))
    out = np.full(len(w) - m + 1, m, np.uint64)
    for k in range(m):
        out = (out ^ h[k : len(w) - m + 1 + k]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def numbering() -> np.ndarray:
    """The second permutation, continued past its end for all shifts."""
    table = np.random.default_rng(20211013).permutation(SLOTS).astype(np.uint32)
    return np.concatenate([table, table[: BANDS * ROWS]])


def signature(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set."""
    slices = np.lib.stride_tricks.sliding_window_view(table, BANDS * ROWS)
    at = ((s * _MIX[60]) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)  # the first permutation
    out = slices[at[:128]].min(axis=0)
    for lo in range(128, len(at), 128):
        np.minimum(out, slices[at[lo : lo + 128]].min(axis=0), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys of all bands, a row per signature; the band's number is part of the key."""
    x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _MIX[61], x.shape[:2]).copy()
    for k in range(ROWS):
        out = (out ^ x[:, :, k]) * _MIX[k]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """Of (id, text as binary): (id, n, set digest, band keys); empty sets have neither."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = numbering()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                keys = iter(bands(np.stack([signature(s, table) for s in full]))) if full else iter(())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], names=["id", "n", "digest", "bands"])

    return docs.mapInArrow(run, f"id {kind}, n bigint, digest binary, bands array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (a, b) with texts (node, text): (a, b, linked, far), on the full sets; ``far`` is the
    Jaccard distance."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[bytes, np.ndarray] = OrderedDict()  # sets of the texts met last

        def of(text: bytes) -> np.ndarray:
            key = hashlib.blake2b(text, digest_size=16).digest()
            got = held.get(key)
            if got is None:
                got = held[key] = shingles(text, width)
                if len(held) > 64:
                    held.popitem(last=False)
            else:
                held.move_to_end(key)
            return got

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                linked, far = [], []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    a, b = of(x), shingles(y, width)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    either = len(a) + len(b) - both
                    linked.append(bool(both) and 100 * both >= percent * either)
                    far.append(1 - both / max(1, either))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_()), pa.array(far, pa.float64())], names=["a", "b", "linked", "far"])

    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, f"a {kind}, b {kind}, linked boolean, far double")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one, in memory that
    ``COLUMNS`` bounds beside the sets themselves."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    at = [[np.searchsorted(shared, np.intersect1d(x, shared, assume_unique=True)) for x in side] for side in (left, right)]
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, len(shared), COLUMNS):
        n = min(COLUMNS, len(shared) - lo)
        held = []
        for side in at:
            m = np.zeros((len(side), n), np.float32)
            for i, places in enumerate(side):
                a, b = np.searchsorted(places, (lo, lo + n))
                m[i, places[a:b] - lo] = 1
            held.append(m)
        out += np.rint(held[0] @ held[1].T).astype(np.int64)
    return out


def tiles(visitors: DataFrame, inside: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of a group's visitors among themselves and to the group's own members; both
    are (g, node, component), texts are (node, text). A group is cut into tiles of at most about
    ``BLOCK`` by ``BLOCK`` texts and ``BLOCK_BYTES`` a side, each compared at once; a group of one
    tile sends each text once. Of a visitor's links into one component one is enough."""
    kind = texts.schema["node"].dataType.simpleString()
    text = texts.select(F.col("node").alias("__node"), "text")
    with_text = lambda df: df.join(text, df["node"] == text["__node"]).drop("__node")
    left = scratch.table(with_text(visitors), "tile-visitors")
    own = scratch.table(with_text(inside), "tile-members")
    right = left.withColumn("visits", F.lit(True)).unionByName(own.withColumn("visits", F.lit(False)))
    cut = lambda df, name: df.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias(name))
    counts = scratch.table(cut(left, "n_left").join(cut(right, "n_right"), "g"), "tile-counts")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    l = left.join(counts, "g").select("g", place("n_left").alias("i"), every("n_right").alias("j"), one.alias("one"), F.lit(True).alias("left"), "node", "component", "text")
    r = right.join(counts, "g").where(~(one & F.col("visits"))).select("g", every("n_left").alias("i"), place("n_right").alias("j"), one.alias("one"), F.lit(False).alias("left"), "node", "component", "text")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        of = [shingles(bytes(t), width) for t in part["text"]]
        at = [np.flatnonzero(part["left"]), np.flatnonzero(part["one"] | ~part["left"])]
        sides = [part.iloc[x] for x in at]
        sets = [[of[k] for k in x] for x in at]
        found = []
        if all(map(len, sets)):
            both = common(*sets)
            a, b = (np.array([len(x) for x in s], np.int64) for s in sets)
            linked = (both > 0) & (100 * both >= percent * (a[:, None] + b[None, :] - both))
            nodes, groups = [s["node"].to_list() for s in sides], [s["component"].to_list() for s in sides]
            for i in range(len(nodes[0])):
                seen = {groups[0][i]}
                for j in np.flatnonzero(linked[i]).tolist():
                    if groups[1][j] not in seen:
                        seen.add(groups[1][j])
                        found.append((nodes[0][i], nodes[1][j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return l.unionByName(r).groupBy("g", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document row: id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.table
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    sketched = table(sketch(rows, width), "sketches")
    full = sketched.where("digest is not null and id is not null")
    nodes = table(full.groupBy("digest").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "nodes")
    mine = table(sketched.select("id", "n", "digest").join(nodes.select("digest", "node"), "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("node", "id")).alias("node")), "documents-by-set")
    # ids in more than one class of equal sets
    split = mine.where("id is not null").groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    links = mine.join(split, "id").select(F.col("lo").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()

    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = table(shared, "shared-bands")
    most = fair(shared.agg(F.sum("size")).first()[0] or 0)
    # every row of a bucket carries its size from here on
    by_key = lambda rows, other, how="inner": spread_sized(rows, other, most, "key", "size", "node", how)
    members = table(buckets.join(shared, "key"), "bucket-members")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = table(members.join(company, "node").select("key", "node", "company", "size"), "bucket-company")
    wanted = company.select("node")
    texts = rows.where("id is not null").join(wanted.withColumnRenamed("node", "id"), "id", "left_semi").select(F.col("id").alias("node"), "text")
    texts = table(texts.distinct(), "candidate-texts")

    # each bucket's member with most company against the others
    heads = members.groupBy("key").agg(F.max(F.struct("company", "node")).alias("x"), F.max("size").alias("size")).select("key", F.col("x.node").alias("a"), "size")
    heads = table(heads, "bucket-heads")
    pairs = table(by_key(members, heads).where("a <> node").select("a", F.col("node").alias("b")).distinct(), "candidate-pairs")
    tested = table(confirm(pairs, texts, width, percent), "confirmed-pairs")
    sure = tested.where("linked").select("a", "b").unionByName(links)
    state = table(components(sure, scratch), "components")

    # buckets that hold more than one component
    labelled = table(members.join(state, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), F.col("size")), "bucket-components")
    sizes = state.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("nodes"))
    sizes = table(sizes.where(F.col("nodes") > BLOCK), "large-components")
    keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo < hi").select("key", "held")
    keys = table(keys, "open-keys")
    if not keys.isEmpty():
        reach = 1 - percent / 100 + EPSILON  # a link's distance at most
        far = tested.select("a", F.col("b").alias("node"), "far")
        open_ = by_key(labelled, keys.join(heads, "key")).join(far, ["a", "node"], "left").withColumn("far", F.coalesce("far", F.lit(0.0)))
        open_ = table(open_.select("key", "a", "node", "component", "held", "far", "size"), "open-buckets")
        large = open_.join(sizes, "component").groupBy("key").agg(F.max(F.struct("nodes", "component")).alias("x"), F.max("size").alias("size")).select("key", F.col("x.component").alias("hub"), "size")
        large = table(large, "open-hubs")
        # a bucket's group: the hub it holds, or the bucket itself
        dealt = table(by_key(open_, large, "left"), "open-groups")
        own = dealt.where("hub is null and node <> a")  # the head has met them all
        small = own.where(F.col("held") <= BLOCK).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("node", "component"))).alias("rest"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        small = small.where("lo < hi").groupBy("rest").agg(F.min("key").alias("key")).select("key", F.explode("rest").alias("x")).select("key", "x.node", "x.component")
        # of a bucket's hub and its visitors, those that the distances to the head let meet
        visits = F.col("component") != F.col("hub")
        bounds = dealt.where("hub is not null").groupBy("key").agg(F.max("size").alias("size"), *[f(F.when(who, F.col("far"))).alias(name) for name, f, who in (("lo_visit", F.min, visits), ("hi_visit", F.max, visits), ("lo_hub", F.min, ~visits), ("hi_hub", F.max, ~visits))])
        meeting = by_key(dealt.where("hub is not null"), bounds)
        hub_near = ~visits & F.col("far").between(F.col("lo_visit") - reach, F.col("hi_visit") + reach)
        group = F.concat(F.lit("c"), F.col("hub").cast("string")).alias("g")
        inside = meeting.where(hub_near).select(group, "node", "component").distinct()
        # visitors meet each other too: all that share the bucket stay
        by_hub = meeting.where(visits).select(group, "node", "component").distinct()
        by_bucket = own.where(F.col("held") > BLOCK).select("key", "node", "component").distinct().unionByName(small).select(F.concat(F.lit("k"), F.col("key").cast("string")).alias("g"), "node", "component")
        visitors = table(by_hub.unionByName(by_bucket), "visitors")
        met = table(tiles(visitors, inside, texts, width, percent, scratch), "tile-links")
        state = table(components(sure.unionByName(met), scratch), "components")
    scratch.release(mine, state)
    label = F.coalesce("component", "node")
    return mine.join(state, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), label.alias("component_id"), F.col("id").eqNullSafe(label).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that a smaller id of their group stands for."""
    gone = classes(docs, id_col, text_col, width, percent).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def oracle(width: int = 2, percent: int = PERCENT) -> str:
    """DuckDB SQL for the rows of the registered query."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, {shingle} AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 1))) AS i FROM d)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {width - 1}
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)
), link AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT x AS doc_id, y AS other FROM link
  UNION SELECT r.doc_id, link.y FROM r JOIN link ON link.x = r.other
), c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
