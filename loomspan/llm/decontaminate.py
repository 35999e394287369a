"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of ``width`` words of every benchmark item (an item of fewer
words is one window). Windows of one length share a searcher: a shift table over blocks of
two words says how far the search may jump, a bucket of the block at a window's end selects
the test strings, and a direct comparison confirms an occurrence.

The benchmark is a query set: its items are cut into pieces of at most ``PIECE`` windows, and
the pieces into blocks of a bounded number of bytes, which are written once. Each block is sent
to the tasks and all documents pass all blocks. One block, the usual case, needs no shuffle. With
more, each pass gives back only digests of the texts that hold windows, and what it found; these
meet by digest and join the documents, so texts are never written or shuffled.

Rows: null texts have no words; items with a null id are left out; ids may repeat (a document row
is judged alone; the windows of repeated item ids count for one item). Only named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import Scratch

WIDTH = 8
#: An item that occurs in a document is one of at least so many that make it contaminated.
LEAST_ITEMS = 2
#: One item alone contaminates a document if so large a share of its windows occurs, or so many
#: consecutive words of the document are hit.
LEAST_SHARE, LEAST_RUN = 0.5, 24
#: Bytes of benchmark text in one block, and windows in one piece of an item.
BLOCK_BYTES, PIECE = 4_000_000, 50_000
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all code points from U+0080, A-Z lower-cased."""
    return text.translate(_WORD).split() if text else []


class WuManber:
    """Search for word sequences of one length."""

    def __init__(self, m: int, windows: dict[tuple, Counter]):
        self.m, self.b = m, min(2, m)
        self.skip = m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, tuple[set, dict]] = {}
        for window, items in windows.items():
            for end in range(self.b, m + 1):
                block = window[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.skip), m - end)
            prefixes, strings = self.buckets.setdefault(window[m - self.b :], (set(), {}))
            prefixes.add(window[0])
            strings[window] = items

    def find(self, w: list[bytes]) -> Iterator[tuple[int, tuple, Counter]]:
        m, skip, shift, buckets = self.m, self.skip, self.shift.get, self.buckets
        i, n, two = m - 1, len(w), self.b == 2
        while i < n:
            block = (w[i - 1], w[i]) if two else (w[i],)
            step = shift(block, skip)
            if step:
                i += step
                continue
            prefixes, strings = buckets[block]
            if w[i - m + 1] in prefixes:
                window = tuple(w[i - m + 1 : i + 1])
                items = strings.get(window)
                if items:
                    yield i - m + 1, window, items
            i += 1


def searchers(pieces: list[tuple[str, bytes]], width: int = WIDTH) -> list[WuManber]:
    """Of (item, words joined by blanks): a searcher for each length, whose windows know how often
    each item holds them."""
    by_length: dict[int, dict[tuple, Counter]] = {}
    for item, text in pieces:
        w = words(text)
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), Counter())[item] += 1
    return [WuManber(m, windows) for m, windows in sorted(by_length.items())]


def scan(w: list[bytes], with_searchers: list[WuManber]) -> tuple[list[tuple[int, int]], Counter]:
    """Merged spans of hit words (end exclusive), and of each item whose windows occur the number
    of its places that hold one of them."""
    spans, own, seen = [], Counter(), set()
    for s in with_searchers:
        for at, window, items in s.find(w):
            spans.append((at, at + s.m))
            if window not in seen:
                seen.add(window)
                own.update(items)
    return merge(spans), own


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(bench: DataFrame, scratch: Scratch, item_col: str, text_col: str, width: int, block_bytes: int) -> tuple[DataFrame, int]:
    """(piece by piece: block, item, words, windows of the whole item; number of blocks)."""
    b = bench.select(bench[item_col].cast("string").alias("item"), bench[text_col].cast("binary").alias("text")).where("item is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                for lo in range(0, max(1, len(w) - width + 1) if w else 0, PIECE):
                    part = w[lo : lo + PIECE + width - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([b" ".join(part)], pa.binary()), pa.array([max(1, len(part) - width + 1)], pa.int64())], names=["item", "words", "places"])

    pieces = scratch.table(b.mapInArrow(cut, "item string, words binary, places bigint"), "benchmark-pieces")
    total = pieces.groupBy("item").agg(F.sum("places").alias("total"))
    size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    out = pieces.join(total, "item").select(F.pmod(F.xxhash64("item", "words"), F.lit(n)).alias("block"), "item", "words", "total")
    return scratch.table(out, "benchmark-blocks"), n


def annotate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Per document row: id, n_words, hit word spans (start, end), the items found, sorted, and
    the largest share of an item's windows. With ``carry`` every column of ``docs`` in the place
    of the id; what is added is then named __n_words, __hits, __items and __share."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    dealt, n = blocks(bench, scratch, item_col, bench_text_col, width, block_bytes)

    def passed(frame: DataFrame, k: int, sparse: bool) -> DataFrame:
        """``frame`` has the text as its last column; the others are kept, or given up for the
        text's digest where only texts with windows are asked for."""
        pieces = [(r.item, bytes(r.words), r.total) for r in dealt.where(F.col("block") == k).collect()]  # bounded by ``block_bytes``
        sent = spark.sparkContext.broadcast(pieces)
        kept = [] if sparse else frame.columns[:-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = searchers([(item, text) for item, text, _ in sent.value], width)
            totals = {item: total for item, _, total in sent.value}
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    digests, n_words, hits, items, shares = [], [], [], [], []
                    for text in part.column(part.num_columns - 1).to_pylist():
                        w = words(text)
                        spans, own = scan(w, tables)
                        if sparse and not own:
                            continue
                        digests.append(hashlib.sha256(text).digest() if sparse else None)
                        n_words.append(len(w))
                        hits.append([x for s in spans for x in s])
                        items.append(sorted(own))
                        shares.append([own[item] / totals[item] for item in items[-1]])
                    found = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
                    first = [pa.array(digests, pa.binary())] if sparse else [part.column(i) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*first, *found], names=[*(["digest"] if sparse else kept), *FOUND])

        columns = ["digest binary"] if sparse else [f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in kept]
        return frame.mapInArrow(run, ", ".join([*columns, "`__n_words` bigint, `__hits` array<int>, `__items` array<string>, `__shares` array<double>"]))

    text = docs[text_col].cast("binary")
    names = docs.columns if carry else [id_col]
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], text.alias("text"))
    if n == 1:
        found = passed(rows, 0, False)
        scratch.release()
    else:
        some = [scratch.table(passed(docs.select(text.alias("text")).where("text is not null"), k, True).dropDuplicates(["digest"]), "decontaminate") for k in range(n)]
        every = some[0]
        for more in some[1:]:
            every = every.unionByName(more)
        pairs = F.transform(F.sequence(F.lit(1), F.size("__hits"), F.lit(2)), lambda i: F.struct(F.element_at("__hits", i).alias("a"), F.element_at("__hits", i + 1).alias("b")))
        spans = every.select("digest", F.explode(pairs).alias("s")).select("digest", "s.a", "s.b")
        items = every.select("digest", F.explode(F.arrays_zip("__items", "__shares")).alias("s")).groupBy("digest", F.col("s.__items").alias("item")).agg(F.sum("s.__shares").alias("share"))
        items = items.groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("__items"), F.array(F.max("share")).alias("__shares"))
        lists = scratch.table(spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s")).join(items, "digest").select("digest", _merged("s").alias("__hits"), "__items", "__shares"), "decontaminate")
        counted = passed(rows.withColumn("c_digest", F.unhex(F.sha2("text", 256))).select(*[f"c{i}" for i in range(len(names))], "c_digest", "text"), -1, False).drop(*FOUND[1:])  # no block: counts the words
        scratch.release(lists)
        found = counted.join(lists, counted["c_digest"] == lists["digest"], "left").drop("c_digest", "digest")
        found = found.select(*[f"c{i}" for i in range(len(names))], "__n_words", F.coalesce("__hits", F.array().cast("array<int>")).alias("__hits"), F.coalesce("__items", F.array().cast("array<string>")).alias("__items"), F.coalesce("__shares", F.array().cast("array<double>")).alias("__shares"))
    share = F.coalesce(F.array_max("__shares"), F.lit(0.0))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    if carry:
        return found.select(*kept, "__n_words", "__hits", "__items", share.alias("__share"))
    return found.select(*kept, F.col("__n_words").alias("n_words"), F.col("__hits").alias("hits"), F.col("__items").alias("items"), share.alias("share"))


#: What a pass adds to a row.
FOUND = ["__n_words", "__hits", "__items", "__shares"]


def _merged(spans: str):
    """Flat starts and ends of sorted spans (a, b), overlapping ones as one."""
    none = F.array().cast("array<int>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(last, s["b"])))
        return F.when((F.size(acc) > 0) & (s["a"] <= F.get(acc, F.size(acc) - 1)), joined).otherwise(F.concat(acc, F.array(s["a"], s["b"])))

    return F.aggregate(spans, none, step)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = LEAST_ITEMS, **how) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = annotate(docs, bench, id_col, text_col, **how)
    hits = F.aggregate("hits", F.lit(0), lambda acc, x: -acc + x)  # (a, b, c, d) -> d - c + b - a
    return found.select(
        found[id_col], "n_words", hits.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", width: int = WIDTH, least_items: int = LEAST_ITEMS, least_share: float = LEAST_SHARE, least_run: int = LEAST_RUN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated rows: those that hold windows of ``least_items`` items,
    ``least_share`` of the windows of one, or ``least_run`` hit words in a row."""
    found = annotate(docs, bench, text_col=text_col, item_col=item_col, bench_text_col=bench_text_col, width=width, block_bytes=block_bytes, carry=True)
    run = F.coalesce(F.array_max(F.transform("__hits", lambda x, i: F.when(i % 2 == 1, x - F.get("__hits", i - 1)))), F.lit(0))
    return found.where((F.size("__items") < least_items) & (F.col("__share") < least_share) & (run < least_run)).select(docs.columns)


#: DuckDB SQL for the rows of the registered query.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(8, len(w)) AS m, w[i:i + least(8, len(w)) - 1] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, m, i, w[i:i + m - 1] AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) > 0)
), found AS (
  SELECT p.doc_id, p.i, p.m, x.item FROM places p JOIN windows x ON x.m = p.m AND x.win = p.win
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
