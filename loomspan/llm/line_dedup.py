"""Line dedup with two Bloom filters.

Pass 1: every task fills two blocked Bloom filters from the long line keys of its documents:
once-seen, and twice-seen for keys of a second document. Filters of tasks meet segment by
segment, first those of ``TOGETHER`` tasks, then the results: a key is seen twice if any task saw
it twice or two tasks saw it once. Pass 2: only
lines whose hash the merged twice-seen filter holds are suspected; of these a SHA-256 digest
and the document's id are shuffled, counted exactly, and the occurrence to keep is chosen.
Pass 3 joins the dropped digests to the documents.

The twice-seen filter is all that reaches the driver and the tasks. Its size follows the
input but never passes ``MAX_BITS`` (32 MB); beyond that a fuller filter only sends more
suspects through the exact count, results stay the same.

Rows: a null or empty text is one empty line. A row is a document, also if its id repeats;
all rows with the largest id that hold a line keep it. A null id is smaller than any other.
Lines within one document count once. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import materialize

LEAST_CHARS = 40
LEAST_DOCS = 5
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
SEGMENT_BITS = 1 << 16
PROBES = 4
#: Tasks whose filters meet first.
TOGETHER = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def keys(lines: list[bytes], least: int = LEAST_CHARS) -> list[bytes | None]:
    """The key of each line, or None for keys under ``least`` code points."""
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip() if len(line) >= least else b""
        n = len(key)
        out.append(key if n >= least and (n >= 4 * least or key.isascii() or len(key.decode()) >= least) else None)
    return out


def doc_keys(text: bytes | None, least: int = LEAST_CHARS) -> set[bytes]:
    found = set(keys(text.translate(_LOWER).split(b"\n"), least)) if text else set()
    found.discard(None)
    return found


def hashes(found) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64)


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its ``PROBES`` bits within the segment."""
    segment = (h >> np.uint64(40)) & np.uint64(bits // SEGMENT_BITS - 1)
    a, b = h & np.uint64(0xFFFF), ((h >> np.uint64(16)) & np.uint64(0xFFFF)) | np.uint64(1)
    probes = (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(SEGMENT_BITS - 1)
    return segment.astype(np.int64), probes.astype(np.int64)


def fill(h: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """Packed bits of the segments that ``h`` touches."""
    segment, probes = places(h, bits)
    flat = np.unique((segment[:, None] * SEGMENT_BITS + probes).ravel())
    out: dict[int, np.ndarray] = {}
    if not len(flat):
        return out
    where = flat // SEGMENT_BITS
    for s, part in zip(np.unique(where), np.split(flat, np.flatnonzero(np.diff(where)) + 1), strict=True):
        packed = np.zeros(SEGMENT_BITS // 8, np.uint8)
        at = part - s * SEGMENT_BITS
        np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
        out[int(s)] = packed
    return out


class Suspects:
    """Membership in the merged twice-seen filter."""

    def __init__(self, segments: dict[int, bytes], bits: int):
        self.bits, self.packed = bits, np.zeros(bits // 8, np.uint8)
        for s, z in segments.items():
            self.packed[s * SEGMENT_BITS // 8 : (s + 1) * SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(z), np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        segment, probes = places(h, self.bits)
        at = segment[:, None] * SEGMENT_BITS + probes
        return ((self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def filter_bits(docs: DataFrame) -> int:
    """Bits for one filter: about 16 for each 64 bytes that the plan expects to read."""
    expected = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 1 << (min(max(expected // 4, MIN_BITS), MAX_BITS) - 1).bit_length()


def twice_seen(texts: DataFrame, bits: int, least: int = LEAST_CHARS) -> dict[int, bytes]:
    """Segments of the filter of keys that at least two documents hold; one binary column in."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                seen += [hashes(found) for t in batch.slice(lo, 512).column(0).to_pylist() if (found := doc_keys(t, least))]
        if not seen:
            return
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        once, twice = fill(h, bits), fill(h[n > 1], bits)
        rows = [(s, zlib.compress(p, 1), zlib.compress(twice[s], 1) if s in twice else None) for s, p in once.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["segment", "once", "twice"])

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
        for a, b in zip(part["once"], part["twice"], strict=True):
            a = np.frombuffer(zlib.decompress(a), np.uint8)
            twice |= once & a
            once |= a
            if b is not None:
                twice |= np.frombuffer(zlib.decompress(b), np.uint8)
        packed = [zlib.compress(x.tobytes(), 1) if x.any() else None for x in (once, twice)]
        return pd.DataFrame({"segment": [part["segment"].iloc[0]], "once": packed[:1], "twice": packed[1:]})

    schema = "segment int, once binary, twice binary"
    near = F.floor(F.spark_partition_id() / TOGETHER)
    merged = texts.mapInArrow(local, schema).groupBy("segment", near).applyInPandas(meet, schema).groupBy("segment").applyInPandas(meet, schema).where("twice is not null").select("segment", "twice")
    return {r.segment: bytes(r.twice) for r in merged.collect()}  # bounded by MAX_BITS


def suspects(docs: DataFrame, bits: int, segments: dict[int, bytes], least: int = LEAST_CHARS) -> DataFrame:
    """(id, digest) of each suspected key of each document row; (id, text as binary) in."""
    sent = docs.sparkSession.sparkContext.broadcast(segments)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Suspects(sent.value, bits)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found, rows = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    own = doc_keys(t, least)
                    found += own
                    rows += [i] * len(own)
                if not found:
                    continue
                hit = np.flatnonzero(held.holds(hashes(found)))
                digests = [hashlib.sha256(found[i]).digest() for i in hit]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([rows[i] for i in hit], pa.int64())), pa.array(digests, pa.binary())], names=["id", "digest"])

    return docs.mapInArrow(run, f"id {kind}, digest binary")


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, digests): the digests of the line keys that each document id loses."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    bits = filter_bits(texts)
    found, _ = materialize(suspects(texts, bits, twice_seen(texts.select("text"), bits, least_chars), least_chars), "line-suspects")
    common, _ = materialize(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs).drop("n"), "line-common")
    return found.join(common, "digest").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(F.collect_set("digest").alias("digests"))


def strip(text: bytes | None, digests, least: int = LEAST_CHARS) -> tuple[bytes, int, int]:
    """(kept text, lines before, lines dropped)."""
    text = text or b""
    if digests is None or not len(digests):
        return text, text.count(b"\n") + 1, 0
    gone = {bytes(d) for d in digests}
    lines = text.split(b"\n")
    kept = [line for line, key in zip(lines, keys(text.translate(_LOWER).split(b"\n"), least), strict=True) if key is None or hashlib.sha256(key).digest() not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _joined(docs: DataFrame, id_col: str, text_col: str, **how) -> tuple[DataFrame, Column]:
    gone = dropped(docs, id_col, text_col, **how).select(F.col("id").alias("__gone_id"), F.col("digests").alias("__digests"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone_id"]), "left"), gone["__digests"]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, **how) -> DataFrame:
    """``docs`` with the same columns, repeated lines gone from the text (null becomes empty)."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([strip(None if t is None else bytes(t), d, least_chars)[0].decode() for t, d in zip(text, digests, strict=True)], dtype=object)

    both, digests = _joined(docs, id_col, text_col, least_chars=least_chars, **how)
    return both.select(*[kept(docs[c].cast("binary"), digests).alias(c) if c == text_col else docs[c] for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, **how) -> DataFrame:
    """Per document row: id, n_lines, n_dropped, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [strip(t, d, least_chars) for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got])], names=[id_col, "n_lines", "n_dropped", "kept_sha256"])

    both, digests = _joined(docs.select(docs[id_col], docs[text_col].cast("binary").alias(text_col)), id_col, text_col, least_chars=least_chars, **how)
    kind = docs.schema[id_col].dataType.simpleString()
    return both.select(id_col, text_col, digests).mapInArrow(run, f"`{id_col}` {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


#: DuckDB SQL for the rows of the registered query.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), c AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM l LEFT JOIN c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
