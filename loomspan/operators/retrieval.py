"""Ranked retrieval: exact cosine, BM25, reciprocal rank fusion, best chunk of a document.

All queries are answered at once, partitioned by query. Ranks are over the whole corpus; date
filters come after, so that they never renumber a rank. Every order ends in a unique id.
Queries are a stated set and small beside the corpus: they go to all tasks in blocks whose size
is checked, and each block meets all rows once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import index_line, index_tokens
from loomspan.session import materialize

RRF_K = 60
#: Rows of a side that may be sent to every task.
BLOCK = 1000
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 where a vector has no length. Vectors differ in size: null."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    wide = lambda v: v.cast("array<double>")
    dot = total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = lambda v: F.sqrt(total(F.transform(wide(v), lambda x: x * x)))
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, F.lit(0.0)).otherwise(dot / size))


def blocks(queries: DataFrame, key: str, most: int = BLOCK) -> Iterator[DataFrame]:
    """``queries`` in parts of about ``most`` rows, each small enough to be broadcast."""
    n = math.ceil(queries.count() / most)
    for k in range(n):
        yield queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)


def against_all(queries: DataFrame, rows: DataFrame, key: str, score) -> DataFrame:
    """Each query with each row and ``score``, a function of the joined frame to a Column."""
    found = [b for b in (rows.crossJoin(F.broadcast(q)) for q in blocks(queries, key))]
    if not found:
        found = [rows.limit(0).crossJoin(queries)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("sim", score)


def cosine_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of (query_id, query_vector) and (chunk_id, vector, ...): each pair with its ``sim``."""
    return against_all(queries, chunks, "query_id", cosine(F.col("query_vector"), F.col("vector")))


def dense_rank_from_zero(scored: DataFrame, score: str, tie: str, name: str = "rank", most: int | None = None) -> DataFrame:
    """Places from 0 by falling score, ties by ``tie``; the first ``most`` only, if given. Without
    ``most`` a query ranks the whole corpus: its rows are dealt by range and written, and a place
    is that within the range plus what the ranges before it hold of the same query, so no task
    takes all rows of a query."""
    order = [F.desc(score), F.asc_nulls_last(tie)]
    if most is not None:
        out = scored.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        return out.where(F.col(name) <= most).withColumn(name, F.col(name) - 1)
    dealt, _ = materialize(scored.repartitionByRange("query_id", *order).withColumn("__part", F.spark_partition_id()), "ranges")  # fixed from here on
    held = dealt.groupBy("query_id", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("query_id", "__part").orderBy(*order))
    out = dealt.withColumn(name, place).join(held.select("query_id", "__part", before.alias("__before")), ["query_id", "__part"])
    return out.withColumn(name, (F.col(name) - 1 + F.col("__before")).cast("int")).drop("__part", "__before")


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Of several (query_id, chunk_id, rank): (query_id, chunk_id, score), the sum of 1 / (k + rank)."""
    out = rankings[0].select("query_id", "chunk_id", "rank")
    for more in rankings[1:]:
        out = out.unionByName(more.select("query_id", "chunk_id", "rank"))
    return out.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def best_chunk(scored: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Of (query_id, doc, chunk_id, score, rank): each document's best chunk, ties to the earlier
    rank; ``first_rank`` is the document's earliest rank, which orders equal documents."""
    best = F.max_by(F.struct("chunk_id", "rank"), F.struct(F.col("score"), -F.col("rank")))
    return scored.groupBy("query_id", doc).agg(best.alias("b"), F.max("score").alias("score"), F.min("rank").alias("first_rank")).select("query_id", doc, F.col("b.chunk_id").alias("chunk_id"), "score", "first_rank")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, pos, length) of every index term; ``length`` is the document's number of terms."""
    tokens = docs.select(F.col(id_col), index_tokens(F.col(text_col)).alias("tokens"))
    return tokens.select(F.col(id_col), F.size("tokens").alias("length"), F.posexplode("tokens").alias("pos", "term")).select("term", id_col, "pos", "length")


def _terms_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (named, line): (term, places, docs) for each batch; ``docs`` counts rows with a name."""
    for batch in batches:
        named, tokens = batch.column("named").to_numpy(zero_copy_only=False), pc.split_pattern(batch.column("line"), " ")
        coded = tokens.flatten().dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy()
        ends = np.cumsum(tokens.value_lengths().to_numpy(), dtype=np.int64)
        last, place, once = np.zeros(len(terms), np.int64), np.arange(len(codes)), np.zeros(len(codes), bool)
        starts = np.concatenate([[0], ends[:-1]])
        for lo, hi in zip(starts[named].tolist(), ends[named].tolist(), strict=True):
            own = codes[lo:hi]
            last[own] = place[lo:hi]  # one of a term's places in the row stays
            once[lo:hi] = last[own] == place[lo:hi]
        counts = [pa.array(np.bincount(c, minlength=len(terms)).astype(np.int64)) for c in (codes, codes[once])]
        found = pa.RecordBatch.from_arrays([terms, *counts], names=["term", "places", "docs"]).filter(pc.not_equal(terms, ""))
        yield from (found.slice(lo, 10_000) for lo in range(0, found.num_rows, 10_000))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, places, docs): how often a term stands, and in how many ids. Terms are counted
    within batches of documents, so no posting is a row. An id that several rows share counts
    once for each of its terms: such rows alone are compared by id; a null id counts for none."""
    shared = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col(id_col).isNotNull() & (F.col("n") > 1)).select(id_col)
    single, several = docs, None
    if not shared.isEmpty():
        single, several = docs.join(shared, id_col, "left_anti"), docs.join(shared, id_col, "left_semi")
    lines = single.select(F.col(id_col).isNotNull().alias("named"), index_line(F.col(text_col)).alias("line"))
    found = lines.mapInArrow(_terms_of_batches, "term string, places bigint, docs bigint")
    if several is not None:
        held = postings(several, id_col, text_col).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("places"))
        found = found.unionByName(held.select("term", "places", F.lit(1).cast("bigint").alias("docs")))
    return found.groupBy("term").agg(F.sum("places").alias("places"), F.sum("docs").alias("docs"))


def phrases(queries: DataFrame) -> DataFrame:
    """Of (query_id, terms array<string>): (query_id, no, phrase), a term's tokens in order."""
    asked = queries.select("query_id", F.posexplode("terms").alias("no", "term"))
    return asked.select("query_id", "no", index_tokens(F.col("term")).alias("phrase")).where(F.size("phrase") > 0)


def asked_tokens(asked: DataFrame) -> list[str]:
    """The distinct tokens of the phrases; queries are a stated set, checked to be small."""
    tokens = [r[0] for r in asked.select(F.explode("phrase").alias("t")).distinct().limit(100 * BLOCK + 1).collect()]
    if len(tokens) > 100 * BLOCK:
        raise ValueError(f"queries of more than {100 * BLOCK} tokens")
    return tokens


def score_postings(places: DataFrame, asked: DataFrame, total: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """BM25 of postings (term, id, pos, length), at least of the tokens asked for, and the one row
    (docs, mean_length): (query_id, id, score) for documents that hold a term. Postings join the
    phrases on their terms; a phrase stands where each of its tokens has a place as many steps on."""
    wanted = asked.select("query_id", "no", F.size("phrase").alias("n"), F.posexplode("phrase").alias("k", "term"))
    starts = places.join(F.broadcast(wanted), "term").groupBy("query_id", "no", "n", id_col, (F.col("pos") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("held"), F.max("length").alias("length"))
    hits = starts.where("held = n").groupBy("query_id", "no", id_col).agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))
    df = hits.groupBy("query_id", "no").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    # df has a row per query term, total has one
    return hits.join(F.broadcast(df), ["query_id", "no"]).crossJoin(F.broadcast(total)).groupBy("query_id", id_col).agg(F.sum(part).alias("score"))


def statistics(docs: DataFrame, length: str = "length") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(length).alias("mean_length"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of documents and (query_id, terms array<string>): (query_id, id, score) for documents that
    hold a term. A term of several tokens is a phrase. Texts are taken apart once; what is kept of
    a document are its length and the places of tokens that are asked for."""
    asked = phrases(queries)
    wanted = F.array(*map(F.lit, asked_tokens(asked))).cast("array<string>")
    tokens = docs.select(F.col(id_col), index_tokens(F.col(text_col)).alias("tokens"))
    kept = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda x: F.array_contains(wanted, x["term"]))
    held, _ = materialize(tokens.select(id_col, F.size("tokens").alias("length"), kept.alias("hits")), "asked-postings")
    return score_postings(held.select(id_col, "length", F.inline("hits")), asked, statistics(held), id_col)


def result(rows: DataFrame, text_col: str = "text", chars: int = 160) -> DataFrame:
    """Result rows: rounded scores, the day of change and the beginning of the text in one line."""
    snippet = F.translate(F.substring(text_col, 1, chars), "\n", " ")
    return rows.withColumn("score", F.round("score", 4)).withColumn("sim", F.round("sim", 3)).withColumn("modified", F.substring(F.col("modified").cast("string"), 1, 10)).withColumn("snippet", snippet)


def hybrid(semantic: DataFrame, keyword: DataFrame | None, in_range: Column, top: int, doc: str = "doc_id") -> DataFrame:
    """Fused ranking: ``semantic`` has (query_id, doc, chunk_id, sim, rank, dates ...) of all
    chunks, ``keyword`` (query_id, chunk_id, rank) or None. Dates filter after ranking."""
    fused = rrf([semantic, keyword] if keyword is not None else [semantic]).withColumnRenamed("score", "fused")
    scored = semantic.join(fused, ["query_id", "chunk_id"]).where(in_range).withColumn("score", F.col("fused"))
    best = best_chunk(scored, doc)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank"))
    return best.withColumn("place", place).where(F.col("place") <= top)
