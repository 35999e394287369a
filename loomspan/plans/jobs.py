"""Whole jobs: build an index of files, search it, evaluate a search, record a stream.

An index is a folder of generations; each holds ``docs``, ``chunks``, ``postings`` (sorted by term, so
a search reads the ranges of its terms) and ``stats`` as Parquet, and counts only once all are
complete. A build reads the last generation, replaces what it
finds again and writes the next; files that are gone stay unless ``prune`` is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import chunking, providers, text, timephrase
from loomspan.operators import evaluate, notes, retrieval, tables, transcript
from loomspan.session import materialize, release
from loomspan.sources import files
from loomspan.streaming import sinks, state

TABLES = ("docs", "chunks", "postings", "stats")
Embedder = Callable[[], Callable[[list[str]], list[list[float]]]]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def generation(spark: SparkSession, index: str) -> int:
    """The last complete generation; 0 for none."""
    n = 0
    while all(_exists(spark, f"{index}/{n + 1}/{t}/_SUCCESS") for t in TABLES):
        n += 1
    return n


def read(spark: SparkSession, index: str) -> dict[str, DataFrame]:
    n = generation(spark, index)
    if not n:
        raise ValueError(f"no index at {index}")
    return {t: spark.read.parquet(f"{index}/{n}/{t}") for t in TABLES}


def build(spark: SparkSession, folder: str, index: str, embed: Embedder = providers.hashing_embedder, prune: bool = False) -> dict[str, int]:
    """Counts of documents, chunks and skipped files of the new generation."""
    if not _exists(spark, folder):
        raise ValueError(f"no folder {folder}")
    found, path = materialize(files.documents(files.scan(spark, folder)), "found-files")
    docs, skipped = found.where("error is null").withColumn("seen", F.current_timestamp()), found.where("error is not null").count()
    units = files.units(docs)
    pieces = units.select("doc_id", "path", "title", "pos", "unit_id", F.posexplode(chunking.chunker()(F.col("text"))).alias("no", "text"))
    chunk_id = F.format_string("%s#%06d#%06d", "path", "pos", "no")
    chunks = pieces.select(chunk_id.alias("chunk_id"), "doc_id", "unit_id", "text", providers.embedding(embed)(chunking.embed_context(F.col("title"), F.col("text"))).alias("vector"))
    docs = docs.drop("units", "error")
    n = generation(spark, index)
    if n:
        old = read(spark, index)
        before = tables.prune(old["docs"], found, "path") if prune else old["docs"]
        chunks = tables.replace_children(tables.prune(old["chunks"], before, "doc_id"), chunks, "doc_id")
        # a document that lost all its text has no fresh chunk to replace the old ones
        emptied = docs.select("doc_id").join(pieces.select("doc_id").distinct(), "doc_id", "left_anti")
        chunks = chunks.join(emptied, "doc_id", "left_anti").select("chunk_id", "doc_id", "unit_id", "text", "vector")
        docs = tables.upsert(before, docs, "path", "seen")
    at = f"{index}/{n + 1}"
    docs.write.mode("overwrite").parquet(f"{at}/docs")
    chunks.write.mode("overwrite").parquet(f"{at}/chunks")
    stored = spark.read.parquet(f"{at}/chunks")
    retrieval.postings(stored, "chunk_id", "text").repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{at}/postings")
    lengths = spark.read.parquet(f"{at}/postings").groupBy("chunk_id").agg(F.max("length").alias("length"))
    sized = stored.select("chunk_id").join(lengths, "chunk_id", "left").select(F.coalesce("length", F.lit(0)).alias("length"))
    retrieval.statistics(sized).write.mode("overwrite").parquet(f"{at}/stats")
    release(spark, path)
    return {"docs": spark.read.parquet(f"{at}/docs").count(), "chunks": stored.count(), "skipped": skipped}


def search(index: dict[str, DataFrame], queries: DataFrame, embed: Embedder = providers.hashing_embedder, top: int = 5) -> DataFrame:
    """Of (query_id, query, today): the ``top`` documents of each query, best chunk and beginning
    of its text; keywords count only where a query has quoted phrases or codes."""
    asked = queries.select("query_id", "query", timephrase.parse(F.col("query"), F.coalesce(F.col("today"), F.current_date())).alias("t")).select("query_id", "t.start", "t.end", timephrase.search_text(F.col("query"), F.col("t.rest")).alias("said"))
    asked = asked.withColumn("query_vector", providers.embedding(embed)("said")).withColumn("terms", text.exact_terms(F.col("said")))
    asked, _ = materialize(asked, "asked")  # parsed and embedded once, read by every plan below
    scored = retrieval.cosine_scores(asked.select("query_id", "start", "end", "query_vector"), index["chunks"].select("chunk_id", "doc_id", "vector"))
    dates = index["docs"].select("doc_id", "created", "modified")
    ranked = retrieval.dense_rank_from_zero(scored.drop("vector", "query_vector"), "sim", "chunk_id").join(dates, "doc_id")
    semantic, _ = materialize(ranked, "semantic")  # read three times below
    phrases = retrieval.phrases(asked.where(F.size("terms") > 0).select("query_id", "terms"))
    places = index["postings"].where(F.col("term").isin(retrieval.asked_tokens(phrases)))
    found = retrieval.score_postings(places, phrases, index["stats"], "chunk_id")
    keyword = retrieval.dense_rank_from_zero(found, "score", "chunk_id")
    ok = timephrase.in_range(F.col("start"), F.col("end"), F.col("modified"), F.col("created"))
    best = retrieval.hybrid(semantic, keyword, ok, top)
    # texts are fetched for the winners alone
    out = best.join(semantic.select("query_id", "chunk_id", "sim"), ["query_id", "chunk_id"]).join(keyword.select("query_id", "chunk_id", F.lit(True).alias("hit")), ["query_id", "chunk_id"], "left")
    out = out.join(index["docs"].select("doc_id", "name", "title", "path", "modified", "kind"), "doc_id").join(index["chunks"].select("chunk_id", "text"), "chunk_id")
    return retrieval.result(out.withColumn("keyword_hit", F.coalesce("hit", F.lit(False)))).select("query_id", "place", "score", "sim", "keyword_hit", "name", "title", "path", "modified", "kind", "snippet")


def validate(index: dict[str, DataFrame], cases: DataFrame, embed: Embedder = providers.hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """Of (query, expect, today): the metrics, and the first matching place of each case."""
    numbered = cases.withColumn("query_id", F.xxhash64("query", "expect"))
    results = search(index, numbered, embed).select("query_id", "place", "name")
    judged = numbered.select("query_id", "expect").join(results, "query_id", "left")
    first = evaluate.first_match(judged, evaluate.names_match(F.col("name"), F.col("expect")))
    return evaluate.metrics(first), first


def record(shown: DataFrame, out: str, session: str = "session") -> None:
    """Finals of (session, at, said_lang, said, other_lang, translation, final) as transcript lines,
    a folder per session; drafts never reach it."""
    lines = transcript.render(shown.where("final")).select(session, "at", F.rtrim(F.col("record"), F.lit("\n")).alias("value"))
    lines.repartitionByRange(F.col(session), F.col("at")).sortWithinPartitions(session, "at").select(session, F.concat("value", F.lit("\n")).alias("value")).write.mode("append").partitionBy(session).text(out)


def listen(spark: SparkSession, frames: str, out: str, checkpoint: str, idle: int | None = 60_000, tick: str | None = None):
    """Utterances of a folder of frames (stream, seq, speech, power) as they come, a folder a
    batch below ``out``; over what there is now, or every ``tick`` for as long as it runs."""
    rows = spark.readStream.schema("stream string, seq long, speech boolean, power double").parquet(frames)
    shown = state.run(rows, state.Utterances, state.UTTERANCE, idle)
    query = state.start(spark, shown, checkpoint, lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"), tick)
    if not tick:
        query.awaitTermination()
    return query


def minutes(spark: SparkSession, transcripts: str, out: str, make=providers.extractive_notes, translate=None, target: str = "tr") -> DataFrame:
    """Notes of every transcript file of a folder, a text file a session below ``out``, and what
    they say that nobody said: (session, words, numbers). A session is the file's path."""
    whole = spark.read.text(transcripts, wholetext=True).select(F.col("_metadata.file_name").alias("session"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    entries = transcript.parse(whole)
    if translate is not None:
        entries = notes.fill_gaps(entries, translate, target)
    entries, _ = materialize(entries, "entries")
    written, _ = materialize(notes.write(notes.prompt(entries, target=target), make), "notes")
    sinks.notes(written, out)
    return notes.audit(written, entries).where((F.size("words") > 0) | (F.size("numbers") > 0))
