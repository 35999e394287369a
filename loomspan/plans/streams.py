"""Queries of stream segmentation, captions and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import scratch, table
from loomspan.sources import frames as audio
from loomspan.streaming import captions, segments, state

HALF_DAY = 12 * 3600
LONGEST, CARRY = 8, 2


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.gap_sessions(table(spark, sf_dir, "events"), "user_id", "ts", HALF_DAY)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


def capped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions cut after eight events, two of them carried over."""
    s = gap_sessions(spark, sf_dir).select("user_id", "session", F.explode(segments.cuts(F.col("events"), LONGEST, CARRY)).alias("c"))
    return s.select("user_id", "session", F.col("c.no").alias("part"), F.col("c.start").alias("first"), (F.col("c.end") - 1).alias("last"))


def made_frames(spark: SparkSession, streams: int = 8, length: int = 1200) -> DataFrame:
    """Frames with speech, pauses of 19 frames and a silent tail, all from their numbers."""
    f = spark.range(streams * length).select((F.col("id") % streams).cast("string").alias("stream"), F.floor(F.col("id") / streams).alias("seq"))
    at = F.col("seq") % (300 + 50 * F.col("stream").cast("int"))
    return f.withColumn("speech", (at >= 20) & (at < 270)).withColumn("power", F.when(F.col("seq") < length - 200, 0.01).otherwise(0.0))


def frame_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.intervals(made_frames(spark))


def caption_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captions.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts")
    return rows.select("user_id", "event_type", "ts", "event_id", "first_shown")


def caption_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captions.window(caption_upsert(spark, sf_dir), "user_id", "first_shown", "event_type", retain=7 * 86400.0)
    return rows.select("user_id", "event_type", "place")


def level_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audio.levels(table(spark, sf_dir, "events"), "user_id", "ts", "value")
    return rows.select("event_id", F.round("peak", 6).alias("peak"))


def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as samples, cut into frames of sixteen, with the level of each."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(audio.frames(F.col("embedding"), 16)).alias("no", "frame"))
    return e.select("vec_id", "no", F.round(audio.rms(F.col("frame")), 6).alias("rms"), audio.is_silent(F.col("frame")).alias("silent"))


def level_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loudest frame of every vector taken as a source, and whether anything is heard on it."""
    return audio.probe(frame_levels(spark, sf_dir), "vec_id", "rms", 0.22)


def described_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows on screen with what is known of their users: the odd ones have no name."""
    users = table(spark, sf_dir, "events").where("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.concat(F.lit("user "), F.col("user_id")).alias("name"))
    return captions.described(caption_window(spark, sf_dir), users, "user_id", name="?")


def stream_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen of every user after a stream of events has passed the state store."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern that only this file matches
    rows = rows.select(F.col("user_id").cast("string").alias("stream"), segments.seconds_of(F.col("ts")).alias("now"), F.col("event_type").alias("key"), F.col("value").cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    out, log = scratch(spark, "captions"), scratch(spark, "captions-log")
    state.drain(spark, state.run(rows, state.Captions, state.CAPTION), log, lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(out))
    shown = spark.read.parquet(out)
    last = shown.groupBy("stream").agg(F.max("batch").alias("batch"))
    return shown.join(last, ["stream", "batch"]).select("stream", "place", "key", "text")


QUERIES = {f.__name__: f for f in (gap_sessions, capped_sessions, frame_utterances, caption_upsert, caption_window, level_peaks, frame_levels, level_probe, described_captions, stream_captions)}

_G = f"g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= {HALF_DAY} THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g), k AS (SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS begins, max(ts) AS ends FROM s GROUP BY 1, 2)"
_L = "l AS (SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, ts) AS event_id, min(ts) AS first_shown FROM events GROUP BY 1, 2)"
#: Frames in blocks: 188 to the first cut, 178 more to each later one; drafts at 63, 126 and 73, 136.
_F = """f AS (SELECT CAST(i % 8 AS VARCHAR) AS stream, i // 8 AS seq, (i // 8) % (300 + 50 * (i % 8)) AS pos, 300 + 50 * (i % 8) AS period FROM range(9600) t(i)),
g AS (SELECT stream, seq // period AS segment, min(seq) AS b, max(seq) AS e FROM f WHERE pos BETWEEN 20 AND 270 GROUP BY 1, 2),
h AS (SELECT stream, segment, b - least(9, b - coalesce(lag(e) OVER (PARTITION BY stream ORDER BY segment) + 1, 0)) AS base, e FROM g),
p AS (SELECT stream, segment, base, e - base + 1 AS l, unnest(range(0, CASE WHEN e - base + 1 >= 188 THEN (e - base + 1 - 188) // 178 + 2 ELSE 1 END)) AS no FROM h),
q AS (SELECT *, no * 178 AS s, least(no * 178 + 188, l) AS t, CASE WHEN no = 0 THEN [63, 126] ELSE [73, 136] END AS d FROM p),
v AS (SELECT stream, segment, no, base + s AS first, x AS n, false AS final, i AS version FROM (SELECT *, unnest(d) AS x, unnest([0, 1]) AS i FROM q) WHERE x <= t - s UNION ALL
      SELECT stream, segment, no, base + s, t - s, true, len(list_filter(d, lambda x: x <= t - s)) FROM q),
w AS (SELECT *, first + n - 1 AS last FROM v WHERE sqrt(greatest(0, least(first + n, 1000) - first) * 0.01 / n) >= 0.001)"""
ORACLE_SQL = {
    "gap_sessions": f"WITH {_G} SELECT * FROM k",
    "capped_sessions": f"WITH {_G}, c AS (SELECT user_id, session, events, unnest(range(0, CASE WHEN events >= {LONGEST} THEN (events - {LONGEST}) // {LONGEST - CARRY} + 2 ELSE 1 END)) AS part FROM k) SELECT user_id, session, part, part * {LONGEST - CARRY} AS first, least(part * {LONGEST - CARRY} + {LONGEST}, events) - 1 AS last FROM c",
    "frame_utterances": f"WITH {_F} SELECT stream, CAST(coalesce(sum(final::INT) OVER (PARTITION BY stream ORDER BY segment, no, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS index, CAST(version AS INTEGER) AS version, final, first * 512 / 16000.0::DOUBLE AS \"at\", first, last FROM w",
    "caption_upsert": f"WITH {_L} SELECT * FROM l",
    "caption_window": f"WITH {_L}, p AS (SELECT user_id, event_type, first_shown, row_number() OVER (PARTITION BY user_id ORDER BY first_shown DESC, event_type DESC) AS place, max(first_shown) OVER (PARTITION BY user_id) AS newest FROM l) SELECT user_id, event_type, CAST(place AS INTEGER) AS place FROM p WHERE place <= 2 AND epoch(newest) - epoch(first_shown) <= {7 * 86400}",
    "level_peaks": "SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 6) AS peak FROM events",
    "frame_levels": "WITH f AS (SELECT vec_id, no, embedding[no * 16 + 1:no * 16 + 16]::DOUBLE[] AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 16)) AS no FROM embeddings)) SELECT vec_id, CAST(no AS INTEGER) AS no, round(sqrt(list_dot_product(x, x) / 16), 6) AS rms, sqrt(list_dot_product(x, x) / 16) < 0.001 AS silent FROM f",
    "level_probe": "WITH f AS (SELECT vec_id, no, embedding[no * 16 + 1:no * 16 + 16]::DOUBLE[] AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 16)) AS no FROM embeddings)) SELECT vec_id, max(round(sqrt(list_dot_product(x, x) / 16), 6)) AS loudest, max(round(sqrt(list_dot_product(x, x) / 16), 6)) >= 0.22 AS audible FROM f GROUP BY vec_id",
    "described_captions": f"WITH {_L}, p AS (SELECT user_id, event_type, first_shown, row_number() OVER (PARTITION BY user_id ORDER BY first_shown DESC, event_type DESC) AS place, max(first_shown) OVER (PARTITION BY user_id) AS newest FROM l) SELECT user_id, event_type, CAST(place AS INTEGER) AS place, CASE WHEN user_id % 2 = 0 THEN 'user ' || user_id ELSE '?' END AS name FROM p WHERE place <= 2 AND epoch(newest) - epoch(first_shown) <= {7 * 86400}",
}
