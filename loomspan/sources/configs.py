"""Editorial configuration as DataFrames: topics, feeds, video sources, publications, glossary."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC = "name string, enabled boolean, pillar string, audiences array<string>, search_set string, query string, mode string, schedule string, freshness_window string, retention_days int, report string, ranking map<string,int>"
VIDEO = "name string, handle string, lane string, enabled boolean, channel_id string"
PUBLICATION = "key string, title string, base string, feeds array<array<string>>, target_items int, cadence string, pillars array<array<string>>, theme map<string,string>"
CASE = "query string, expect string, today date"


def topics(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Topics from parsed configuration; names that a topic lacks are null."""
    names = [part.strip().split(" ", 1)[0] for part in TOPIC.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TOPIC)


def topics_file(spark: SparkSession, path: str) -> DataFrame:
    """Topics of a YAML file under its ``topics``; a report that is a mapping keeps its format."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML takes the yaml package; topics() takes parsed rows") from e
    rows = []
    for r in spark.read.text(path, wholetext=True).collect():  # a file of configuration
        for topic in (yaml.safe_load(r.value) or {}).get("topics") or []:
            report = topic.get("report")
            rows.append(topic | {"report": report.get("format") if isinstance(report, dict) else report})
    return topics(spark, rows)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def video_sources(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, f"sources array<struct<{VIDEO.replace(' ', ':').replace(',:', ',')}>>").select(F.explode("sources").alias("s")).select("s.*")


def publications(spark: SparkSession, path: str) -> DataFrame:
    """Malformed files have no publications; they end nothing."""
    return _json(spark, path, f"publications array<struct<{', '.join(p.replace(' ', ': ', 1) for p in PUBLICATION.split(', '))}>>").select(F.explode("publications").alias("p")).select("p.*")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Queries with the name they are to find and, at times, the day they are asked on."""
    return _json(spark, path, CASE)


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """(group, title, feed, site) of a two-level OPML outline."""
    rows = []
    for r in spark.read.text(path, wholetext=True).collect():  # a file of configuration
        for group in ElementTree.fromstring(r.value).iter("outline"):
            rows += [(group.get("text"), f.get("text"), f.get("xmlUrl"), f.get("htmlUrl")) for f in group.findall("outline")]
    return spark.createDataFrame(rows, "group string, title string, feed string, site string")


def glossary(spark: SparkSession, lines: str) -> DataFrame:
    """(term, target) of plain ``term = target`` lines."""
    rows = [tuple(x.strip() for x in line.split("=", 1)) for line in lines.splitlines() if "=" in line]
    return spark.createDataFrame(rows, "term string, target string")
