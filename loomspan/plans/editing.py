"""Queries of the editorial pipeline and of tables kept up to date."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import canonical_url, item_format
from loomspan.functions.udf import series_udf
from loomspan.operators import editorial, evaluate, publish, tables
from loomspan.session import table
from loomspan.sources import files, fixtures

WEIGHTS = {"authority": 45, "relevance": 30, "freshness": 25}
GLOSSARY = [("the of", "x"), ("of the", "y"), ("license", "Lizenz"), ("public license", "öffentliche Lizenz"), ("reserved", "vorbehalten")]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: sub-scores, two tags and a section that follow from their numbers."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", (F.col("doc_id") % 101).alias("authority"), (F.col("n_chars") % 101).alias("relevance"), (F.col("doc_id") * 7 % 101).alias("freshness"))
    tags = F.array(*map(F.lit, editorial.TAG_ORDER))
    d = d.withColumn("tags", F.array(F.element_at(tags, (F.col("doc_id") % 7 + 1).cast("int")), F.element_at(tags, (F.col("n_chars") % 7 + 1).cast("int"))))
    tag = editorial.leading_tag(F.col("tags"))
    return d.withColumn("tag", tag).withColumn("section", editorial.section(tag)).withColumn("score", F.round(editorial.weighted(WEIGHTS), 6))


def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("doc_id", "score", editorial.band(F.col("score")).alias("band"))


def section_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("doc_id", "tag", "section", editorial.section_place(F.col("section")).cast("int").alias("place"))


def topn_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editorial.suggest(_items(spark, sf_dir), "section", "score", "doc_id", 6).select("doc_id", "section", "score", "suggested", "selected")


def share_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.shares(_items(spark, sf_dir), "section").withColumn("share", F.round("share", 6))


def source_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.precision(d, "source", F.col("quality") == 1, 5).withColumn("precision", F.round("precision", 6))


def item_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no images: their sizes in pixels are made from the length of the text."""
    d = table(spark, sf_dir, "documents").join(editorial.copies(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    names = editorial.flags(possible_duplicate=F.col("copies") > 1, health_claim=editorial.health_claim(F.col("text")), small_image=editorial.small_image(F.col("n_chars") % 1600, F.col("n_chars") % 900))
    return d.select("doc_id", F.array_join(names, ",").alias("flags"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editorial.copies(table(spark, sf_dir, "documents"), "doc_id", "text")


def canonical_url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    more = [p.withColumn("source", F.lit("a")), p.select("page_id", F.concat("url", F.when(F.col("url").contains("?"), "&utm_source=x").otherwise("?utm_source=x")).alias("url"), F.lit("b").alias("source")).where("url not like '%#%'"), p.select("page_id", F.concat("url", F.lit("#top")).alias("url"), F.lit("c").alias("source"))]
    out = editorial.dedupe_urls(more[0].unionByName(more[1]).unionByName(more[2]), "url", "page_id", "source")
    return out.select("canonical", "first_id", F.array_join("sources", ",").alias("sources"), "items")


def glossary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editorial.glossary_hits(table(spark, sf_dir, "documents"), spark.createDataFrame(GLOSSARY, "term string, target string"), "doc_id", "text")


def missing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editorial.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("version"))
    return tables.upsert(d.where("doc_id % 3 <> 0"), d.where("doc_id % 2 = 0").select("doc_id", F.lit("xx").alias("lang"), F.lit(2).alias("version")), "doc_id", "version")


def chunk_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return tables.replace_children(e, e.where("user_id % 7 = 0 and value > 50").withColumn("value", F.lit(0.0)), "user_id").select("event_id", "user_id", F.round("value", 6).alias("value"))


def left_anti_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return tables.prune(d, d.where("doc_id % 5 <> 0"), "doc_id")


def site_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    local = d.where("doc_id % 4 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    live = d.where("doc_id % 6 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    return tables.compare(local, live, "doc_id", "digest")


def edit_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return tables.edits(d, d.withColumn("text", F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" and more"))).otherwise(F.col("text"))), "item_id", "text")


@series_udf("binary")
def _packed(item: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([fixtures.docx([("Heading1", f"Item {i}"), *(("", line) for line in (t or "").split("\n"))], author="me") for i, t in zip(item, text, strict=True)], dtype=object)


def ingest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item packed as an office file and read again."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("/items/"), F.col("item_id"), F.lit(".docx")).alias("path"), F.concat(F.col("item_id"), F.lit(".docx")).alias("name"), F.lit("docx").alias("kind"), F.lit("2024-01-01").cast("timestamp").alias("modified"), _packed("item_id", "text").alias("content"))
    return files.units(files.documents(b)).select("path", "unit_type", "unit_id", "heading", "text")


@series_udf("binary")
def _mapped(item: pd.Series, text: pd.Series) -> pd.Series:
    """Every other item as a mind map in JSON, with a note and a label, the others in XML."""
    from xml.sax.saxutils import escape

    def one(i: str, words: list[str]) -> bytes:
        if int(i) % 2:
            topics = "".join(f"<topic><title>{escape(w)}</title></topic>" for w in words)
            return fixtures.xmind_xml(f"<sheet><topic><title>Map {i}</title><children><topics>{topics}</topics></children></topic></sheet>")
        branches = [{"title": w, "children": {"attached": [{"title": w + "!", "labels": ["l"], "notes": {"plain": {"content": "n"}}}]}} for w in words]
        return fixtures.xmind_json([{"title": f"Sheet {i}", "rootTopic": {"title": f"Map {i}", "children": {"attached": branches}}}])

    return pd.Series([one(i, (t or "").split()[:3]) for i, t in zip(item, text, strict=True)], dtype=object)


def mindmap_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of every benchmark item as branches of a mind map, packed and read again."""
    item = F.col("item_id").cast("string")
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("/maps/"), item, F.lit(".xmind")).alias("path"), F.concat(item, F.lit(".xmind")).alias("name"), F.lit("xmind").alias("kind"), F.lit("2024-01-01").cast("timestamp").alias("modified"), _mapped(item, F.col("text")).alias("content"))
    return files.units(files.documents(b)).select("path", "pos", "unit_id", "heading", "text")


def origin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract(canonical_url(F.col("url")), "^https://([^/?]*)", 1).alias("host"))
    return evaluate.shares(p, "host").withColumn("share", F.round("share", 6))


def selected_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of six wanted in each section, those that a person has chosen: every thirteenth item here."""
    return editorial.selected_counter(_items(spark, sf_dir).withColumn("selected", F.col("doc_id") % 13 == 0), "section", 6)


def source_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.concentration(_items(spark, sf_dir), "section", "source")
    return out.select("section", "items", "members", F.round("largest", 6).alias("largest"), F.round("concentration", 6).alias("concentration"))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two labels of the same documents agree beyond chance."""
    return evaluate.agreement(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", *[F.round(c, 6).alias(c) for c in ("observed", "chance", "kappa")])


def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rollup(_items(spark, sf_dir), "section", "lang")


def kept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are fresh, and that are still to be kept, by windows that some of them lack."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 20).cast("int")).alias("days"))
    now = F.lit("2024-01-20").cast("timestamp")
    return e.select("event_id", editorial.fresh(F.col("ts"), now, F.col("days")).alias("fresh"), editorial.retained(F.col("ts"), now, F.col("days")).alias("retained"))


def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as addresses, events as checks of them, some without an answer: those that failed twice."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), "ts", F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 2 * 204 + 200).alias("status"))
    return editorial.dead_links(e.withColumnRenamed("ts", "at"))


def item_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ["", "/video/1", "/x.mp3", "/p.pdf?x=1", "/feed/", "/a.xml"])), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", item_format(F.concat(F.regexp_replace("url", "[?#].*$", ""), tail)).alias("format"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of each section with its newest items, and of one that has none."""
    i = _items(spark, sf_dir).select("section", F.col("doc_id").alias("key"), F.concat(F.lit("Item <"), F.col("doc_id"), F.lit("> & more")).alias("title"), F.concat(F.lit("https://example.com/"), F.col("doc_id")).alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("published"))
    channels = spark.createDataFrame([(x, f"News: {x}", "https://example.com") for x in [*editorial.SECTION_ORDER, "none"]], "section string, title string, base string")
    return publish.rss(i, channels, "section", 5)


QUERIES = {f.__name__: f for f in (weighted_score, section_derive, topn_per_section, share_balance, source_precision, item_flags, duplicate_groups, canonical_url_dedupe, glossary_matches, missing_scores, doc_upsert, chunk_replace, left_anti_prune, site_diff, edit_capture, ingest_units, mindmap_units, origin_share, selected_counter, source_concentration, label_agreement, section_rollup, kept_items, dead_links, item_formats, feeds)}

_TAGS = str(editorial.TAG_ORDER)
_I = f"""i AS (SELECT *, CASE WHEN tag IN ('models', 'donanim') THEN 'Ne oldu?' WHEN tag IN ('uygulama', 'bilim') THEN 'Ne işe yarıyor?' ELSE 'Ne düşünmeli?' END AS section FROM (
  SELECT doc_id, source, n_chars, {_TAGS}[least(doc_id % 7, n_chars % 7) + 1] AS tag, round((45 * (doc_id % 101) + 30 * (n_chars % 101) + 25 * (doc_id * 7 % 101))::DOUBLE / 100, 6) AS score FROM documents))"""
_NORM = r"lower(regexp_replace(trim(coalesce(text, ''), ' '), '[ \t\n\v\f\r]+', ' ', 'g'))"
_CANON = r"""regexp_replace('https://' || regexp_replace(lower(regexp_extract(u, '^https?://([^/?]*)', 1)), '^(www|m)\.', '') || regexp_replace(u, '^https?://[^/?]*', ''), '/+$', '')"""
_URL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])((utm_[a-z]+|ref|fbclid|gclid)(=[^&]*)?(&|$))+', '\1', 'gi'), '([?&])((utm_[a-z]+|ref|fbclid|gclid)(=[^&]*)?(&|$))+', '\1', 'gi'), '[?&]+$', ''), '[?&]+$', '')"""
_G = ", ".join(f"('{a}', '{b}')" for a, b in GLOSSARY)
ORACLE_SQL = {
    "weighted_score": f"WITH {_I} SELECT doc_id, score, CASE WHEN score BETWEEN 80 AND 100 THEN 'high' WHEN score BETWEEN 40 AND 70 THEN 'middle' WHEN score BETWEEN 0 AND 30 THEN 'low' END AS band FROM i",
    "section_derive": f"WITH {_I} SELECT doc_id, tag, section, CASE section WHEN 'Ne oldu?' THEN 1 WHEN 'Ne işe yarıyor?' THEN 2 ELSE 3 END AS place FROM i",
    "topn_per_section": f"WITH {_I} SELECT doc_id, section, score, row_number() OVER (PARTITION BY section ORDER BY score DESC, doc_id) <= 6 AS suggested, false AS selected FROM i",
    "share_balance": f"WITH {_I} SELECT section, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM i GROUP BY section",
    "source_precision": "SELECT source, count(*) AS collected, CAST(sum((quality = 1)::INT) AS BIGINT) AS published, round(sum((quality = 1)::INT)::DOUBLE / count(*), 6) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 5",
    "item_flags": f"WITH k AS (SELECT doc_id, text, n_chars, count(*) OVER (PARTITION BY {_NORM}) AS copies FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN copies > 1 THEN 'possible_duplicate' END, CASE WHEN list_has_any(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}]+'), {editorial.HEALTH}) THEN 'health_claim' END, CASE WHEN least(n_chars % 1600, n_chars % 900) < 400 THEN 'small_image' END) AS flags FROM k",
    "duplicate_groups": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORM}) AS class_id, count(*) OVER (PARTITION BY {_NORM}) AS copies FROM documents",
    "canonical_url_dedupe": f"WITH a AS (SELECT page_id, url, 'a' AS source FROM pages UNION ALL SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x', 'b' FROM pages WHERE NOT contains(url, '#') UNION ALL SELECT page_id, url || '#top', 'c' FROM pages), b AS (SELECT page_id, source, {_URL} AS u FROM a) SELECT {_CANON} AS canonical, min(page_id) AS first_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS items FROM b GROUP BY 1",
    "glossary_matches": rf"WITH g(term, target) AS (VALUES {_G}), h AS (SELECT doc_id, term, target FROM documents, g WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_\p{{M}}])' || term || '($|[^\p{{L}}\p{{N}}_\p{{M}}])')) SELECT h.doc_id, h.term, h.target FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND len(o.term) > len(h.term) AND contains(o.term, h.term))",
    "missing_scores": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "doc_upsert": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
    "chunk_replace": "WITH f AS (SELECT event_id, user_id, 0.0::DOUBLE AS value FROM events WHERE user_id % 7 = 0 AND value > 50) SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE user_id NOT IN (SELECT user_id FROM f) UNION ALL SELECT * FROM f",
    "left_anti_prune": "SELECT doc_id, source FROM documents WHERE doc_id % 5 <> 0",
    "site_diff": "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'added' WHEN doc_id % 4 = 0 THEN 'removed' WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 6 <> 0",
    "edit_capture": "SELECT item_id, text AS draft, text || ' and more' AS final FROM benchmark WHERE item_id % 3 = 0",
    "ingest_units": "SELECT '/items/' || item_id || '.docx' AS path, 'section' AS unit_type, 'Bölüm: Item ' || item_id AS unit_id, 'Item ' || item_id AS heading, 'Item ' || item_id || coalesce((SELECT string_agg(chr(10) || trim(x.l), '' ORDER BY x.o) FROM (SELECT unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS o) x WHERE trim(x.l) <> ''), '') AS text FROM benchmark",
    "origin_share": f"WITH b AS (SELECT {_URL} AS u FROM pages) SELECT regexp_extract({_CANON}, '^https://([^/?]*)', 1) AS host, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY 1",
    "selected_counter": f"WITH {_I} SELECT section, CAST(sum((doc_id % 13 = 0)::INT) AS BIGINT) AS selected, 6 AS target, CAST(greatest(6 - sum((doc_id % 13 = 0)::INT), 0) AS BIGINT) AS open FROM i GROUP BY section",
    "source_concentration": f"WITH {_I}, c AS (SELECT section, source, count(*) AS n FROM i GROUP BY 1, 2) SELECT section, CAST(sum(n) AS BIGINT) AS items, count(*) AS members, round(max(n)::DOUBLE / sum(n), 6) AS largest, round(sum(n * n)::DOUBLE / (sum(n) * sum(n)), 6) AS concentration FROM c GROUP BY section",
    "label_agreement": "WITH l AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, avg((a = b)::INT) AS o FROM l), c AS (SELECT sum(x.n::DOUBLE * y.n) / (SELECT n * n FROM t) AS c FROM (SELECT a, count(*) AS n FROM l GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM l GROUP BY b) y ON x.a = y.b) SELECT n, round(o, 6) AS observed, round(c, 6) AS chance, round((o - c) / (1 - c), 6) AS kappa FROM t, c",
    "section_rollup": f"WITH {_I} SELECT i.section, d.lang, count(*) AS n, CAST(2 - (grouping(i.section) = 0)::INT - (grouping(d.lang) = 0)::INT AS INTEGER) AS level FROM i JOIN documents d USING (doc_id) GROUP BY ROLLUP (i.section, d.lang)",
    "kept_items": "WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 20 AS INTEGER) END AS days FROM events) SELECT event_id, days IS NULL OR ts >= TIMESTAMP '2024-01-20' - to_days(days) AS fresh, days IS NULL OR CAST(ts AS DATE) > DATE '2024-01-20' - days AS retained FROM e",
    "dead_links": "WITH c AS (SELECT user_id AS url, CASE WHEN event_id % 5 > 0 THEN event_id % 2 * 204 + 200 END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS place FROM events) SELECT url FROM c WHERE place <= 2 GROUP BY url HAVING count(*) = 2 AND bool_and(coalesce(status >= 400, true))",
    "item_formats": "SELECT page_id, ['article', 'video', 'audio', 'paper', 'feed', 'feed'][page_id % 6 + 1] AS format FROM pages",
    "feeds": f"""WITH {_I}, r AS (SELECT section, doc_id, DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS d, row_number() OVER (PARTITION BY section ORDER BY doc_id % 300 DESC, doc_id) AS place FROM i),
f AS (SELECT section, string_agg('<item><title>Item &lt;' || doc_id || '&gt; &amp; more</title><link>https://example.com/' || doc_id || '</link><guid>' || doc_id || '</guid><pubDate>' || strftime(d, '%a, %d %b %Y 00:00:00') || ' GMT</pubDate></item>', '' ORDER BY place) AS items FROM r WHERE place <= 5 GROUP BY section)
SELECT section, '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>News: ' || section || '</title><link>https://example.com</link>' || coalesce(items, '') || '</channel></rss>' AS feed FROM (SELECT unnest({[*editorial.SECTION_ORDER, 'none']}) AS section) LEFT JOIN f USING (section)""",
    "mindmap_units": r"""WITH w AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '')[1:3] AS w FROM benchmark),
j AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE item_id % 2 = 0)
SELECT '/maps/' || item_id || '.xmind' AS path, CAST(i - 1 AS INTEGER) AS pos, 'Harita: Sheet ' || item_id || ' / ' || w[i] AS unit_id, 'Map ' || item_id AS heading, 'Map ' || item_id || chr(10) || w[i] || chr(10) || '  ' || w[i] || '!' || chr(10) || '  [Not: n]' || chr(10) || '  [Etiket: l]' AS text FROM j
UNION ALL SELECT '/maps/' || item_id || '.xmind', 0, 'Harita: Map ' || item_id, 'Map ' || item_id, 'Map ' || item_id || array_to_string(list_transform(w, lambda x: chr(10) || '  ' || x), '') FROM w WHERE item_id % 2 = 1""",
}
