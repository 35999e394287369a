"""What a reader gets: feeds as text. Nothing here sends anything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
NEWEST = 20


def xml_text(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), F.coalesce(text, F.lit("")))


def _element(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), xml_text(text), F.lit(f"</{name}>"))


def rss(items: DataFrame, channels: DataFrame, channel: str, newest: int = NEWEST) -> DataFrame:
    """Of items (channel, key, title, url, published) and channels (channel, title, base): per
    channel its feed as one text, the ``newest`` items first; a channel without items is empty."""
    place = F.row_number().over(Window.partitionBy(channel).orderBy(F.desc("published"), "key"))
    day = F.date_format(F.col("published").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item>"), _element("title", F.col("title")), _element("link", F.col("url")), _element("guid", F.col("key").cast("string")), _element("pubDate", F.concat(day, F.lit(" GMT"))), F.lit("</item>"))
    held = items.withColumn("place", place).where(F.col("place") <= newest).groupBy(channel).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("x")))), lambda s: s["x"]), "").alias("items"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), _element("title", F.col("title")), _element("link", F.col("base")))
    return channels.join(held, channel, "left").select(channel, F.concat(head, F.coalesce("items", F.lit("")), F.lit("</channel></rss>")).alias("feed"))
