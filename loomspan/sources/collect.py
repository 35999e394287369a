"""Items gathered from many sources, each alone: a source that fails or hangs costs itself only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "source string, url string, title string, lang string, seen timestamp, error string"


def collect(sources: DataFrame, fetch: Callable[[str], list[dict]], seconds: float = 30.0) -> DataFrame:
    """Of (source): rows of ITEM; ``fetch`` gives dicts of url, title, lang. A source that raises
    or takes longer is one row with an error. A thread can't be ended from outside, so what has timed
    out goes on beside the next source until its own connection gives up: ``fetch`` is to set one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp.now("UTC").tz_localize(None)
        for batch in batches:
            for source in batch["source"]:
                pool = ThreadPoolExecutor(1)
                try:
                    rows = [(source, i.get("url"), i.get("title"), i.get("lang"), now, None) for i in pool.submit(fetch, source).result(seconds)]
                except TimeoutError:
                    rows = [(source, None, None, None, now, "timed out")]
                except Exception as e:  # reported as the source's own error
                    rows = [(source, None, None, None, now, f"{type(e).__name__}: {e}")]
                pool.shutdown(wait=False, cancel_futures=True)
                yield pd.DataFrame(rows, columns=["source", "url", "title", "lang", "seen", "error"])

    return sources.select("source").mapInPandas(run, ITEM)


def pool(items: DataFrame) -> DataFrame:
    """The first sighting of each item of each source."""
    return items.where(F.col("error").isNull()).groupBy("source", "url").agg(F.min("seen").alias("first_seen"), F.min_by("title", "seen").alias("title"), F.min_by("lang", "seen").alias("lang"))
