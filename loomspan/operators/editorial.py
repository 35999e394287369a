"""Scores, sections, flags and duplicates of an editorial pipeline; nothing here publishes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import canonical_url

#: Tags by the section they belong to (fixed values).
SECTIONS = {"models": "Ne oldu?", "donanim": "Ne oldu?", "uygulama": "Ne işe yarıyor?", "bilim": "Ne işe yarıyor?", "kuram": "Ne düşünmeli?", "politika": "Ne düşünmeli?", "olaylar": "Ne düşünmeli?"}
SECTION_ORDER = ["Ne oldu?", "Ne işe yarıyor?", "Ne düşünmeli?"]
#: Of several tags the first of these counts (fixed values).
TAG_ORDER = ["olaylar", "politika", "donanim", "bilim", "models", "uygulama", "kuram"]
#: Newsworthiness from, to (fixed values); scores between the bands have none.
BANDS = {"high": (80, 100), "middle": (40, 70), "low": (0, 30)}


def weighted(weights: dict[str, int]) -> Column:
    """Sum of sub-scores by integer weights that make 100; a null sub-score counts 0."""
    if sum(weights.values()) != 100:
        raise ValueError("weights must sum to 100")
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w
    return out / 100


def band(score: Column) -> Column:
    out = None
    for name, (lo, hi) in BANDS.items():
        out = F.when(score.between(lo, hi), name) if out is None else out.when(score.between(lo, hi), name)
    return out


def leading_tag(tags: Column) -> Column:
    """The tag that decides, or null."""
    held = F.filter(F.array(*map(F.lit, TAG_ORDER)), lambda t: F.array_contains(tags, t))
    return F.when(F.size(held) > 0, F.element_at(held, 1))


def section(tag: Column) -> Column:
    of = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return F.try_element_at(of, tag)


def section_place(name: Column) -> Column:
    """Sections have a fixed order; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), name)
    return F.when(at > 0, at).otherwise(len(SECTION_ORDER) + 1)


def suggest(items: DataFrame, group: str, score: str, tie: str, target: int) -> DataFrame:
    """All items, with ``suggested`` for the best ``target`` of each group; ``selected`` is a
    person's to set and stays false. Only the ``target`` best rows of a group meet in a task; the
    last of them is the group's threshold, a row per group, which every item is held against.
    Rows that tie with it in score and ``tie`` are suggested together; a null score never is."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    best = items.where(F.col(score).isNotNull()).select(group, score, tie).withColumn("place", place).where(F.col("place") <= target)
    last = best.groupBy(F.col(group).alias("__group")).agg(F.max_by(F.struct(F.col(score).alias("score"), F.col(tie).alias("tie")), "place").alias("__last"))
    out = items.join(last, items[group].eqNullSafe(last["__group"]), "left")
    above = (F.col(score) > F.col("__last.score")) | (F.col(score) == F.col("__last.score")) & (F.col(tie) <= F.col("__last.tie"))
    return out.withColumn("suggested", F.coalesce(above, F.lit(False))).withColumn("selected", F.lit(False)).drop("__group", "__last")


def selected_counter(items: DataFrame, group: str, target: int) -> DataFrame:
    """(group, selected, target, open): how many a person has chosen of those wanted."""
    n = F.coalesce(F.sum(F.col("selected").cast("bigint")), F.lit(0))
    return items.groupBy(group).agg(n.alias("selected")).select(group, "selected", F.lit(target).alias("target"), F.greatest(F.lit(target) - F.col("selected"), F.lit(0)).alias("open"))


def dedupe_urls(items: DataFrame, url: str, key: str, source: str) -> DataFrame:
    """One row per canonical address: first key, all sources, number of items."""
    return items.groupBy(canonical_url(F.col(url)).alias("canonical")).agg(F.min(key).alias("first_id"), F.sort_array(F.collect_set(source)).alias("sources"), F.count(F.lit(1)).alias("items"))


def copies(items: DataFrame, key: str, text: str) -> DataFrame:
    """Per item: its class of equal texts (white space and case apart) and the class's size."""
    digest = F.sha2(F.lower(F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")), 256)
    rows = items.select(key, digest.alias("digest"))
    classes = rows.groupBy("digest").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(classes, "digest").select(key, "class_id", "copies")


def _in_word(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc")


def _unspaced(c: str) -> bool:
    """Whether a letter is of a script that writes words without blanks."""
    return 0x3040 <= ord(c) <= 0x30FF or 0x3400 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7A3 or 0x0E00 <= ord(c) <= 0x0E7F or 0x20000 <= ord(c) <= 0x3134F


def _phrase_finder(terms: list[str]):
    """A function from a text to the sorted places in ``terms`` of those that stand in it: one
    automaton passes the text once, whatever the number of terms."""
    import ahocorasick

    automaton, known = ahocorasick.Automaton(), {}
    for i, term in enumerate(terms):
        if term:
            known.setdefault(term.lower(), []).append(i)
    for low in known:
        automaton.add_word(low, low)
    if known:
        automaton.make_automaton()

    def find(text: str | None) -> list[int]:
        low = (text or "").lower()
        found = set()
        for end, term in automaton.iter(low) if known and low else ():
            a, b = end - len(term) + 1, end + 1
            # a phrase ends where no word goes on, but in scripts without blanks anywhere
            if (a == 0 or not _in_word(low[a - 1]) or _unspaced(low[a])) and (b == len(low) or not _in_word(low[b]) or _unspaced(low[b - 1])):
                found.add(term)
        return sorted(i for term in found for i in known[term])

    return find


def _finder(glossary: list[tuple[str, str]]):
    @F.pandas_udf("array<struct<term:string,target:string>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _phrase_finder([term for term, _ in glossary])
        for texts in batches:
            yield pd.Series([[{"term": glossary[i][0], "target": glossary[i][1]} for i in find(t)] for t in texts], dtype=object)

    return hits


def glossary_hits(items: DataFrame, glossary: DataFrame, key: str, text: str, block: int = 10_000) -> DataFrame:
    """(key, term, target) of whole phrases, in any case; a phrase inside a longer hit of the
    same item does not count. Terms go to the tasks in blocks of a fixed size, each of which all
    items pass once; a larger glossary only takes more blocks."""
    n = max(1, -(-glossary.count() // block))
    parts = []
    for k in range(n):
        own = [(r.term, r.target) for r in glossary.select("term", "target").where((F.pmod(F.xxhash64("term"), F.lit(n)) == k) & F.col("term").isNotNull()).collect()]

        parts.append(_finder(own)(F.col(text)))
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    found = items.select(key, every.alias("hits")).where(F.size("hits") > 0)
    longest = F.filter("hits", lambda h: ~F.exists("hits", lambda o: (F.length(o["term"]) > F.length(h["term"])) & F.contains(F.lower(o["term"]), F.lower(h["term"]))))
    return found.select(key, F.explode(longest).alias("h")).select(key, "h.term", "h.target")


#: Words of a claim about health (ours).
HEALTH = ["cure", "cures", "cured", "heal", "heals", "healed", "treats", "remedy", "heilt", "heilung", "kuriert", "guérit", "guérison", "cura", "remedio", "tedavi", "iyileştirir", "şifa"]
#: Pixels that an image has at least on its shorter side.
LEAST_SIDE = 400


def health_claim(text: Column) -> Column:
    """Whether a text holds a word of a health claim: a person is to look at it."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*map(F.lit, HEALTH)))


def small_image(width: Column, height: Column, least: int = LEAST_SIDE) -> Column:
    """Whether an image is too small to print; one of unknown size is not flagged."""
    return F.coalesce(F.least(width, height) < least, F.lit(False))


def flags(**conditions: Column) -> Column:
    """Names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def fresh(ts: Column, now: Column, days: Column) -> Column:
    """Whether an item is within its window; no window: always."""
    return days.isNull() | (ts.cast("timestamp") >= now.cast("timestamp") - F.make_dt_interval(days))


def retained(ts: Column, now: Column, days: Column) -> Column:
    """Whether an item is still to be kept; no limit: always."""
    return days.isNull() | (ts.cast("date") > F.date_sub(now.cast("date"), days))


def dead_links(checks: DataFrame, url: str = "url", status: str = "status", tries: int = 2) -> DataFrame:
    """Addresses whose last ``tries`` checks, by ``at``, all failed: no answer, or a status from 400."""
    failed = F.coalesce(F.col(status) >= 400, F.lit(True))
    place = F.row_number().over(Window.partitionBy(url).orderBy(F.desc("at")))
    last = checks.select(url, "at", failed.alias("failed")).withColumn("place", place).where(F.col("place") <= tries)
    return last.groupBy(url).agg(F.min(F.col("failed").cast("int")).alias("all_failed"), F.count(F.lit(1)).alias("n")).where((F.col("all_failed") == 1) & (F.col("n") == tries)).select(url)


def missing(ids: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Ids for which an answer should be there and is not."""
    return ids.select(key).distinct().join(answers.select(key), key, "left_anti")


def same_keys(a: Column, b: Column) -> Column:
    """Whether two maps have the same keys."""
    return F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))


def exclude(items: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Items that are not on a list: of sources, addresses or links that are dead."""
    return items.join(listed.select(key).distinct(), key, "left_anti")


def audiences(topics: DataFrame) -> DataFrame:
    """A row per topic and audience, of the enabled topics."""
    return topics.where("enabled").select("name", "pillar", F.explode("audiences").alias("audience"))
