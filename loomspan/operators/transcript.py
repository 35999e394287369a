"""Transcripts: one record per finished utterance, written as lines and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import clock, clock_seconds

UNKNOWN = "??"
#: A continuation stands below its entry, behind the clock (fixed value).
INDENT = " " * 11
ENTRY, MORE = r"(?U)^\[(\d+):(\d\d):(\d\d)\]\s+\((\w+)\)\s+(.*)$", r"(?U)^\s+\((\w+)\)\s+(.*)$"


def entry(at: Column, lang: Column, said: Column) -> Column:
    return F.concat(F.lit("["), clock(at), F.lit("] ("), F.coalesce(F.nullif(lang, F.lit("")), F.lit(UNKNOWN)), F.lit(") "), said)


def render(rows: DataFrame) -> DataFrame:
    """Of (at, said_lang, said, other_lang, translation) and more: with ``record``, the text of an
    entry and its continuation, each line ended."""
    more = F.concat(F.lit(f"{INDENT}("), F.coalesce(F.nullif(F.col("other_lang"), F.lit("")), F.lit(UNKNOWN)), F.lit(") "), F.col("translation"), F.lit("\n"))
    return rows.withColumn("record", F.concat(entry(F.col("at"), F.col("said_lang"), F.col("said")), F.lit("\n"), F.when(F.coalesce("translation", F.lit("")) != "", more).otherwise(F.lit("")), F.lit("\n")))


def header(started: str, languages: list[str] | None = None, source: str | None = None) -> str:
    named = {"started": started, "languages": ", ".join(languages or []), "source": source}
    return "".join(f"# {k}: {v}\n" for k, v in named.items() if v) + "\n"


def parse(lines: DataFrame, session: str = "session", number: str = "line_no", text: str = "line") -> DataFrame:
    """Of numbered lines: (session, at, said_lang, said, other_lang, translation) per entry. A
    continuation belongs to the entry above it, the last of several counts; comments and other
    lines are skipped. A language must be a word, so entries of an unknown one are not read."""
    line = F.col(text)
    plain = lines.where(~F.startswith(line, F.lit("#"))).withColumn("is_entry", line.rlike(ENTRY))
    plain = plain.withColumn("entry_no", F.max(F.when(F.col("is_entry"), F.col(number))).over(Window.partitionBy(session).orderBy(number)))
    own = plain.where(F.col("entry_no").isNotNull() & (F.col("is_entry") | line.rlike(MORE)))
    part = lambda pattern, i: F.regexp_extract(line, pattern, i)
    last = lambda c: F.max_by(c, F.when(~F.col("is_entry"), F.col(number)))
    head = lambda c: F.max(F.when(F.col("is_entry"), c))
    return own.groupBy(session, "entry_no").agg(
        head(clock_seconds(line)).alias("at"), head(part(ENTRY, 4)).alias("said_lang"), head(part(ENTRY, 5)).alias("said"),
        last(part(MORE, 1)).alias("other_lang"), last(part(MORE, 2)).alias("translation"),
    ).drop("entry_no")


def read_header(lines: DataFrame, session: str = "session", text: str = "line") -> DataFrame:
    """(session, header map) of started, languages and source."""
    pair = lambda i: F.trim(F.regexp_extract(text, r"^#([^:]*):(.*)$", i))
    named = lines.where(F.col(text).rlike(r"^#[^:]*:")).select(session, pair(1).alias("k"), pair(2).alias("v")).where(F.col("k").isin("started", "languages", "source")).dropDuplicates([session, "k"])
    return named.groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("header"))


def as_prompt(entries: DataFrame, session: str = "session", translations: bool = False) -> DataFrame:
    """(session, prompt): a session's entries in order, one a line, as a model is to see them."""
    said = entry(F.col("at"), F.col("said_lang"), F.col("said"))
    if translations:
        said = F.when(F.coalesce("translation", F.lit("")) != "", F.concat(said, F.lit(f"\n{INDENT}("), F.col("other_lang"), F.lit(") "), F.col("translation"))).otherwise(said)
    return entries.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("at", said.alias("line")))).alias("l")).select(session, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"))


def context(rows: DataFrame, session: str, order: str, n: int = 2) -> DataFrame:
    """With ``context``: the last ``n`` finished lines before each row, the oldest first."""
    line = F.concat(F.lit("("), F.col("lang"), F.lit(") "), F.col("said"))
    before = Window.partitionBy(session).orderBy(order).rowsBetween(-n, -1)
    return rows.withColumn("context", F.array_join(F.collect_list(line).over(before), "\n"))


def language_switches(rows: DataFrame, session: str, order: str, lang: str = "lang") -> DataFrame:
    """With ``switched``: whether a row's language differs from the one before."""
    before = F.lag(lang).over(Window.partitionBy(session).orderBy(order))
    return rows.withColumn("switched", before.isNotNull() & (before != F.col(lang)))


def lock_language(rows: DataFrame, session: str, order: str, lang: str = "lang") -> DataFrame:
    """With every row in the language that its session was first heard in; a session in which none
    was heard stays without."""
    first = rows.where(F.col(lang).isNotNull()).groupBy(session).agg(F.min_by(lang, order).alias("__first"))
    return rows.join(first, session, "left").withColumn(lang, F.col("__first")).drop("__first")


def heard_again(rows: DataFrame, session: str, order: str, again: Column, said: str = "said", lang: str = "lang") -> DataFrame:
    """Rows behind a switch of language are heard again without the prompt, which was in the other
    language: ``said`` is what the second hearing, a column of (text, lang), gives."""
    rows = language_switches(rows, session, order, lang)
    return rows.withColumn("__again", F.when(F.col("switched"), again)).withColumn(said, F.coalesce("__again.text", said)).withColumn(lang, F.coalesce("__again.lang", lang)).drop("__again")


def caption_line(said: Column, translation: Column, style: str = "both") -> Column:
    """What a titler shows of the current caption."""
    shown = F.coalesce(translation, F.lit(""))
    return {
        "translation": F.when(shown == "", said).otherwise(shown), "original": said,
        "one-line": F.concat_ws(" — ", said, F.nullif(shown, F.lit(""))), "both": F.concat_ws("\n", said, F.nullif(shown, F.lit(""))),
    }[style]
