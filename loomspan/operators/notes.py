"""Meeting notes from a transcript, their prompt, and what they say that nobody said."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import facts
from loomspan.operators import transcript

EMPTY = "(transcript is empty)"
TRIES = 2
LONG_SENTENCE = 300
#: Headings of notes: decisions, things to do, open questions (fixed values).
HEADINGS = ["## Kararlar", "## Yapılacaklar", "## Açık Sorular"]
INSTRUCTIONS = "\n".join([
    "Below is the transcript of a meeting, made by a machine. Write its notes in Turkish.",
    "What a speaker takes back or puts right counts as put right. Say nothing that is not in the transcript, and name nobody it does not name.",
    "Days, times and numbers come from the line as it was spoken, never from the translation below it.",
    "Use these headings, and leave out one that has nothing below it:", *HEADINGS,
])


def good_translation(said: str, translation: str | None, target: str) -> str | None:
    """A translation that may stand beside its original: it keeps the facts, or does so once its
    weekday is put right."""
    if not translation:
        return None
    return translation if facts.same(said, translation) else facts.repair_day(said, translation, target)


def fill_gaps(entries: DataFrame, make: Callable[[], Callable[[str, str, str], str]], target: str = "tr") -> DataFrame:
    """Entries said in another language whose translation is missing or changes a fact are
    translated anew, at most ``TRIES`` times, under the same check; what fails stays as it is."""

    @F.pandas_udf("string")
    def again(said: pd.Series, lang: pd.Series) -> pd.Series:
        translate = make()

        def one(text: str, source: str) -> str | None:
            for _ in range(TRIES):
                try:
                    if got := facts.accept(text or "", translate(text or "", source, target), target):
                        return got
                except (OSError, RuntimeError, ValueError):
                    return None
            return None

        return pd.Series([one(*x) for x in zip(said, lang, strict=True)], dtype=object)

    missing = (F.col("said_lang") != target) & (F.col("other_lang").isNull() | (F.col("other_lang") == target)) & ~((F.coalesce("translation", F.lit("")) != "") & facts.keeps_facts("said", "translation"))
    gaps = entries.withColumn("__gap", F.coalesce(missing, F.lit(False)))
    new = gaps.where("__gap").withColumn("__new", again("said", "said_lang"))
    filled = new.withColumn("translation", F.coalesce("__new", "translation")).withColumn("other_lang", F.when(F.col("__new").isNotNull(), target).otherwise(F.col("other_lang")))
    return gaps.where("not __gap").drop("__gap").unionByName(filled.drop("__gap", "__new"))


def prompt(entries: DataFrame, session: str = "session", target: str = "tr") -> DataFrame:
    """(session, prompt): originals in order, with a translation below where it is a good one."""

    @F.pandas_udf("string")
    def good(said: pd.Series, translation: pd.Series) -> pd.Series:
        return pd.Series([good_translation(a or "", b, target) for a, b in zip(said, translation, strict=True)], dtype=object)

    shown = F.when((F.col("said_lang") != target) & (F.col("other_lang") == target), good("said", "translation"))
    return transcript.as_prompt(entries.withColumn("translation", shown), session, translations=True)


def translation_prompt(line: Column, language: str, source: Column | None = None, glossary: str = "", context: Column | None = None) -> Column:
    """What a translator is asked: glossary, earlier lines, the line; absent parts leave no gap."""
    named = F.concat(F.coalesce(source, F.lit("")), F.lit(" ")) if source is not None else F.lit("")
    parts = [F.lit(f"Meeting glossary:\n{glossary}") if glossary else None, F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Earlier in this meeting (context only, do not translate):\n"), context)) if context is not None else None]
    return F.concat_ws("\n\n", *[p for p in parts if p is not None], F.concat(F.lit("Translate this "), F.ltrim(named), F.lit(f"subtitle line to {language}:\n\n"), line))


def write(prompts: DataFrame, make: Callable[[], Callable[[str], str]], session: str = "session", instructions: str = INSTRUCTIONS) -> DataFrame:
    """(session, notes): one call of the writer per session, with the instructions before the
    transcript; an empty transcript needs none."""

    @F.pandas_udf("string")
    def ask(prompt: pd.Series) -> pd.Series:
        writer = make()
        return pd.Series([writer(f"{instructions}\n\n{p}").strip() if p else EMPTY for p in prompt], dtype=object)

    return prompts.select(session, ask("prompt").alias("notes"))


@functools.lru_cache(facts.REMEMBERED)
def _unsaid(text: str, known: facts.Facts) -> tuple[list[str], list[int]]:
    return facts.unsaid(text, [known])


def audit(notes: DataFrame, entries: DataFrame, session: str = "session") -> DataFrame:
    """(session, words, numbers): days, times and numbers of the notes that no original has. The
    originals' facts are gathered as small sets, never as texts."""
    said = entries.select(session, facts.facts("said").alias("f"))
    union = lambda name: F.array_distinct(F.flatten(F.collect_set(F.col(f"f.{name}")))).alias(name)
    known = said.groupBy(session).agg(*[union(n) for n in facts.Facts._fields])

    @F.pandas_udf("words array<string>, numbers array<int>")
    def unsaid(text: pd.Series, days: pd.Series, relative: pd.Series, parts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        sets = [[frozenset(x.tolist()) if x is not None else frozenset() for x in s] for s in (days, relative, parts, numbers)]
        return pd.DataFrame([_unsaid(t or "", facts.Facts(*f)) for t, *f in zip(text, *sets, strict=True)], columns=["words", "numbers"])

    return notes.join(known, session, "left").select(session, unsaid("notes", *facts.Facts._fields).alias("u")).select(session, "u.*")


def translation_flags(pairs: DataFrame, original: str, translated: str) -> DataFrame:
    """With ``changed`` where a fact is not kept, ``too_long`` where a sentence passes the limit."""
    from loomspan.functions.text import sentences

    long = F.exists(sentences(F.col(translated)), lambda s: F.length(s) > LONG_SENTENCE)
    return pairs.withColumn("changed", ~facts.keeps_facts(original, translated)).withColumn("too_long", long)
