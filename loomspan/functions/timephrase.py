"""Relative time in Turkish queries: one ladder of Column expressions, first match wins.

A rung is a phrase, the range of days it names and what is cut out of the query. Rungs test for
plain substrings where the phrase is not said to be a word, so ``bu ay`` also fires inside
``bu ayakkabı``, and what is cut may leave an ending behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import SPACE, strip

#: Month names with their plain spellings, in the order they are looked for (fixed values).
MONTHS = {
    "ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7,
    "ağustos": 8, "agustos": 8, "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12,
}


@dataclass(frozen=True)
class Rung:
    when: str  # a pattern on the lower-cased query
    cut: str  # a pattern to cut out, in any case
    start: Column
    end: Column
    tidy: bool = True  # whether white space left inside is made one space


def _days_before(today: Column, n: int) -> Column:
    return F.date_sub(today, n)


def ladder(low: Column, today: Column) -> list[Rung]:
    monday = F.trunc(today, "week")
    first = F.trunc(today, "month")
    year = F.year(today)
    whole_year = lambda y: (F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))
    rungs = []
    for unit, days in (("gün", 1), ("hafta", 7)):
        n = F.regexp_extract(low, rf"(?U)son\s+(\d+)\s+{unit}", 1)
        rungs.append(Rung(rf"(?U)son\s+\d+\s+{unit}", rf"son\s+\d+\s+{unit}\w*", F.date_sub(today, (F.expr("0") + F.when(n != "", n).otherwise("0").cast("int")) * days), today, False))
    rungs += [
        Rung("bugün", "bugün", today, today),
        Rung(r"(?U)dünkü|\bdün\b", "dünkü|dün", _days_before(today, 1), _days_before(today, 1)),
        Rung("evvelsi gün|önceki gün", "evvelsi gün|önceki gün", _days_before(today, 2), _days_before(today, 2)),
        Rung("bu hafta", "bu haftaki|bu hafta", monday, F.date_add(monday, 6)),
        Rung("ge[cç]en hafta", "geçen haftaki|geçen hafta|gecen haftaki|gecen hafta", F.date_sub(monday, 7), F.date_sub(monday, 1)),
        Rung("bu ay", "bu ayki|bu ay", first, F.last_day(today)),
        Rung("ge[cç]en ay", "geçen ayki|geçen ay|gecen ayki|gecen ay", F.trunc(F.date_sub(first, 1), "month"), F.date_sub(first, 1)),
        Rung("bu yıl|bu sene", "bu yıl|bu sene", *whole_year(year)),
        Rung("geçen yıl|geçen sene|gecen yıl", "geçen yıl|geçen sene|gecen yıl", *whole_year(year - 1)),
    ]
    for name, month in MONTHS.items():
        begin = F.make_date(F.when(F.month(today) >= month, year).otherwise(year - 1), F.lit(month), F.lit(1))
        rungs.append(Rung(rf"(?U)\b{name}\b", rf"\b{name}\b", begin, F.last_day(begin)))
    return rungs


def parse(query: Column, today: Column) -> Column:
    """(start, end, rest): the days that the query names, or nulls, and the query without the
    phrase. A null query has a null rest; with a null day nothing is dated."""
    low = F.lower(query)
    tidy = lambda c: strip(F.regexp_replace(c, f"{SPACE}+", " "))
    days = lambda a, b: F.struct(a.cast("date").alias("start"), b.cast("date").alias("end"))
    answer = None
    for rung in ladder(low, today):
        rest = strip(F.regexp_replace(query, f"(?iuU){rung.cut}", " "))
        value = F.struct(rung.start.cast("date").alias("start"), rung.end.cast("date").alias("end"), (tidy(rest) if rung.tidy else rest).alias("rest"))
        answer = F.when(low.rlike(rung.when), value) if answer is None else answer.when(low.rlike(rung.when), value)
    none = F.lit(None).cast("date")
    return answer.otherwise(F.struct(days(none, none)["start"].alias("start"), none.alias("end"), tidy(query).alias("rest")))


def in_range(start: Column, end: Column, modified: Column, created: Column) -> Column:
    """Whether a document falls into a range: always where there is none, else by its day of
    change or of birth, both ends included; without either day it does not."""
    within = lambda c: F.coalesce(c.cast("date").between(start, end), F.lit(False))
    return start.isNull() | within(modified) | within(created)


def search_text(query: Column, rest: Column) -> Column:
    """What to search for: the rest, or the whole query where nothing is left."""
    return F.coalesce(F.nullif(rest, F.lit("")), query)
