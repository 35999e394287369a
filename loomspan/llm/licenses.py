"""License scans: exact base phrases and fuzzy search for short notices.

Base phrases stand as consecutive words. A notice of n characters may differ from the text by
``errors(n)`` edits: cut into that many pieces and one more, at least one piece stands intact
(pigeonhole), so an Aho-Corasick scan for the pieces finds every candidate place. The regex
library's bounded-error matching then verifies the notice in a window around the place and
gives its span and number of edits.

Rows: null texts count as empty and have no words, labels or places and score 0. Spans are in
code points of the source, end exclusive. Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label, weight in the score, words of the notice.
NOTICES = [
    ("apache-2.0", 1.0, "licensed under the apache license version 2 0"),
    ("mit", 1.0, "released under the mit license"),
    ("mit", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", 1.0, "redistribution and use in source and binary forms with or without modification"),
    ("isc", 1.0, "permission to use copy modify and or distribute this software for any purpose"),
    ("gpl", 0.9, "gnu general public license"),
    ("gpl", 0.9, "general public license"),
    ("lgpl", 1.0, "gnu lesser general public license"),
    ("mpl-2.0", 1.0, "mozilla public license version 2 0"),
    ("cc-by", 0.9, "creative commons attribution 4 0 international license"),
    ("cc-by-sa", 0.9, "creative commons attribution sharealike"),
    ("public-domain", 0.9, "released into the public domain"),
    ("reserved", 0.6, "all rights reserved"),
]
BASE_WEIGHT = {"cc-by": 0.7, "gpl": 0.9, "reserved": 0.6}
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of a text in any case


def errors(n: int) -> int:
    """Edits that a notice of n characters may have."""
    return min(6, max(1, n // 10))


def pieces(phrase: str, k: int) -> list[tuple[int, str]]:
    """The phrase in k + 1 parts: (offset, part)."""
    cut = [round(i * len(phrase) / (k + 1)) for i in range(k + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE):
        import ahocorasick
        import regex

        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.notices = [(label, weight, phrase, errors(len(phrase))) for label, weight, phrase in notices]
        self.match = [[regex.compile(f"(?:{regex.escape(p)}){{e<={e}}}") for e in range(k + 1)] for _, _, p, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for i, (_, _, phrase, k) in enumerate(self.notices):
            for offset, part in pieces(phrase, k):
                found.setdefault(part, []).append((i, offset))
        for part, where in found.items():
            self.seeds.add_word(part, (len(part), where))
        self.seeds.make_automaton()

    def base_places(self, norm: bytes) -> tuple[list[int], set[str]]:
        starts, labels = [], set()
        for phrase, label in self.base:
            at, word, known = norm.find(phrase), 0, 0
            while at >= 0:
                word, known = word + norm.count(b" ", known, at), at  # only what lies since the last place
                starts.append(word)
                labels.add(label)
                at = norm.find(phrase, at + 1)
        return starts, labels

    def fuzzy(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in ``norm``, words joined by one space; of a notice's
        overlapping candidates the one with fewest edits, then the first."""
        places: dict[int, list[tuple[int, int]]] = {}
        for end, (n, where) in self.seeds.iter(norm):
            for i, offset in where:
                _, _, phrase, k = self.notices[i]
                at = end + 1 - n - offset
                places.setdefault(i, []).append((max(0, at - k), min(len(norm), at + len(phrase) + k)))
        out = []
        for i, own in places.items():
            _, _, phrase, k = self.notices[i]
            free: list[tuple[int, int]] = []
            for lo, hi in sorted(own):
                if free and lo <= free[-1][1]:
                    free[-1] = (free[-1][0], max(hi, free[-1][1]))
                else:
                    free.append((lo, hi))
            # what has fewer edits is taken first, so a match of a round has all that it allows
            for e in range(k + 1):
                rest = []
                for lo, hi in free:
                    while hi - lo >= len(phrase) - e and (m := self.match[i][e].search(norm, lo, hi)):
                        out.append((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                        rest.append((lo, m.start()))
                        lo = m.end()
                    rest.append((lo, hi))
                free = [(lo, hi) for lo, hi in rest if hi - lo >= len(phrase) - k]
        return sorted(out)

    def scan(self, data: bytes | None) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score, notices)."""
        w = data.translate(_WORD).split() if data else []
        norm = b" " + b" ".join(w) + b" "
        starts, base = self.base_places(norm)
        text = norm.decode()
        found = self.fuzzy(text)
        labels, score, spans = set(base), max([0.0, *(BASE_WEIGHT[x] for x in base)]), []
        if found:
            source = [m.span() for m in WORDS.finditer(data.decode())]
            at, k = [], 1
            for a, b in source:
                at.append(k)
                k += b - a + 1
            for a, b, i, edits in found:
                label, weight, _, most = self.notices[i]
                labels.add(label)
                score = max(score, weight * (1 - 0.5 * edits / (most + 1)))
                first, last = max(0, bisect_right(at, a) - 1), max(0, bisect_right(at, b - 1) - 1)
                start = min(max(source[first][0] + a - at[first], source[first][0]), source[first][1])
                spans.append(f"{label}:{start}:{min(source[last][0] + b - at[last], source[last][1])}:{edits}")
        return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 6), ",".join(spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=None, base=None) -> DataFrame:
    """Per document row: id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and notices (label:start:end:edits, by place)."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("notices", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices or NOTICES, base or BASE)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [scanner.scan(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]], names=[id_col, *[f for f, _ in fields]])

    return docs.select(docs[id_col], docs[text_col].cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices string")


def _sql_places(phrase: str) -> str:
    parts = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(parts))
    return f"list_filter(range(1, greatest(len(w) - {len(parts) - 2}, 1)), lambda i: {same})"


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_LABELS = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in sorted(enumerate(BASE.values()), key=lambda x: x[1]))
#: DuckDB SQL for the base columns.
BASE_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents
), f AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{_sql_places(p)} AS p{k}" for k, p in enumerate(BASE))} FROM d
), g AS (SELECT *, list_sort({" || ".join(f"p{k}" for k in range(len(BASE)))}) AS a FROM f)
SELECT doc_id, n_words, len(a) AS n_base, a[1] - 1 AS first_word, a[-1] - 1 AS last_word, concat_ws(',', {_SQL_LABELS}) AS base_labels FROM g
"""
