"""Text functions, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as Unicode sees them; Java and RE2 read the classes alike.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: Abbreviations whose period ends no sentence (fixed values).
ABBREVIATIONS = ["dr", "mr", "mrs", "ms", "st", "prof", "vs", "etc", "no", "jr", "sr"]
#: Labels that a model puts before its answer (fixed values).
LEADS = ["Turkish:", "Turkce:", "Türkçe:", "English:", "Translation:", "Çeviri:"]
#: Signs that do not count when the words at a cut are compared (fixed values).
EDGE = ".,!?;:\"'()[]…"
REPEAT_WORDS = 8
PROMPT_CHARS = 200


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Runs of anything but white space; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def html_strip(html: Column) -> Column:
    """Tags become a space each; a null is empty."""
    return strip(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))


def sentences(text: Column) -> Column:
    """Pieces between sentence ends (. ! ? :) followed by white space, and line ends."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?:]){SPACE}+|\n+"), strip), lambda s: s != "")


def spoken_sentences(text: Column) -> Column:
    """Pieces between . ! ? … and white space, but not behind an abbreviation."""
    short = rf"(?:^|{SPACE})(?i:{'|'.join(ABBREVIATIONS)})[.!?…]{{1,4}}"
    whole = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"(?<={short}){SPACE}+", " ")
    return F.filter(F.split(whole, rf"(?<=[.!?…])(?<!{short}){SPACE}+"), lambda s: s != "")


def exact_terms(query: Column) -> Column:
    """Quoted phrases, then tokens with a digit and three signs or more; a quoted code counts twice."""
    q = F.coalesce(query, F.lit(""))
    codes = F.filter(F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_./-]+"), F.lit(0)), lambda t: t.rlike(r"\p{Nd}") & (F.length(t) >= 3))
    return F.concat(F.regexp_extract_all(q, F.lit(r'"([^"]+)"'), F.lit(1)), codes)


def _plain_letters() -> tuple[str, str]:
    """Letters with marks of the Latin blocks and what remains of them without."""
    pairs = [(c, d[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def _bare(text: Column) -> Column:
    marked, plain = _plain_letters()
    return F.lower(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{M}", ""), marked, plain))


def index_tokens(text: Column) -> Column:
    """Index terms: lower-cased runs of letters and digits, without diacritics."""
    return F.regexp_extract_all(_bare(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index_line(text: Column) -> Column:
    """The index terms in one line, a blank between two of them, and perhaps one at the ends."""
    return F.regexp_replace(_bare(text), r"[^\p{L}\p{N}]+", " ")


def _edge_key(word: Column) -> Column:
    return F.lower(F.trim(word, F.lit(EDGE)))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def drop_repeat(previous: Column, said: Column, most: int = REPEAT_WORDS) -> Column:
    """``said`` without its first words where they repeat the last words of ``previous``: the
    longest such run of at most ``most``; case and edge signs do not count. Only the words at the
    cut are compared, and each text is split once."""
    keys = lambda words: F.transform(words, _edge_key)

    def cut(x: Column) -> Column:
        tail = keys(F.slice(x["before"], F.greatest(F.size(x["before"]) - most + 1, F.lit(1)), F.lit(most)))
        return F.struct(tail.alias("tail"), keys(F.slice(x["now"], 1, most)).alias("head"), x["now"].alias("now"))

    def rest(x: Column) -> Column:
        same = lambda k: (k <= F.size(x["tail"])) & (k <= F.size(x["head"])) & (F.slice(x["tail"], F.size(x["tail"]) - k + 1, k) == F.slice(x["head"], F.lit(1), k))
        n = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: (k == 0) | same(k)))
        return let(n, lambda n: F.when(n > 0, F.array_join(F.slice(x["now"], n + 1, F.greatest(F.size(x["now"]) - n, F.lit(0))), " ")))

    both = F.struct(words(previous).alias("before"), words(said).alias("now"))
    return F.when(previous != "", F.coalesce(let(let(both, cut), rest), said)).otherwise(said)


def trim_continuation(text: Column) -> Column:
    """Without the marks of a continued line."""
    return strip(F.ltrim(strip(text), F.lit("…. ")))


def prompt_tail(text: Column, chars: int = PROMPT_CHARS) -> Column:
    return F.right(text, F.lit(chars))


def clean_answer(answer: Column) -> Column:
    """A model's answer without a leading label and one pair of equal quotes around it."""
    out = strip(F.coalesce(answer, F.lit("")))
    for lead in LEADS:
        out = strip(F.regexp_replace(out, rf"(?iu)^\Q{lead}\E", ""))
    first = F.substring(out, 1, 1)
    quoted = (F.length(out) > 1) & (first == F.right(out, F.lit(1))) & first.isin("\"", "'", "“", "”")
    return F.when(quoted, strip(F.substring(out, F.lit(2), F.length(out) - 2))).otherwise(out)


def strip_dashes(text: Column) -> Column:
    """Without the dash that marks a change of speaker."""
    return strip(F.ltrim(text, F.lit("-–— ")))


def other_language(detected: Column, first: str, second: str) -> Column:
    """The language to translate into: the other of the pair, the first for a stray one."""
    return F.when(detected == first, second).otherwise(F.lit(first))


def clock(seconds: Column) -> Column:
    """HH:MM:SS; hours may pass 99."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("bigint"), (s % 3600 / 60).cast("bigint"), s % 60)


def clock_seconds(line: Column) -> Column:
    part = lambda i: F.regexp_extract(line, r"\[(\d+):(\d\d):(\d\d)\]", i).cast("bigint")
    return F.when(line.rlike(r"\[\d+:\d\d:\d\d\]"), part(1) * 3600 + part(2) * 60 + part(3))


#: Query parameters that only track where a click came from (ours).
TRACKING = r"(?i)(?:utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or m., no fragment, no tracking parameters, no trailing slash."""
    u = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), "#.*$", "")
    u = F.regexp_replace(u, rf"(?<=[?&]){TRACKING}(?:=[^&]*)?(?:&|$)", "")
    u = F.regexp_replace(u, "[?&]+$", "")
    host = F.regexp_extract(u, r"^(?i:https?)://([^/?]*)", 1)
    rest = F.regexp_replace(u, r"^(?i:https?)://[^/?]*", "")
    plain = F.regexp_replace(F.lower(host), r"^(?:www|m)\.", "")
    return F.regexp_replace(F.when(host == "", u).otherwise(F.concat(F.lit("https://"), plain, rest)), "/+$", "")


def headline(title: Column, source: Column) -> Column:
    """A headline without the source's name before or behind it."""
    quoted = F.concat(F.lit("\\Q"), F.replace(source, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    cut = F.regexp_replace(title, F.concat(F.lit("(?iu)^"), quoted, F.lit(r"\s*[:|–—-]\s*")), F.lit(""))
    return strip(F.when(F.coalesce(source, F.lit("")) == "", title).otherwise(F.regexp_replace(cut, F.concat(F.lit(r"(?iu)\s*[|–—-]\s*"), quoted, F.lit("$")), F.lit(""))))


def domain(url: Column) -> Column:
    """Where an item comes from, by its address alone."""
    return F.regexp_extract(canonical_url(url), r"^https://([^/?]*)", 1)


#: What the address of an item says about its form (ours); an article otherwise.
FORMATS = {"video": r"(?i)(?:youtube\.com/watch|youtu\.be/|vimeo\.com/|/videos?/)", "audio": r"(?i)(?:/podcasts?/|\.mp3(?:$|\?))", "paper": r"(?i)(?:arxiv\.org/|\.pdf(?:$|\?))", "code": r"(?i)(?:github\.com/|gitlab\.com/)", "feed": r"(?i)(?:/feeds?(?:/|$)|/rss|\.xml(?:$|\?))"}


def item_format(url: Column) -> Column:
    """The form of an item by its address alone, never by a model."""
    out = None
    for name, pattern in FORMATS.items():
        out = F.when(url.rlike(pattern), name) if out is None else out.when(url.rlike(pattern), name)
    return out.otherwise("article")


def parse_window(text: Column) -> Column:
    """Days of a window like ``30d``; anything else is null."""
    return F.when(text.rlike(r"^\d{1,6}d$"), F.regexp_extract(text, r"^(\d+)d$", 1).cast("int"))
