"""Personal data, with offset-preserving deobfuscation.

Base spans come from the plain patterns on the source text. For texts that carry a disguise,
a chain of transducers rewrites the text while keeping, for every output character, the span
of source characters it stands for: homoglyphs become ASCII and invisible characters vanish,
spelled digits become digits, and at/dot disguises become ``@`` and ``.``. Identifiers are
detected in the rewritten text and their spans mapped back. A mapped span is added unless it
lies within a base span of its kind; base spans always stay.

Disguises are rewritten only where they can be meant: at least four spelled or mixed digits in
a row, and an at-word only where a dot-word and a top-level domain follow it. Bounds of what is
looked for: a disguised address has labels of at most 64 characters, at most 17 before the at and
16 behind it, before a top-level domain of 2 to 12 letters; letters that pass for digits are read
in runs of at most 41 digits or such letters, more than twice what any identifier holds. Every
transducer reads a text in time linear in its length.

Rows: null texts count as empty and have no spans. Spans are in code points of the source, end
exclusive. Ids may be null or repeat. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: As [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), but linear in runs of digits: a match never starts within one.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", s)) <= 15


def _emails(text: str) -> Iterator[re.Match]:
    """Matches of EMAIL, in time linear in the text: runs without an @ behind them are skipped."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            pos = m.end()
        at = text.find("@", max(at + 1, pos))


def detect(text: str) -> dict[str, list[Span]]:
    """Base spans of each kind, leftmost and not overlapping within a kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = [m.span() for m in _emails(text)]
    out["ip"] = [m.span() for m in IP.finditer(text) if _ip_ok(m[0])] if "." in text else []
    out["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 12 and _card_ok(m[0])]
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if _phone_ok(m[0])]
    return out


# --- transducers ---------------------------------------------------------------------------

_LOOKS = {
    "a": "аɑα\U0001d41a", "b": "Ь", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еҽ℮", "g": "ɡ", "h": "һ", "i": "іɩıⅰ", "j": "јϳ", "k": "κк", "l": "ⅼӏ", "m": "ⅿ", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵⅴ", "w": "ԝω", "x": "хχⅹ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    ".": "․。｡﹒", "@": "﹫", "-": "‐‑‒–−﹣", "+": "﹢", " ": "      　", "(": "❨", ")": "❩",
}
#: One source character to its plain form; the empty string for characters that show nothing.
GLYPHS: dict[str, str] = {c: plain for plain, alike in _LOOKS.items() for c in alike}
GLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full width
for _base, _first, _n in ((0x1D400, "A", 26), (0x1D41A, "a", 26), (0x1D5A0, "A", 26), (0x1D5BA, "a", 26), (0x1D670, "A", 26), (0x1D68A, "a", 26), (0x1D7CE, "0", 10), (0x1D7D8, "0", 10), (0x1D7E2, "0", 10), (0x1D7EC, "0", 10), (0x1D7F6, "0", 10), (0x0660, "0", 10), (0x06F0, "0", 10), (0x0966, "0", 10), (0x2080, "0", 10)):
    GLYPHS |= {chr(_base + i): chr(ord(_first) + i) for i in range(_n)}
GLYPHS |= {c: d for c, d in zip("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789", strict=True)}
GLYPHS |= {c: str(i) for i, c in enumerate("⓪①②③④⑤⑥⑦⑧⑨")}
GLYPHS |= dict.fromkeys("­​‌‍⁠﻿‎‏᠎", "")

DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Digits that a run needs at least before spelled ones among them are read as digits.
_LEAST_DIGITS = 4
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase|chez|bei|ät|@)", r"(?:dot|punkt|point|punto|\.)"
_AT = rf"(?:\s*+{_OPEN}{_AT_WORD}{_CLOSE}\s*+|\s++(?:at|arroba|arobase)\s++|\s*+@\s*+|[_-]at[_-])"
_DOT = rf"(?:\s*+{_OPEN}{_DOT_WORD}{_CLOSE}\s*+|\s++(?:dot|punkt|punto|point)\s++|\.|[_-]dot[_-])"
#: Characters of a label and labels on either side of the at, as the standards of mail and names
#: bound them or go well beyond what is in use; a part is never split again once it is read.
_MOST_CHARS, _MOST_LABELS = 64, 16
_LABEL = rf"(?>[A-Za-z0-9_%+-]{{1,{_MOST_CHARS}}}?(?={_DOT}|{_AT}))"
_NAME = rf"(?>[A-Za-z0-9-]{{1,{_MOST_CHARS}}}?{_DOT})"
_ADDRESS = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])((?!_){_LABEL}(?:{_DOT}{_LABEL}){{0,{_MOST_LABELS}}}+)({_AT})({_NAME}{{1,{_MOST_LABELS}}})((?!(?:dot|at|punkt|punto|point)\b)[A-Za-z]{{2,12}})(?![A-Za-z0-9])")
_DOT_RE = re.compile(rf"(?i){_DOT}")
_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPOKEN_DOT = rf"(?:dot|point|punkt|punto|dash|hyphen|{_OPEN}(?:dot|\.){_CLOSE})"
#: A spelled digit or sign word, written digits, or a spelled dot or dash.
_TOKENS = re.compile(rf"(?i)((?:plus|double|triple|{_DIGIT_WORD})\b)|([0-9]++)|({_SPOKEN_DOT})")
_SIGNS = "-.,/()·"
_INNER = re.compile(rf"(?i)({_DIGIT_WORD})\b|([0-9]++)|(plus)\b|(double|triple)\b|({_OPEN}(?:dot|\.){_CLOSE}|dot\b|point\b|punkt\b|punto\b)|(dash\b|hyphen\b)|(.)", re.S)
_SPACED_DOT = r"(?:\s(?:dot|punkt|punto|point)\s|[_-]dot[_-])"
#: Every at-form of _AT but a plain @; with one, every dot-form that must follow a bare at-word.
_TRIGGER = re.compile(rf"(?i){_OPEN}(?:{_AT_WORD}|{_DOT_WORD}){_CLOSE}|[_-]at[_-]|\s@|@\s|\s(?:at|arroba|arobase)\s+[A-Za-z0-9-]++(?:\.|\s++(?:dot|punkt|punto|point)\s)|\s(?:at|arroba|arobase)\s+[A-Za-z0-9-]*?[_-]dot[_-]")
_DOT_TRIGGER = re.compile(rf"(?i){_SPACED_DOT}")
#: Written digits around a spelled dot or dash: runs without any word of digits.
_GAP = rf"\s*+(?:[{re.escape(_SIGNS)}]\s*+)?"
_DIGIT_TRIGGER = re.compile(rf"(?i)[0-9]{_GAP}{_SPOKEN_DOT}{_GAP}[0-9]")
_GLYPH = re.compile("[" + "".join(map(re.escape, sorted(GLYPHS))) + "]")


#: Runs of ASCII letters, lower-cased; every other byte parts them.
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_SPOKEN = ["plus", "double", "triple", *DIGIT_WORDS]
#: The last such run of every word of _TOKENS, alone or right behind a spelled dot or dash.
_DIGIT_KEYS = frozenset((dot + w).encode().translate(_PARTS).split()[-1] for w in _SPOKEN for dot in ("", "dot", "point", "punkt", "punto", "dash", "hyphen"))
_LATIN_GLYPHS = [c for c in GLYPHS if c < "\u0100"]


def has_glyphs(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_GLYPH.search(text))
    return any(c in text for c in _LATIN_GLYPHS)


def fold(text: str) -> str:
    """Lower case, with the letters that a pattern takes for i and s in any case."""
    low = text.lower()
    return low if low.isascii() else low.replace("i̇", "i").replace("ı", "i").replace("ſ", "s")


def may_spell(text: str) -> bool:
    """Whether spelled digits, or written ones around a spelled dot or dash, can stand in the
    text; where not, ``spelled_digits`` changes nothing."""
    return not _DIGIT_KEYS.isdisjoint(fold(text).encode().translate(_PARTS).split()) or bool(_DIGIT_TRIGGER.search(text))


def may_address(text: str) -> bool:
    """Whether a disguised address can stand in the text; where not, ``plain_addresses`` changes
    nothing."""
    return bool(_TRIGGER.search(text)) or "@" in text and bool(_DOT_TRIGGER.search(text))


class Tape:
    """A text together with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Apply (from, to, [(output, from, to)]) edits in order; the rest is copied."""
        if not edits:
            return
        text, start, end, pos = [], [], [], 0
        for a, b, outs in edits:
            text.append(self.text[pos:a])
            start += self.start[pos:a]
            end += self.end[pos:a]
            for out, x, y in outs:
                text.append(out)
                start += [self.start[x]] * len(out)
                end += [self.end[y - 1]] * len(out)
            pos = b
        text.append(self.text[pos:])
        start += self.start[pos:]
        end += self.end[pos:]
        self.text, self.start, self.end = "".join(text), start, end

    def span(self, a: int, b: int) -> Span:
        return self.start[a], self.end[b - 1]


def plain_glyphs(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), [(GLYPHS[m[0]], m.start(), m.end())] if GLYPHS[m[0]] else []) for m in _GLYPH.finditer(tape.text)])


def _joins(gap: str) -> bool:
    """Whether what stands between two tokens keeps them in one run: blanks and at most one sign."""
    gap = gap.strip()
    return not gap or len(gap) == 1 and gap in _SIGNS


def digit_runs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of runs of at least two spelled or written digits, linear in the text: one scan
    for tokens, then one walk that chains those whose gaps join them."""
    chain: list[tuple[int, int, bool]] = []  # (start, end, is a dot or dash)

    def close() -> tuple[int, int] | None:
        while chain and (chain[-1][2] or text[chain[-1][1] : chain[-1][1] + 1].isalnum()):
            chain.pop()
        if sum(not dot for *_, dot in chain) < 2:
            return None
        a = chain[0][0]
        # a plus (with a blank behind it, or none) or an opening bracket belongs to the run
        lead = next((k for k in (1, 2) if a >= k and text[a - k] == "+" and (k == 1 or text[a - 1].isspace())), int(a > 0 and text[a - 1] == "("))
        if lead and not text[a - lead - 1 : a - lead].isalnum():
            a -= lead
        return a, chain[-1][1]

    for m in _TOKENS.finditer(text):
        a, b = m.span()
        dot = bool(m[3])
        if chain and not (dot and chain[-1][2]) and _joins(text[chain[-1][1] : a]):
            chain.append((a, b, dot))
            continue
        if found := close():
            yield found
        chain = [] if dot or text[a - 1 : a].isalnum() else [(a, b, dot)]
    if found := close():
        yield found


def spelled_digits(tape: Tape) -> None:
    """Runs of spelled and written digits; separators inside a run stay as one space or dot."""
    edits = []
    for first, last in digit_runs(tape.text):
        outs, digits, spelled, times = [], 0, 0, 1
        words: set[int] = set()  # starts and ends of digit words
        for t in _INNER.finditer(tape.text, first, last):
            a, b = t.span()
            if t[1]:
                outs.append((DIGIT_WORDS[fold(t[1])] * times, a, b))
                words |= {a, b}
                digits, spelled, times = digits + times, spelled + 1, 1
            elif t[2]:
                outs += [(c * times, a + i, a + i + 1) for i, c in enumerate(t[2])]
                digits, times = digits + len(t[2]), 1
            elif t[3]:
                outs.append(("+", a, b))
                spelled += 1
            elif t[4]:
                times, spelled = {"double": 2, "triple": 3}[fold(t[4])], spelled + 1
            elif t[5]:
                outs.append((".", a, b))
                spelled += 1
            elif t[6]:
                outs.append(("-", a, b))
                spelled += 1
            elif t[7].isspace() or t[7] in ",/·":
                outs.append((" ", a, b))
            else:
                outs.append((t[7], a, b))
        if spelled and digits >= _LEAST_DIGITS:
            behind = [""] * (len(outs) + 1)  # the next output that is no blank
            for i in reversed(range(len(outs))):
                behind[i] = behind[i + 1] if outs[i][0] == " " else outs[i][0]
            tidy: list[tuple[str, int, int]] = []
            for i, o in enumerate(outs):
                if o[0] == " ":  # between digits one separator at most, and none around a dot or dash
                    before = tidy[-1][0][-1] if tidy else ""
                    if before in ("", " ", "+", ".", "-") or behind[i][:1] in ("", ".", "-") or {o[1], o[2]} <= words:
                        continue
                tidy.append(o)
            edits.append((first, last, tidy))
    tape.rewrite(edits)


#: Letters that pass for digits inside a number, and runs that may hold such.
_AS_DIGIT = {"l": "1", "I": "1", "|": "1", "O": "0", "o": "0"}
_MIXED = re.compile(r"(?<![^\W_])(?=[+(]?[0-9]|[lIOo|][0-9])[+(]?[0-9lIOo|](?:[ ().-]{0,2}[0-9lIOo|]){6,40}(?![^\W_])")


_MIXED_TRIGGER = re.compile(r"[0-9][lIOo|](?![^\W\d_lIOo])|(?<![^\W\d_])[lIOo|][0-9]")


def digit_letters(tape: Tape) -> None:
    """Letters for digits in runs of which they are at most a third, each beside a digit."""
    edits = []
    for m in _MIXED.finditer(tape.text):
        at = [i for i in range(*m.span()) if tape.text[i] in _AS_DIGIT]
        digits = sum(c in "0123456789" for c in m[0])
        if at and 2 * len(at) <= digits and all(any(c in "0123456789" for c in tape.text[max(0, i - 1) : i + 2]) for i in at):
            edits += [(i, i + 1, [(_AS_DIGIT[tape.text[i]], i, i + 1)]) for i in at]
    tape.rewrite(edits)


def plain_addresses(tape: Tape) -> None:
    """at/dot disguises. A bare `` at `` counts only with a disguised dot or a dot and a domain behind it."""
    edits = []
    for m in _ADDRESS.finditer(tape.text):
        if m[2] == "@" and all(d[0] == "." for d in _DOT_RE.finditer(m[3])) and all(d[0] == "." for d in _DOT_RE.finditer(m[1])):
            continue  # nothing is disguised
        if m[2].strip(" \t\n") == "@" and m[2] != "@" and all(d[0] == "." for d in _DOT_RE.finditer(m[3])) and "\n" in m[2]:
            continue
        bare = m[2].strip().isalpha()
        if bare and ("\n" in m[2] or m[4][:1].isupper() and m[4][1:].islower()):
            continue
        outs = []

        def dots(a: int, b: int, outs=outs) -> None:
            pos = a
            for d in _DOT_RE.finditer(tape.text, a, b):
                outs.extend((tape.text[i], i, i + 1) for i in range(pos, d.start()))
                outs.append((".", d.start(), d.end()))
                pos = d.end()
            outs.extend((tape.text[i], i, i + 1) for i in range(pos, b))

        dots(*m.span(1))
        outs.append(("@", *m.span(2)))
        dots(m.start(3), m.end(4))
        edits.append((*m.span(), outs))
    tape.rewrite(edits)


def disguised(text: str) -> dict[str, list[Span]]:
    """Spans that appear once the text is rewritten, in source offsets."""
    tape = Tape(text)
    if has_glyphs(text):
        plain_glyphs(tape)
    if _MIXED_TRIGGER.search(tape.text):
        digit_letters(tape)
    if may_spell(tape.text):
        spelled_digits(tape)
    if may_address(tape.text):
        plain_addresses(tape)
    if tape.text == text:
        return {}
    return {kind: [tape.span(a, b) for a, b in spans] for kind, spans in detect(tape.text).items()}


def find(text: str | None) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """(base spans by kind, all spans by start, then kind as listed)."""
    text = text or ""
    base = detect(text)
    found = [(kind, a, b) for kind in KINDS for a, b in base[kind]]
    for kind, spans in disguised(text).items():
        starts = [x for x, _ in base[kind]]
        for a, b in spans:
            at = bisect_right(starts, a) - 1  # base spans of a kind do not overlap
            if at < 0 or base[kind][at][1] < b:
                found.append((kind, a, b))
    return base, sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, base counts by kind, base_sha256, spans, n_spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]

    def row(text: str | None) -> tuple:
        base, spans = find(text)
        plain = sorted(((k, a, b) for k in KINDS for a, b in base[k]), key=lambda s: (s[1], KINDS.index(s[0])))
        return *(len(base[k]) for k in KINDS), hashlib.sha256(joined(plain).encode()).hexdigest(), joined(spans), len(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [row(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=names)

    schema = f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)


def redact(text: str | None, mask: str = "[{kind}]") -> str:
    """The text with every span replaced; overlapping spans become one."""
    text, out, pos = text or "", [], 0
    for kind, a, b in find(text)[1]:
        if b <= pos:
            continue
        out += [text[pos : max(a, pos)]] + [mask.format(kind=kind)] * (a >= pos)
        pos = b
    return "".join([*out, text[pos:]])


def _sql_spans(kind: int, pattern: str, keep: str) -> str:
    """Matches of one kind with their starts, from the pieces around them."""
    found = f"regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS s"
    start = "list_sum(list_transform(s[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda p: length(p))), 0)"
    return f"SELECT doc_id, {kind} AS kind, '{KINDS[kind]}' AS name, w, a FROM (SELECT doc_id, m[i] AS w, {start} AS a FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {found} FROM d))) WHERE {keep}"


_SQL_DIGITS = "regexp_replace(w, '[^0-9]', '', 'g')"
_SQL_LUHN = f"list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_SQL_DIGITS}), i, 1) AS INT) ELSE (2 * CAST(substr(reverse({_SQL_DIGITS}), i, 1) AS INT)) // 10 + (2 * CAST(substr(reverse({_SQL_DIGITS}), i, 1) AS INT)) % 10 END)) % 10 = 0"
_SQL_KINDS = [
    (EMAIL.pattern, "true"),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(w, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0"),
    (CARD.pattern, f"length({_SQL_DIGITS}) BETWEEN 12 AND 19 AND {_SQL_LUHN}"),
    (PHONE.pattern, f"length({_SQL_DIGITS}) BETWEEN 9 AND 15"),
]
#: DuckDB SQL for the base columns.
BASE_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (
  {" UNION ALL ".join(_sql_spans(k, p, keep) for k, (p, keep) in enumerate(_SQL_KINDS))}
), g AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS))}, string_agg(name || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(w) AS BIGINT), ',' ORDER BY a, kind) AS said
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in KINDS)}, sha256(coalesce(said, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
