"""Models behind plain callables, so that every query runs without one.

A provider is made once per Python worker and called with batches. The ones here are
deterministic: a hashing embedder and a dictionary translator. Others plug into the same
columns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from loomspan.functions import facts
from loomspan.functions.text import ABBREVIATIONS

BATCH = 64


def hashing_embedder(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Signed counts of hashed words, of length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * size
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def dictionary_translator(words: dict[tuple[str, str], dict[str, str]]) -> Callable[[str, str, str], str]:
    """Word by word; a pair of languages without words raises, before anything is loaded."""

    def translate(text: str, source: str, target: str) -> str:
        if (source, target) not in words:
            raise ValueError(f"no words from {source} to {target}")
        return " ".join(words[source, target].get(w.lower(), w) for w in text.split())

    return translate


def first_answer(*providers: Callable) -> Callable:
    """The answer of the first provider that does not fail; the last one's error is raised."""

    def ask(*args):
        for i, p in enumerate(providers):
            try:
                return p(*args)
            except (OSError, TimeoutError, ValueError):
                if i == len(providers) - 1:
                    raise
        raise RuntimeError("no provider")

    return ask


def with_fallback(first: Callable, second: Callable, warn: Callable[[str], None]) -> Callable:
    """The second host once the first has failed, with one warning in all; if both fail, an error
    that names both."""
    failed: list[Exception] = []

    def ask(*args):
        if not failed:
            try:
                return first(*args)
            except (OSError, TimeoutError) as e:
                failed.append(e)
                warn(f"{e}; asking the other host from now on")
        try:
            return second(*args)
        except (OSError, TimeoutError) as e:
            raise RuntimeError(f"no host answers: {failed[0]}; {e}") from e

    return ask


def by_sentence(load: Callable[[], Callable[[list[str], str, str], list[str]]], codes: dict[str, str], batch: int = BATCH) -> Callable[[str, str, str], str]:
    """A translator of lines from one of batches of sentences: a language it has no code for is an
    error before the model is loaded; a line is split, its sentences lose the dash of a change of
    speaker, and are joined again."""
    model: list[Callable] = []
    short = re.compile(rf"(?:^|\s)(?i:{'|'.join(ABBREVIATIONS)})[.!?…]{{1,4}}$")

    def sentences(text: str) -> list[str]:
        out = [""]
        for part in re.split(r"(?<=[.!?…])\s+", text.strip()):
            if out[-1] and short.search(out[-1]):
                out[-1] += " " + part
            else:
                out.append(part)
        return [s for s in (x.lstrip("-–— ").strip() for x in out) if s]

    def translate(text: str, source: str, target: str) -> str:
        for code in (source, target):
            if code not in codes:
                raise ValueError(f"no code for the language {code}")
        if not model:
            model.append(load())
        said, told = sentences(text), []
        for lo in range(0, len(said), batch):
            told += model[0](said[lo : lo + batch], codes[source], codes[target])
        return " ".join(told)

    return translate


def choose(kind: str, model: Callable | None, pairs: Callable | None) -> tuple[Callable | None, Callable]:
    """(rough, careful) makers of translators. Drafts take the quick sentence-pair engine or none.
    Finals are checked against the facts of what was said: with ``llm`` the model's answer, else
    the pair engine's; with ``pairs`` that alone. What keeps the facts in no way is empty."""
    if kind not in ("llm", "pairs") or kind == "llm" and model is None or kind == "pairs" and pairs is None:
        raise ValueError(f"no engine for {kind}")
    first, second = (model, pairs) if kind == "llm" else (pairs, None)

    def careful() -> Callable[[str, str, str], str]:
        ask, other = first(), second() if second else None

        def translate(text: str, source: str, target: str) -> str:
            try:
                got = ask(text, source, target)
            except (OSError, RuntimeError, ValueError):
                got = ""
            return facts.accept(text, got, target, (lambda: other(text, source, target)) if other else None)

        return translate

    return pairs, careful


def recognition(make: Callable[[], Callable[[list[float], str | None], tuple[str, dict[str, float]]]], allowed: list[str]):
    """A column function of (samples, prompt): (text, lang), the likeliest allowed language; what
    fails to be heard is null."""

    @F.pandas_udf("text string, lang string")
    def heard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        listen = make()

        def one(samples, prompt) -> tuple[str | None, str | None]:
            if samples is None:
                return None, None
            try:
                said, odds = listen([float(x) for x in samples], prompt)
            except (OSError, RuntimeError, ValueError):
                return None, None
            known = sorted((-p, lang) for lang, p in odds.items() if lang in allowed)
            return said, known[0][1] if known else None

        for samples, prompts in batches:
            yield pd.DataFrame([one(*x) for x in zip(samples, prompts, strict=True)], columns=["text", "lang"])

    return heard


def extractive_notes(most: int = 20) -> Callable[[str], str]:
    """Notes without a model: the lines of a transcript that name a day or a number, as decisions."""

    def write(prompt: str) -> str:
        lines = [line.strip() for line in prompt.splitlines() if line.startswith("[")]
        told = [line for line in lines if any(facts.read(line.partition(") ")[2]))]
        return "\n".join(["## Kararlar", *(f"- {line.partition(') ')[2]}" for line in told[:most])]) if told else ""

    return write


def embedding(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH):
    """A column function from text to a vector. A batch that fails is tried text by text, and a
    text that fails has a null vector."""

    @F.pandas_udf("array<float>")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()

        def one(text: str):
            try:
                return embed([text])[0]
            except Exception:
                return None

        for series in texts:
            said, out = [t or "" for t in series], []
            for lo in range(0, len(said), batch):
                part = said[lo : lo + batch]
                try:
                    out += embed(part)
                except Exception:
                    out += map(one, part)
            yield pd.Series(out, dtype=object)

    return vector


def translation(make: Callable[[], Callable[[str, str, str], str]]):
    """A column function of (text, source, target); a failure is an empty translation."""

    @F.pandas_udf("string")
    def said(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        translate = make()

        def one(text, source, target) -> str:
            try:
                return translate(text or "", source, target) if text else ""
            except Exception:
                return ""

        for texts, sources, targets in batches:
            yield pd.Series([one(*x) for x in zip(texts, sources, targets, strict=True)], dtype=object)

    return said


def allowed_language(probabilities, allowed: list[str]):
    """The likeliest of the allowed languages of a map from language to probability."""
    entries = F.filter(F.map_entries(probabilities), lambda e: e["key"].isin(allowed))
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    return best["k"]
