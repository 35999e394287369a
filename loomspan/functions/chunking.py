"""Chunks of whole sentences with an overlap, for texts of more words than one chunk takes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

MOST_WORDS, OVERLAP = 350, 40
_CUT = re.compile(r"(?<=[.!?:])\s+|\n+")


def chunks(text: str | None, most: int = MOST_WORDS, overlap: int = OVERLAP) -> list[str]:
    """A text of at most ``most`` words is one chunk, as it is. Else sentences are packed while
    they fit; a new chunk begins with as many last sentences of the one before as give
    ``overlap`` words. No sentence is split, so one chunk may pass ``most``."""
    text = text or ""
    if len(text.split()) <= most:
        return [text.strip()] if text.strip() else []
    sentences = [s for part in _CUT.split(text) if (s := part.strip())]
    sizes = [len(s.split()) for s in sentences]
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held + n > most and i > start:
            out.append(" ".join(sentences[start:i]))
            held, back = sizes[i - 1], i - 1
            while held < overlap and back > start:
                back -= 1
                held += sizes[back]
            start = back
        held += n
    return [*out, " ".join(sentences[start:])]


def chunker(most: int = MOST_WORDS, overlap: int = OVERLAP):
    """A column function from a text to its chunks."""

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return pd.Series([chunks(t, most, overlap) for t in text], dtype=object)

    return cut


def embed_context(title, piece):
    """What is embedded for a piece: its document's title stands before it, if there is one."""
    return F.when(F.coalesce(title, F.lit("")) == "", piece).otherwise(F.concat(title, F.lit(". "), piece))
