import hashlib
import random

import numpy as np
import pytest

from loomspan.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def texts():
    rng = random.Random(5)
    alphabet = ["a", "word", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "漢", "😀", "'s", "'ll", "1", "23", ".", "!!", " ", " ", "<|endoftext|>", "<|", "\r\n", "x" * 50]
    passage = "".join(rng.choice(alphabet) for _ in range(900))
    out = ["", " ", "a", "<|endoftext|>", "x" * 20_000, " " * 9_000, "\n" * 5_000, "é" * 9_001, "漢字" * 5_000, "ab " * 6_000, passage]
    for _ in range(60):
        own = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 2_500)))
        out.append(own if rng.random() < 0.5 else own + passage + own[::-1])
    return out


def test_ids_agree_with_the_library(library):
    codec = bpe.ChunkCodec(bpe.tokenizer_path())
    for text in texts() * 2:
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(codec.encode(text)) == library.decode(codec.encode(text), skip_special_tokens=False) == text
    assert codec.reused > codec.encoded > 0 and codec.repaired and codec.widened and codec.merged
    assert codec.reused_bytes > codec.encoded_bytes


def test_tiny_cache_changes_nothing(library):
    codec = bpe.ChunkCodec(bpe.tokenizer_path(), 3_000)
    for text in texts():
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_frame(spark, library):
    rows = [(i, t, "x", i) for i, t in enumerate([*texts(), None])] + [(None, "null id", None, 0), (3, "again", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = bpe.encode(df, with_ids=True).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.setdefault(i, []).append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) in want[r.doc_id]
    assert bpe.encode(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df, with_ids=True)).where("doc_id = 12").first().text
    assert back == rows[12][1]


def test_chunks_of_a_passage_are_the_same_wherever_it_stands():
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(2_000)).encode()
    chunks = []
    for head in (b"", b"another beginning, " * 9, "é".encode() * 77):
        data = head + passage
        starts = [0, *bpe.cuts(data), len(data)]
        chunks.append({data[a:b] for a, b in zip(starts, starts[1:], strict=False)})
    common = chunks[0] & chunks[1] & chunks[2]
    assert sum(map(len, common)) > 0.9 * len(passage)
