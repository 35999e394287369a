"""The pipeline's stages, each against a plain one."""

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomspan.llm import bpe, toxicity  # noqa: E402
from tests.llm.test_decontaminate import split  # noqa: E402
from tests.llm.test_near_dup import brute as groups  # noqa: E402

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_lines(docs):
    where = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = low(line.strip(BLANK))
            if len(key) >= 40:
                where[key].add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= 5}
    return [(i, "\n".join(x for x in (t or "").split("\n") if gone.get(low(x.strip(BLANK)), i) == i)) for i, t in docs]


def leaks(text, bench):
    w = split(text)
    windows = {tuple(w[i : i + m]) for m in {min(8, len(b)) for _, b in bench} for i in range(len(w) - m + 1)}
    n, share, of = 0, 0.0, set()
    for _, b in bench:
        m = min(8, len(b))
        places = [tuple(b[i : i + m]) for i in range(len(b) - m + 1)]
        own = [x for x in places if x in windows]
        of |= set(own)
        n += bool(own)
        share = max(share, len(own) / len(places))
    hit = {j for m in {len(x) for x in of} for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in of for j in range(i, i + m)}
    run = max((len(list(g)) for k, g in itertools.groupby(range(len(w)), hit.__contains__) if k), default=0)
    return n >= 2 or share >= 0.5 or run >= 24


def test_against_plain_stages(spark):
    from tokenizers import Tokenizer

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").collect()]
    model = toxicity.train(read("documents"), read("labels"))
    docs = [(i, t) for i, t in docs if model.score(t) < toxicity.THRESHOLD]
    docs = plain_lines(docs)
    kept = {int(r[0]) for r in groups(docs, 2) if r[3]}
    docs = [(i, t) for i, t in docs if i in kept]
    bench = [(r.item_id, split(r.text)) for r in read("benchmark").collect() if split(r.text)]
    docs = [(i, t) for i, t in docs if not leaks(t, bench)]
    library = Tokenizer.from_file(bpe.tokenizer_path())
    library.encode_special_tokens = False
    want = []
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert len(want) > 50


def test_stages_keep_the_columns_and_bear_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", None, None, None), (2, "a b", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame, n in ((docs, 4), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns and out.count() == n
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == n
