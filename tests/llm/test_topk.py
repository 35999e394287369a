import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 10 == 0}):
        a = min(v for i, v in ok if i == q)
        scores = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(a))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def vectors(seed, n=300):
    rng = random.Random(seed)
    grid = [-1.0, -0.5, 0.0, 0.25, 1.0]
    vec = lambda d, f=None: [(f or (lambda: rng.gauss(0, 1)))() for _ in range(d)]
    rows = [(i, vec(9)) for i in range(n)] + [(1000 + i, vec(9, lambda: rng.choice(grid))) for i in range(n)] + [(2000 + i, [1.0] * 9) for i in range(80)] + [(3000 + i, [-3.0] * 9) for i in range(4)]
    rows += [(4000, None), (4010, []), (4020, [1.0, None] + [0.0] * 7), (4030, [math.nan] * 9), (4040, [math.inf] * 9), (None, [1.0] * 9), (50, vec(9)), (51, vec(9)), (5000, [1.0, 2.0]), (5001, [3.0, -1.0]), (6000, [5e5] * 9), (6001, [-5e5] * 9), (6002, [5e5 + 0.5] * 9)]
    rng.shuffle(rows)
    return [(*r, "x") for r in rows]


def test_against_brute_force(spark):
    for seed, k, lists, block in ((1, 10, 4, 2048), (2, 3, 3, 7), (3, 10, 20, 40)):
        rows = vectors(seed)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
        got = topk.search(df, F.col("vec_id") % 10 == 0, k=k, lists=lists, block=block).collect()
        assert sorted(map(tuple, got)) == sorted(brute(rows, k))


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.search(df.where("vec_id = 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_lists_are_read_down_to_the_threshold_only():
    """Long vectors set the cutoff; of the many short ones neither parts nor scores are computed."""
    rng = np.random.default_rng(5)
    rows = rng.integers(-1000, 1000, (2000, 16))
    rows[40:] //= 100
    ids = np.arange(2000)
    queries = rows[:8]
    block = [(int(i), v.tolist(), None) for i, v in zip(ids[:8], queries, strict=True)]
    first = topk.Search(block, 10, 4)
    first.report(ids, rows)
    cutoffs = {q: int(np.sort(scores)[-10]) for q, (_, scores) in first.held.items()}
    second = topk.Search([(q, v, cutoffs[q]) for q, v, _ in block], 10, 4)
    second.collect(ids, rows)
    assert second.read < 8 * 4 * len(rows) / 4 and second.resolved < 8 * len(rows) / 10
    for q, v, _ in block:
        scores = rows @ np.array(v)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        got = sorted(zip((-second.held[q][1]).tolist(), second.held[q][0].tolist(), strict=True))
        assert got == want
