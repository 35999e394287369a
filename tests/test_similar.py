import random

import numpy as np
import pytest

from loomspan.operators import similar
from loomspan.plans import catalog


def brute(items, least):
    """Class and links by id, from all pairs."""
    def sim(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b) or not np.isfinite([*a, *b]).all():
            return 0.0
        a, b = np.float64(np.float32(a)), np.float64(np.float32(b))
        return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)

    near = {i: [j for j, w in items if j != i and sim(v, w) >= least] for i, v in items}
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        out[i] = (min(seen), len(near[i]))
    return out


@pytest.mark.parametrize("together", [1, 16])
def test_classes_and_links_of_every_item(spark, monkeypatch, together):
    monkeypatch.setattr(similar, "BLOCK", 20)
    monkeypatch.setattr(similar, "STRIP", 7)
    monkeypatch.setattr(similar, "TOGETHER", together)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    items = [(i, [x + rng.gauss(0, 0.25) for x in rng.choice(centres)]) for i in range(100, 190)]
    items += [(i, [1.0, 2.0, 3.0]) for i in range(30)] + [(i, [2.0, 4.0, 6.5]) for i in range(40, 44)] + [(50, [9.0, -9.0, 0.0])]
    items += [(60, None), (61, []), (62, [0.0] * 8), (63, [0.0] * 8), (64, [float("nan")] * 8), (65, [float("inf")] * 8)]
    rng.shuffle(items)
    df = spark.createDataFrame([*items, (None, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = similar.near_classes(df, "vec_id", "embedding", 0.9).collect()
    assert len(got) == len(items) + 1
    want = brute(items, 0.9) | {None: (None, 0)}
    assert {r.vec_id: (r.class_id, r.links) for r in got} == want
    assert len({c for c, _ in want.values()}) > 5
    assert [tuple(r) for r in similar.near_classes(df.where("vec_id = 62"), "vec_id", "embedding", 0.9).collect()] == [(62, 62, 0)]


def test_chains_are_one_class(spark):
    turn = [(i, [float(np.cos(i / 4)), float(np.sin(i / 4))]) for i in range(9)]
    got = similar.near_classes(spark.createDataFrame(turn, "vec_id long, embedding array<float>"), "vec_id", "embedding", 0.95).collect()
    assert sorted((r.vec_id, r.class_id, r.links) for r in got) == [(i, 0, 1 + (0 < i < 8)) for i in range(9)]


def test_registered_for_every_row():
    assert "near_duplicates" in catalog.QUERIES and "near_duplicates" in catalog.ORACLE_SQL
