import random

import pytest

from loomspan.llm import near_dup as N
from loomspan.operators import components


def brute(rows, width, percent=80):
    sets = []
    for _, t in rows:
        w = N.words(t.encode()) if t else []
        m = min(width, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    top = list(range(len(rows)))

    def of(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or x and 100 * x >= percent * len(sets[i] | sets[j])):
                top[of(i)] = of(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[of(i)] = min(least.get(of(i), k), k)
    return sorted((str(k), len(sets[i]), str(least.get(of(i))), k == least.get(of(i))) for i, (k, _) in enumerate(rows))


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["of", "the", "und", "la", "Ab", "é"]) if rng.random() < 0.5 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = []
    for _ in range(n):
        w = [word() for _ in range(rng.choice([0, 1, 2, 3, 8, 40, 120]))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            v = list(w)
            for _ in range(rng.randint(0, 1 + len(v) // 14)):
                if v:
                    v[rng.randrange(len(v))] = word()
            texts.append(rng.choice([" ", "\n", " \t"]).join(v))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows + [(None, texts[0]), (None, None), (9000, None), (9001, ""), (9002, " \n"), (rows[5][0], rows[5][1]), (rows[6][0], "quite another text now"), (9003, "w " * 30_000)]


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5)])
def test_against_brute_force(spark, seed, width):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = N.classes(df, width=width).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, width)


def test_large_groups_are_finished_in_tiles(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(60)]
        for _ in range(60):
            v = list(base)
            for _ in range(rng.randint(0, 8)):
                v[rng.randrange(len(v))] = word()
            rows.append((len(rows), " ".join(v)))
    monkeypatch.setattr(N, "BLOCK", 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.classes(df, width=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, 2)
    assert 3 < len({r.component_id for r in got}) < len(rows)


def test_dedup_keeps_columns_and_one_of_each_group(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    kept = N.dedup(df, width=2)
    want = [r[0] for r in brute(rows, 2) if r[3] or r[0] == "None"]
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)
    assert N.dedup(df.limit(0)).count() == 0


def test_coordinates_agree_as_often_as_the_sets():
    import numpy as np

    rng, table = np.random.default_rng(1), N.numbering()
    for share in (0.5, 0.8, 0.95):
        agree = []
        for _ in range(30):
            s = rng.integers(0, 2**64, 400, dtype=np.uint64)
            both = int(800 * share / (1 + share) / 2 * 2 // 2)
            a, b = s[: (400 + both) // 2], s[(400 - both) // 2 :]
            j = len(np.intersect1d(a, b)) / 400
            agree.append((N.signature(a, table) == N.signature(b, table)).mean() - j)
        assert abs(np.mean(agree)) < 0.02


def test_hot_nodes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 3)
    test_large_groups_are_finished_in_tiles(spark, monkeypatch)


def test_common_counts_by_columns(monkeypatch):
    import numpy as np

    monkeypatch.setattr(N, "COLUMNS", 5)
    rng = np.random.default_rng(3)
    sides = [[np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 20, 50)] for _ in range(2)]
    assert N.common(*sides).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sides[1]] for a in sides[0]]


def test_scratch_goes_but_what_the_result_reads(spark):
    import os

    held = lambda: set(os.listdir(f"{spark.conf.get('spark.checkpoint.dir')}/loomspan"))
    rows = corpus(6, 12)
    N.components(spark.createDataFrame([(1, 2)], "a long, b long"))
    before = held()
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert {d.rsplit("-", 1)[0] for d in held() - before} == {"documents-by-set", "components"}
    assert got.count() == len(rows)


@pytest.mark.parametrize("words", [60, 200])
def test_near_copies_are_found(spark, words):
    """Copies with up to one word in 25 changed: at most 2 of 25 shingles of two words differ."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, copies = [], set()
    for i in range(200):
        base = [word() for _ in range(words)]
        rows.append((2 * i, " ".join(base)))
        for at in rng.sample(range(words), rng.randint(1, words // 25)):
            base[at] = word()
        rows.append((2 * i + 1, " ".join(base)))
        copies.add(2 * i + 1)
    got = {r.doc_id for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect() if not r.kept}
    assert got <= copies and len(got) >= 0.98 * len(copies)


def near_group(seed, n, words=200):
    """Texts from one base, most of them no links of each other, and a link for every tenth."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(words)], []
    for _ in range(n):
        v = [word() if rng.random() < 0.06 else w for w in base]
        rows.append((len(rows), " ".join(v)))
        if len(rows) % 10 == 0:
            v[rng.randrange(words)] = word()
            rows.append((len(rows), " ".join(v)))
    return rows


def joined(spark, since=-1):
    """Most rows that a join made in the executions after ``since``, and the last one's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most, last = store.executionsList(), 0, since
    for run in [runs.apply(k).executionId() for k in range(runs.size())]:
        if run <= since:
            continue
        last = max(last, run)
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in [nodes.apply(k) for k in range(nodes.size()) if "Join" in nodes.apply(k).name()]:
            for metric in [node.metrics().apply(k) for k in range(node.metrics().size())]:
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most, last


def test_no_join_makes_rows_of_pairs(spark):
    """Buckets of some 80 texts that are no links: their pairs are many times their rows."""
    rows = near_group(4, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.count()
    since = joined(spark)[1]
    got = N.classes(df, width=2).collect()
    most = joined(spark, since)[0]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, 2)
    assert 20 < len(rows) - len({r.component_id for r in got}) < 200
    assert 0 < most <= N.BANDS * len(rows)


def test_small_groups_of_long_texts_are_cut_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 20_000)
    rows = near_group(5, 60)
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, 2)
