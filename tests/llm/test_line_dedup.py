import hashlib
import random
from collections import defaultdict

from loomspan.llm import line_dedup as L


def brute(docs):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    key = lambda s: low(s.strip(" \t\n\r\x0b\x0c"))
    holders = defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = [("é" if i % 3 else "W") * rng.randint(36, 44) + f" line {i} " + "x" * rng.choice([0, 200]) for i in range(30)]
    docs = []
    for i in range(120):
        lines = [rng.choice([rng.choice(pool), rng.choice(pool).lower(), "\t " + rng.choice(pool) + " \r", "short", "", f"own line of document {i} that is long enough to count"]) for _ in range(rng.randint(0, 8))]
        docs.append((i, "\n".join(lines)))
    docs += [(500, None), (501, ""), (502, "\n\n"), (None, pool[0]), (None, "\n".join(pool)), (7, docs[7][1]), (3, "\n".join([pool[1]] * 4)), (800, "\n".join(pool * 300))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, digests string").repartition(5)
    want = brute(docs)
    sha = sorted([(*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want], key=repr)
    assert sorted(map(tuple, L.digest(df).collect()), key=repr) == sha
    kept = L.dedup(df)
    assert kept.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(w[0], w[3]) for w in want], key=repr)
    assert L.digest(df.limit(0)).count() == 0


def test_saturated_filter_changes_nothing(spark, monkeypatch):
    docs = [(i, "\n".join(f"a line that is certainly long enough to be a key {(i * j) % 97}" for j in range(40))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, L.digest(df).collect()))
    monkeypatch.setattr(L, "filter_bits", lambda _: L.SEGMENT_BITS)
    monkeypatch.setattr(L.Suspects, "holds", lambda self, h: L.np.ones(len(h), bool))
    assert sorted(map(tuple, L.digest(df).collect())) == want


def test_a_filter_at_its_bound_changes_nothing(spark, monkeypatch):
    """Far more keys than the largest filter has room for: all lines are suspected, results hold."""
    monkeypatch.setattr(L, "MIN_BITS", L.SEGMENT_BITS)
    monkeypatch.setattr(L, "MAX_BITS", L.SEGMENT_BITS)
    rng = random.Random(8)
    common = [f"a line that several documents hold, number {i}, and long enough" for i in range(9)]
    docs = [(i, "\n".join([*(f"own line {i} {j} of this document, {rng.random()}" + "x" * 30 for j in range(120)), rng.choice(common)])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert L.filter_bits(df.select(df["text"].cast("binary").alias("text"))) == L.SEGMENT_BITS
    want = sorted([(*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in brute(docs)])
    assert sorted(map(tuple, L.digest(df).collect())) == want


def test_filters_of_many_tasks_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "TOGETHER", 2)
    test_against_brute_force(spark)
