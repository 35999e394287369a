import hashlib
import random
import re

from loomspan.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, bench):
    w, hit, items = split(doc), set(), set()
    for item, text in bench:
        v = split(text)
        if item is None or not v:
            continue
        m = min(8, len(v))
        for window in {tuple(v[i : i + m]) for i in range(len(v) - m + 1)}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == window:
                    hit.update(range(i, i + m))
                    items.add(str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "é", "Ünd", "the", "x1", "of", "straße", "日本"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    bench = [(i, text(rng.choice([1, 2, 3, 7, 8, 9, 20, 40]))) for i in range(30)] + [(4, text(12)), (None, "a a"), (90, None), (91, ""), (92, "..."), (93, "B"), (93, "b")]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(bench)[1] or "") + text(5), "clash") for i in range(80)]
    docs += [(80, None, ""), (81, "", ""), (None, "a b", ""), (3, docs[3][1], ""), (82, "word " * 60_000 + (bench[8][1] or ""), "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(((i, *brute(t, bench)) for i, t, _ in docs), key=repr)
    for how in ({}, {"block_bytes": 500}):
        got = D.decontaminate(d, b, **how)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert D.decontaminate(d.limit(0), b).count() == 0
    none = D.decontaminate(d, b.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(docs)


def test_one_whole_item_is_enough_to_drop_a_document(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    other = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, "x " + item + " y"), (2, "x " + " ".join(item.split()[:9]) + " y"), (3, " ".join(item.split()[:8]) + " and " + " ".join(other.split()[:8])), (4, "clean"), (5, None), (None, "clean too"), (4, "clean")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n int")
    b = spark.createDataFrame([("a", item), ("b", other), ("c", None)], "item_id string, text string")
    for size in (10**6, 40):
        kept = D.drop_contaminated(d, b, block_bytes=size)
        assert kept.columns == d.columns
        assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, docs[1:2] + docs[3:]))
    assert D.drop_contaminated(d, b.limit(0)).count() == len(docs) and D.drop_contaminated(d.limit(0), b).count() == 0


def test_long_items_in_pieces_and_long_runs(spark, monkeypatch):
    """An item over several pieces and blocks is one item; a long run of a longer item is a leak."""
    monkeypatch.setattr(D, "PIECE", 7)
    rng = random.Random(9)
    item = [f"w{rng.randint(0, 40)}" for _ in range(120)]
    bench = [("long", " ".join(item)), ("short", "p q r s t u v w x")]
    docs = [(i, "z " * i + " ".join(item[a : a + n]) + " z", "c") for i, (a, n) in enumerate([(0, 7), (0, 8), (3, 12), (10, 23), (20, 24), (0, 120), (50, 70)])]
    d = spark.createDataFrame(docs, "doc_id long, text string, __hits string")
    b = spark.createDataFrame(bench, "item_id string, text string")
    for size in (10**6, 60):
        got = D.decontaminate(d, b, block_bytes=size)
        assert sorted(map(tuple, got.collect())) == sorted((i, *brute(t, bench)) for i, t, _ in docs)
        shares = {r.doc_id: r.share for r in D.annotate(d, b, block_bytes=size).collect()}
        assert shares[0] == 0 and abs(shares[1] - 1 / 113) < 1e-9 and abs(shares[5] - 1) < 1e-9 and abs(shares[6] - 63 / 113) < 1e-9
    d = d.select("doc_id", "text")
    for size in (10**6, 60):
        assert sorted(r.doc_id for r in D.drop_contaminated(d, b, block_bytes=size).collect()) == [0, 1, 2, 3]
