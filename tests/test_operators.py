import math
import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import components, editorial, evaluate, retrieval, tables


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [0.0, None, None]


def test_blocks_of_queries_cover_all(spark, monkeypatch):
    q = spark.range(50).select(F.col("id").alias("query_id"))
    seen = [r.query_id for b in retrieval.blocks(q, "query_id", 7) for r in b.collect()]
    assert sorted(seen) == list(range(50))
    assert retrieval.against_all(q.limit(0), q.withColumnRenamed("query_id", "x"), "query_id", F.lit(1.0)).count() == 0


def test_fusion_keeps_ranks_of_the_whole_corpus(spark):
    rows = [(1, c, c // 2, 1.0 - c / 10, c, c % 4 != 0) for c in range(10)]
    semantic = spark.createDataFrame(rows, "query_id int, chunk_id int, doc_id int, sim double, rank int, dated boolean")
    keyword = spark.createDataFrame([(1, 9, 0)], "query_id int, chunk_id int, rank int")
    got = retrieval.hybrid(semantic, keyword, F.col("dated"), 3).orderBy("place").collect()
    assert [(r.doc_id, r.chunk_id) for r in got] == [(4, 9), (0, 1), (1, 2)]
    assert got[0].score == pytest.approx(1 / 69 + 1 / 60) and got[1].score == pytest.approx(1 / 61)


def test_result_rows(spark):
    r = retrieval.result(spark.createDataFrame([(0.123456, 0.98765, "2026-08-22 10:00:00", "a\nb" + "x" * 200)], "score double, sim double, modified string, text string")).first()
    assert (r.score, r.sim, r.modified, r.snippet[:3], len(r.snippet)) == (0.1235, 0.988, "2026-08-22", "a b", 160)


def test_editorial(spark):
    with pytest.raises(ValueError):
        editorial.weighted({"a": 50})
    bands = spark.createDataFrame([(float(x),) for x in (0, 30, 35, 40, 70, 75, 80, 100)], "s double").select(editorial.band(F.col("s")).alias("b")).collect()
    assert [r.b for r in bands] == ["low", "low", None, "middle", "middle", None, "high", "high"]
    tags = spark.createDataFrame([(["kuram", "politika"],), ([],), (None,), (["?"],)], "t array<string>").select(editorial.leading_tag(F.col("t")).alias("g")).select("g", editorial.section(F.col("g")).alias("s"), editorial.section_place(editorial.section(F.col("g"))).alias("p")).collect()
    assert [r.g for r in tags] == ["politika", None, None, None] and tags[0].s == "Ne düşünmeli?" and tags[0].p == 3
    items = spark.createDataFrame([(1, "u?utm_source=a", "x y"), (2, "u", "X  Y"), (3, "v", None)], "id int, url string, t string")
    assert {r.id: (r.class_id, r.copies) for r in editorial.copies(items, "id", "t").collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
    assert {r.canonical: (r.first_id, r["items"]) for r in editorial.dedupe_urls(items, "url", "id", "t").collect()} == {"u": (1, 2), "v": (3, 1)}
    words = spark.createDataFrame([("chip", "Chip"), ("ai chip", "KI-Chip")], "term string, target string")
    text = spark.createDataFrame([(1, "An AI chip."), (2, "chips"), (3, "a Chip!"), (4, None)], "id int, t string")
    assert sorted((r.id, r.term) for r in editorial.glossary_hits(text, words, "id", "t").collect()) == [(1, "ai chip"), (3, "chip")]
    assert sorted((r.id, r.term) for r in editorial.glossary_hits(text, words, "id", "t", block=1).collect()) == [(1, "ai chip"), (3, "chip")]
    now = F.lit("2026-08-22").cast("timestamp")
    fresh = spark.sql("SELECT * FROM VALUES (timestamp'2026-08-01', 30), (timestamp'2026-07-01', 30), (timestamp'2020-01-01', null) t(ts, d)")
    assert [r[0] for r in fresh.select(editorial.fresh(F.col("ts"), now, F.col("d"))).collect()] == [True, False, True]
    maps = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 3, 'a', 4) AS y, map('a', 1) AS z")
    assert tuple(maps.select(editorial.same_keys(F.col("x"), F.col("y")), editorial.same_keys(F.col("x"), F.col("z"))).first()) == (True, False)


def test_suggest_flags_and_never_selects(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), float(rng.randint(0, 5))) for i in range(60)]
    got = editorial.suggest(spark.createDataFrame(rows, "id int, g string, s double"), "g", "s", "id", 4).collect()
    want = {i for g in "ab" for _, i in sorted((-s, i) for i, h, s in rows if h == g)[:4]}
    assert {r.id for r in got if r.suggested} == want and len(got) == 60 and not any(r.selected for r in got)


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([("A", 1, 1), ("B", 2, 4), ("c", 3, 1)], "v string, k int, n int")
    assert sorted(map(tuple, tables.upsert(old, new, "k", "n").collect())) == [(1, "A", 1), (2, "b", 5), (3, "c", 1)]
    assert sorted(map(tuple, tables.replace_children(old, new.where("k = 1"), "k").collect())) == [(1, "A", 1), (2, "b", 5)]
    assert {r.k: r.status for r in tables.compare(old, new.select("k", "v"), "k", "v").collect()} == {1: "changed", 2: "changed", 3: "removed"}
    assert tables.edits(old, old.withColumn("v", F.when(F.col("k") == 1, "z").otherwise(F.col("v"))), "k", "v").count() == 1
    assert tables.prune(old, new.where("k = 2"), "k").count() == 1


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (3, 6, True), (4, 1, None)], "query_id int, place int, ok boolean")
    first = evaluate.first_match(hits, F.col("ok"))
    assert {r.query_id: r["first"] for r in first.collect()} == {1: 2, 2: 1, 3: 0, 4: 0}
    m = evaluate.metrics(first).first()
    assert (m.n, m.p_at_1, m.p_at_3, m.mrr) == (4, 0.25, 0.5, 0.375)
    votes = spark.createDataFrame([(1, 5), (1, 5), (1, 3), (2, 9), (2, 4)], "query_id int, label int")
    assert {r.query_id: r.predicted for r in evaluate.majority(votes).collect()} == {1: 5, 2: 4}
    names = spark.createDataFrame([("Rapor.DOCX", "rapor"), ("x", "y")], "n string, e string")
    assert [r[0] for r in names.select(evaluate.names_match(F.col("n"), F.col("e"))).collect()] == [True, False]


def test_components_with_and_without_hot_centres(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(500, x) for x in range(501, 540)] + [(700 - x, 700) for x in range(1, 40)] + [(7, 7)]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    for most in (200, 3):
        monkeypatch.setattr(components, "HOT_ROWS", most)
        got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: t for x, t in top.items() if x != t}


def test_glossary_takes_any_term(spark):
    words = spark.createDataFrame([("漢字", "kanji"), ("a\\E(", "x"), ("c++", "y"), ("日本", "z"), (None, "n"), ("", "e"), ("Chip", "c"), ("chip", "d")], "term string, target string")
    text = spark.createDataFrame([(1, "これは漢字です"), (2, "see a\\E( now, and C++."), (3, "chips"), (4, "a CHIP"), (5, None), (6, "")], "id int, t string")
    want = [(1, "漢字"), (2, "a\\E("), (2, "c++"), (4, "Chip"), (4, "chip")]
    for block in (100, 1):
        assert sorted((r.id, r.term) for r in editorial.glossary_hits(text, words, "id", "t", block).collect()) == sorted(want)
    assert editorial.glossary_hits(text, words.limit(0), "id", "t").count() == 0


def test_suggestions_of_repeated_ids_and_null_groups(spark):
    rows = [("a", 1, 5.0), ("a", 2, 4.0), ("a", 3, 3.0), ("b", 1, 9.0), ("b", 3, None), (None, 4, 1.0), ("a", 2, 4.0)]
    items = spark.createDataFrame(rows, "g string, id int, s double")
    got = sorted(((r.g or "-", r.id, r.s or 0.0, r.suggested) for r in editorial.suggest(items, "g", "s", "id", 2).collect()))
    assert got == [("-", 4, 1.0, True), ("a", 1, 5.0, True), ("a", 2, 4.0, True), ("a", 2, 4.0, True), ("a", 3, 3.0, False), ("b", 1, 9.0, True), ("b", 3, 0.0, False)]
    counted = editorial.selected_counter(items.withColumn("selected", F.col("id") == 2), "g", 1)
    assert sorted((r.g or "-", r.selected, r.open) for r in counted.collect()) == [("-", 0, 1), ("a", 2, 0), ("b", 0, 1)]


def test_ranks_and_postings_over_many_tasks(spark):
    """Ranks dealt by range, and phrases found by their places, against plain code."""
    rng = random.Random(4)
    scored = [(q, i, round(rng.random(), 1)) for q in (1, 2) for i in range(300)]
    df = spark.createDataFrame(scored, "query_id int, chunk_id int, sim double").repartition(7)
    want = {(q, i): n for q in (1, 2) for n, (_, i) in enumerate(sorted((-s, i) for p, i, s in scored if p == q))}
    assert {(r.query_id, r.chunk_id): r["rank"] for r in retrieval.dense_rank_from_zero(df, "sim", "chunk_id").collect()} == want
    texts = [" ".join(rng.choice(["a", "b", "c", "Dé"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, ["a b a", "de"]), (2, ["zz", "..."])], "query_id int, terms array<string>")
    tokens = [(t or "").lower().replace("é", "e").split() for t in texts]
    mean = sum(map(len, tokens)) / len(tokens)
    score = {}
    for phrase in (["a", "b", "a"], ["de"]):
        tf = {i: n for i, t in enumerate(tokens) if (n := sum(t[k : k + len(phrase)] == phrase for k in range(len(t))))}
        idf = max(math.log((len(tokens) - len(tf) + 0.5) / (len(tf) + 0.5)), retrieval.LEAST_IDF)
        for i, n in tf.items():
            score[i] = score.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean))
    for found in (retrieval.bm25(docs, queries), retrieval.score_postings(retrieval.postings(docs, "doc_id", "text"), retrieval.phrases(queries), retrieval.statistics(docs.select(F.size(text.index_tokens(F.col("text"))).alias("length"))))):
        got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
        assert set(got) == {(1, i) for i in score} and all(abs(got[1, i] - s) < 1e-9 for i, s in score.items())


@pytest.mark.parametrize("again", [False, True])
def test_terms_are_counted_without_a_row_for_a_place(spark, again):
    """Ids of several rows count once, null ids not at all; no posting was spared before."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "Dé", f"w{i % 40}"]) for _ in range(rng.randint(0, 9)))) for i in range(90)]
    rows += [(None, "a a null"), (None, "a"), (91, None), (92, ""), (93, "...")] + ([(5, "a b twice"), (5, "a twice"), (6, None)] if again else [])
    places, docs = {}, {}
    for i, t in rows:
        for w in (t or "").lower().replace("é", "e").replace(".", "").split():
            places[w] = places.get(w, 0) + 1
            docs.setdefault(w, set()).update({i} - {None})
    found = retrieval.term_counts(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), "doc_id", "text")
    assert sorted(map(tuple, found.collect())) == sorted((w, n, len(docs[w])) for w, n in places.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("Generate" in plan) == again and "MapInArrow" in plan
