import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import chunking, facts, providers, text, timephrase
from loomspan.plans import texts as text_plans


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", make(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_text_functions(spark):
    assert column(spark, ["a<b>c</b> &d", "<p></p>", None], text.html_strip) == ["a c  &d", "", ""]
    assert column(spark, ["Eins: zwei. Drei\n\nvier!  Fünf… sechs", "", None, "a.b c"], text.sentences) == [["Eins:", "zwei.", "Drei", "vier!", "Fünf… sechs"], [], [], ["a.b c"]]
    assert column(spark, ["Your host, Dr. Ginger Campbell. Hi!  there… ok", "etc. and", "no. 5 is here. Yes"], text.spoken_sentences) == [["Your host, Dr. Ginger Campbell.", "Hi!", "there…", "ok"], ["etc. and"], ["no. 5 is here.", "Yes"]]
    assert column(spark, ['fatura "2026-0417" ve "iki söz" a1 b22', None, "plain words"], text.exact_terms) == [["2026-0417", "iki söz", "2026-0417", "b22"], [], []]
    assert column(spark, ["Çay İçin ığüé-42 naïve", None], text.index_tokens) == [["cay", "icin", "ıgue", "42", "naive"], []]
    assert column(spark, ['Turkish: "Merhaba"', "  çeviri:  iyi ", "“x”", '"', None, "'a'"], text.clean_answer) == ["Merhaba", "iyi", "“x”", '"', "", "a"]
    assert column(spark, ["… .  and then ", "-– Tamam"], text.trim_continuation) == ["and then", "-– Tamam"]
    assert column(spark, ["- It's fine.", "—  Ja"], text.strip_dashes) == ["It's fine.", "Ja"]
    assert column(spark, [0, 61, 359_999, 360_000], text.clock, "long") == ["00:00:00", "00:01:01", "99:59:59", "100:00:00"]
    assert column(spark, ["[100:00:01] (en) x", "none"], text.clock_seconds) == [360_001, None]
    assert column(spark, ["30d", "d", None], text.parse_window) == [30, None, None]
    urls = ["HTTP://www.Ex.org/a/?utm_source=x&b=1#top", "https://m.ex.org/a?ref=q", "https://ex.org/a", "https://ex.org/?b=1&fbclid=2&c=3", None]
    assert column(spark, urls, text.canonical_url) == ["https://ex.org/a/?b=1", "https://ex.org/a", "https://ex.org/a", "https://ex.org/?b=1&c=3", ""]
    heads = spark.createDataFrame([("Site: News of (it)", "Site"), ("News - The Site", "the site"), ("News", None), ("a+b | c", "c")], "t string, s string")
    assert [r.h for r in heads.select(text.headline(F.col("t"), F.col("s")).alias("h")).collect()] == ["News of (it)", "News", "News", "a+b"]


def test_drop_repeat(spark):
    rows = [("this is Dr. Randy", "Randy Gallisdell from", "Gallisdell from"), ("a b c", "B, C. d", "d"), ("a", "a", ""), ("", "x y", "x y"), (None, "x", "x"), ("x y", "z", "z"), ("1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8 9 z", "1 2 3 4 5 6 7 8 9 z"), ("q 2 3 4 5 6 7 8 9", "2 3 4 5 6 7 8 9 z", "z")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, w string").select("i", "w", text.drop_repeat(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.g == r.w for r in got)


def test_time_phrases_with_nulls_and_endings(spark):
    asked = [("son 3 günde  gelen", "2026-08-19", "2026-08-22", "gelen"), ("bu yılki plan", "2026-01-01", "2026-12-31", "ki plan"), ("dünya haberleri", None, None, "dünya haberleri"), ("dün akşam", "2026-08-21", "2026-08-21", "akşam"), ("BU HAFTA olanlar", "2026-08-17", "2026-08-23", "olanlar"), (None, None, None, None), ("Şubat sonu", "2026-02-01", "2026-02-28", "sonu")]
    got = spark.createDataFrame([(i, a[0]) for i, a in enumerate(asked)], "i int, q string").select("i", timephrase.parse(F.col("q"), F.lit("2026-08-22").cast("date")).alias("t")).orderBy("i").collect()
    for r, (_, start, end, rest) in zip(got, asked, strict=True):
        assert (str(r.t.start) if r.t.start else None, str(r.t.end) if r.t.end else None, r.t.rest) == (start, end, rest)
    day = dt.date(2026, 3, 1)
    rows = spark.createDataFrame([(day, None), (None, day), (None, None), (dt.date(2026, 1, 1), day)], "m date, c date")
    lo, hi = F.lit("2026-02-20").cast("date"), F.lit("2026-03-01").cast("date")
    assert [r[0] for r in rows.select(timephrase.in_range(lo, hi, F.col("m"), F.col("c"))).collect()] == [True, True, False, True]


@pytest.mark.parametrize(
    ("said", "days", "relative", "parts", "numbers"),
    [
        ("bis Mittwoch, 16 Uhr", {2}, set(), set(), {16}),
        ("Salı günü saat 16.00", {1}, set(), set(), {16}),
        ("cumartesi ve pazartesiye kadar", {5, 0}, set(), set(), set()),
        ("Dünya dün bitti", set(), {-1}, set(), set()),
        ("Morgen beginnen wir am Morgen", set(), {1}, {0}, set()),
        ("bis morgen früh", set(), {1}, set(), set()),
        ("Donnerstagmorgen und abends", {3}, set(), {0, 3}, set()),
        ("öğleden sonra on dörtte", set(), set(), {2}, {14}),
        ("sabah ona kadar", set(), set(), {0}, {10}),
        ("bunu ona söyle", set(), set(), set(), set()),
        ("twenty five people, vierundzwanzig Leute", set(), set(), set(), {25, 5, 24}),
        ("altıda altında", set(), set(), set(), {6}),
        ("put it on the table", set(), set(), set(), {10}),
        ("in 2026 at 9:30 for 123", set(), set(), set(), {9}),
        ("", set(), set(), set(), set()),
        (None, set(), set(), set(), set()),
    ],
)
def test_facts(said, days, relative, parts, numbers):
    assert facts.read(said) == (days, relative, parts, numbers)


def test_same_and_repairs():
    assert facts.same("perşembe sabah 10'a", "Donnerstag, 10 Uhr")
    assert not facts.same("çarşamba öğlene", "Mittwoch") and not facts.same("Mittwoch", "Salı")
    assert facts.repair_clock("bis Mittwoch, 16 Uhr", "çarşamba günü 4'e kadar", "tr") == "çarşamba günü 16'ya kadar"
    assert facts.repair_day("am Mittwoch um 9", "Salı saat 9", "tr") == "Çarşamba saat 9"
    assert facts.repair_day("am Mittwoch", "pazartesiye", "tr") is None  # the ending would no longer fit
    assert facts.repair_day("am Dienstag", "cuma'ya", "tr") == "salı'ya"
    assert [facts.case_ending(n, c) for n, c in ((16, "dative"), (14, "locative"), (10, "ablative"), (13, "dative"), (20, "locative"), (23, "ablative"))] == ["ya", "te", "dan", "e", "de", "ten"]
    assert facts.accept("bis Mittwoch, 16 Uhr", "Salı günü 4'e kadar", "tr") == "Çarşamba günü 16'ya kadar"
    assert facts.accept("um 5", "saat 6", "tr", lambda: "saat 5") == "saat 5" and facts.accept("um 5", "saat 6", "tr") == ""

    def broken():
        raise OSError

    assert facts.accept("um 5", "saat 6", "tr", broken) == ""
    assert facts.unsaid("Cuma sabah 9'da, Montag 7", [facts.read("Montag um 7")]) == (["Cuma", "sabah", "öğleden önce"], [9])


def test_fact_columns(spark):
    values = ["Mittwochmittag, salıya 16:00 ve 7", "FRIDAY", "", None]
    assert column(spark, values, facts.weekdays) == [[1, 2], [], [], []]
    assert column(spark, values, facts.digit_numbers) == [[7, 16], [], [], []]
    got = column(spark, values, facts.facts)
    assert list(got[0].days) == [1, 2] and list(got[0].parts) == [1] and list(got[3].numbers) == []


def test_chunks_hold_every_sentence_and_carry_whole_ones(spark):
    rng = random.Random(1)
    for _ in range(60):
        said = [" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(1, 60))) + rng.choice([".", "!", ":"]) for _ in range(rng.randint(1, 40))]
        got = chunking.chunks(" ".join(said), 100, 20)
        if sum(len(s.split()) for s in said) <= 100:
            assert got == [" ".join(said)]
            continue
        places = [0]
        for chunk in got:
            n = next(n for n in range(1, len(said) + 1) for at in range(len(said)) if " ".join(said[at : at + n]) == chunk)
            at = next(at for at in range(len(said)) if " ".join(said[at : at + n]) == chunk)
            assert at <= places[-1]
            places.append(at + n)
        assert places[-1] == len(said)
    assert chunking.chunks(None) == [] and chunking.chunks("  ") == [] and chunking.chunks(" one\ntwo ") == ["one\ntwo"]
    assert column(spark, [None, "", "T"], lambda c: chunking.embed_context(c, F.lit("p"))) == ["p", "p", "T. p"]


def test_providers(spark):
    v = column(spark, ["a b", "a b", "", None], providers.embedding(lambda: providers.hashing_embedder(8)))
    assert v[0] == v[1] and len(v[2]) == 8 and v[2] == v[3]

    def picky():
        def embed(texts):
            if len(texts) > 1 or "bad" in texts[0]:
                raise ValueError
            return [[1.0]]

        return embed

    assert column(spark, ["ok", "bad", "ok"], providers.embedding(picky)) == [[1.0], None, [1.0]]
    say = providers.translation(lambda: providers.dictionary_translator({("de", "en"): {"hallo": "hello"}}))
    assert column(spark, ["Hallo du", None], lambda c: say(c, F.lit("de"), F.lit("en"))) == ["hello du", ""]
    assert column(spark, ["Hallo"], lambda c: say(c, F.lit("de"), F.lit("xx"))) == [""]

    def down(*_):
        raise OSError("no host")

    assert providers.first_answer(down, lambda x: x + 1)(1) == 2
    with pytest.raises(OSError):
        providers.first_answer(down, down)(1)
    p = spark.sql("SELECT map('tr', 0.2, 'de', 0.3, 'fr', 0.5) AS p")
    assert p.select(providers.allowed_language(F.col("p"), ["tr", "de", "en"])).first()[0] == "de"


def test_line_of_index_terms(spark):
    texts = ["Çay İçin ığüé-42 naïve", None, "", " ...a\n\tb_c  漢字 x́y 𝒜𝟙 Σας' ΑΣ'Α "]
    assert [x.split() for x in column(spark, texts, text.index_line)] == column(spark, texts, text.index_tokens)


def test_facts_of_repeated_and_null_texts(spark):
    texts = ["bis Montag, 14 Uhr", None, "", "dün öğleden sonra", "bis Montag, 14 Uhr"] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", facts.facts("t").alias("f"))
    got = [tuple(r.f) for r in rows.orderBy("i").collect()]
    assert got == [tuple(sorted(x) for x in facts.read(t)) for t in texts]
    assert rows.where("i < 0").collect() == []


def test_audit_writes_equal_lines_once(spark):
    """Notes held a line for every event before, however often it was the same."""
    plan = text_plans.unsaid_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(told" in plan and "collect_list" not in plan
