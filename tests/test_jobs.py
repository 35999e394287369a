import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomspan.functions import facts
from loomspan.operators import notes
from loomspan.plans import jobs
from loomspan.sources import fixtures


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    put = lambda name, day, *lines: (root / name).write_bytes(fixtures.docx([("Heading1", lines[0]), *(("", x) for x in lines[1:])], title=lines[0], created=f"{day}T10:00:00Z", modified=f"{day}T10:00:00Z"))
    put("fatura.docx", "2026-08-03", "Gecikmiş fatura", "Fatura 2026-0417 henüz ödenmedi.")
    put("toplanti.docx", "2026-08-12", "Toplantı notları", "Proje planı konuşuldu.")
    put("izin.docx", "2026-08-21", "İzin dilekçesi", "Yıllık izin talebi.")
    (root / "bad.docx").write_bytes(b"x")
    return root


def test_index_search_validate(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    assert jobs.build(spark, str(folder), index) == {"docs": 3, "chunks": 3, "skipped": 1}
    today = dt.date(2026, 8, 22)
    asked = spark.createDataFrame([(1, "fatura 2026-0417", today), (2, "dün gelen dilekçe", today), (3, "geçen haftaki toplantı notları", today), (4, "dün", today)], "query_id long, query string, today date")
    got = jobs.search(jobs.read(spark, index), asked).orderBy("query_id", "place").collect()
    first = {r.query_id: r for r in got if r.place == 1}
    assert {q: r["name"] for q, r in first.items()} == {1: "fatura.docx", 2: "izin.docx", 3: "toplanti.docx", 4: "izin.docx"}
    assert first[1].keyword_hit and not first[3].keyword_hit and first[2].modified == "2026-08-21" and "\n" not in first[1].snippet
    assert [sum(r.query_id == q for r in got) for q in (1, 2, 3, 4)] == [3, 1, 1, 1]
    cases = spark.createDataFrame([("2026-0417", "fatura", today), ("dün dilekçe", "nothing", today)], "query string, expect string, today date")
    m = jobs.validate(jobs.read(spark, index), cases)[0].first()
    assert (m.n, m.p_at_1, m.mrr) == (2, 0.5, 0.5)
    # changed, emptied and vanished files
    (folder / "fatura.docx").write_bytes(fixtures.docx([("Heading1", "Yeni"), ("", "başka metin"), ("Heading1", "Daha"), ("", "bir")]))
    (folder / "izin.docx").write_bytes(fixtures.docx([]))
    (folder / "toplanti.docx").unlink()
    assert jobs.build(spark, str(folder), index) == {"docs": 3, "chunks": 3, "skipped": 1}
    texts = {r.text for r in jobs.read(spark, index)["chunks"].collect()}
    assert texts == {"Yeni\nbaşka metin", "Daha\nbir", "Toplantı notları\nProje planı konuşuldu."}
    assert jobs.build(spark, str(folder), index, prune=True) == {"docs": 2, "chunks": 2, "skipped": 1}
    assert jobs.read(spark, index)["postings"].where("term = 'proje'").count() == 0
    with pytest.raises(ValueError):
        jobs.read(spark, str(tmp_path / "none"))


def test_notes(spark, tmp_path):
    rows = [
        ("s", 1, "tr", "Salı 5'te buluşalım", "en", "Tuesday at 5"), ("s", 2, "de", "bis Mittwoch, 16 Uhr", None, None),
        ("s", 3, "de", "am Freitag", "tr", "perşembe"), ("s", 4, "en", "all good", "tr", "her şey yolunda"), ("s", 5, "de", "um 9", "tr", "saat 8"),
    ]
    entries = spark.createDataFrame(rows, "session string, at int, said_lang string, said string, other_lang string, translation string")

    def translator():
        def say(text, source, target):
            if text == "um 9":
                raise RuntimeError
            return {"bis Mittwoch, 16 Uhr": "çarşamba günü 4'e kadar", "am Freitag": "cuma günü"}[text]

        return say

    filled = notes.fill_gaps(entries, translator)
    assert {r["at"]: r.translation for r in filled.collect()} == {1: "Tuesday at 5", 2: "çarşamba günü 16'ya kadar", 3: "cuma günü", 4: "her şey yolunda", 5: "saat 8"}
    prompt = notes.prompt(filled).first().prompt
    assert "(tr) çarşamba günü 16'ya kadar" in prompt and "saat 8" not in prompt and "Tuesday at 5" not in prompt and prompt.startswith("[00:00:01] (tr) Salı")
    written = notes.write(notes.prompt(filled).unionByName(spark.createDataFrame([("empty", "")], "session string, prompt string")), lambda: lambda p: " Cuma 7'de ")
    assert {r.session: r.notes for r in written.collect()} == {"s": "Cuma 7'de", "empty": notes.EMPTY}
    found = {r.session: (list(r.words), list(r.numbers)) for r in notes.audit(written, entries).collect()}
    assert found == {"s": ([], [7]), "empty": ([], [])}
    asked = spark.range(1).select(notes.translation_prompt(F.lit("Hallo"), "English", F.lit("German"), "a = b", F.lit("(de) x")), notes.translation_prompt(F.lit("Hallo"), "English")).first()
    assert asked[0].split("\n\n") == ["Meeting glossary:\na = b", "Earlier in this meeting (context only, do not translate):\n(de) x", "Translate this German subtitle line to English:", "Hallo"] and asked[1].startswith("Translate this subtitle line")
    flags = notes.translation_flags(spark.createDataFrame([("um 9", "at 9 " + "x" * 300), ("um 9", "at 8.")], "a string, b string"), "a", "b").collect()
    assert [(r.changed, r.too_long) for r in flags] == [(False, True), (True, False)]
    assert facts.accept("a", "b", "tr") == "b"
    shown = entries.withColumn("final", F.col("at") != 4)
    jobs.record(shown, str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log/session=s")).collect() if r.value]
    assert len(lines) == 4 + 3 and not any("all good" in x for x in lines)
