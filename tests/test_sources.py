import datetime as dt
import json

from pyspark.sql import functions as F

from loomspan.sources import collect, configs, files, fixtures, frames


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    (root / "a.docx").write_bytes(fixtures.docx([("", "before"), ("Heading1", "One"), ("", "x "), ("", ""), ("", "y"), ("Heading1", ""), ("Title", "Two")], [[["a", "a", "b"], ["", " ", ""]], [[""]], [["c"]]], author=" Me ", title="T", created="2026-08-12T10:00:00Z"))
    (root / "deep/B.PPTX").write_bytes(fixtures.pptx([("Head", ["one\ntwo", " "], "say it"), ("", [], ""), ("", ["body"], "")]))
    topic = {"title": "root", "notes": {"plain": {"content": "hidden"}}, "children": {"attached": [{"title": "A", "labels": ["l"], "notes": {"realHTML": {"content": "<b>n</b>"}}, "children": {"summary": [{"title": "s"}], "attached": [{"title": "k"}]}}, {"title": "B"}]}}
    (root / "m.xmind").write_bytes(fixtures.xmind_json([{"title": "S", "rootTopic": topic}, {"rootTopic": {"title": "alone"}}], "Ann"))
    (root / "o.xmind").write_bytes(fixtures.xmind_xml("<sheet><topic><title>r</title><notes><plain>p</plain></notes><children><topics type='attached'><topic><title>c</title></topic></topics></children></topic></sheet>"))
    (root / "~$a.docx").write_bytes(b"lock")
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "note.txt").write_bytes(b"x")
    docs = files.documents(files.scan(spark, str(root))).cache()
    by = {r["name"]: r for r in docs.collect()}
    assert set(by) == {"a.docx", "B.PPTX", "m.xmind", "o.xmind", "bad.docx"}
    assert by["bad.docx"].error.startswith("BadZipFile") and by["bad.docx"].units == []
    a = by["a.docx"]
    assert (a.author, a.title, a.created, a.modified is not None) == ("Me", "T", dt.datetime(2026, 8, 12, 10), True)
    assert [(u.unit_id, u.text) for u in a.units] == [("Bölüm: (başlıksız)", "before"), ("Bölüm: One", "One\nx\ny"), ("Bölüm: Two", "Two"), ("Tablo 1", "a | b"), ("Tablo 3", "c")]
    assert [(u.unit_id, u.heading, u.text, u.extra["has_notes"]) for u in by["B.PPTX"].units] == [("Slayt 1", "Head", "Head\none\ntwo\nNotlar: say it", "true"), ("Slayt 3", "", "body", "false")]
    assert [(u.unit_id, u.text) for u in by["m.xmind"].units] == [("Harita: S / A", "root\nA\n[Not: n]\n[Etiket: l]\n  k\n  s"), ("Harita: S / B", "root\nB"), ("Harita: alone", "alone")]
    assert by["m.xmind"].author == "Ann" and by["m.xmind"].title == "root"
    assert [(u.unit_id, u.text) for u in by["o.xmind"].units] == [("Harita: r", "r\n[Not: p]\n  c")]
    assert files.units(docs).where("pos = 0").count() == 4


def test_configs(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"sources": [{"name": "n", "handle": "@n", "lane": "news", "enabled": True}]}))
    (tmp_path / "p.json").write_text(json.dumps({"publications": [{"key": "k", "target_items": 6, "feeds": [["tr", "l", "p"]], "theme": {"a": "b"}}]}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "f.opml").write_text('<opml><body><outline text="G"><outline text="x" xmlUrl="u" htmlUrl="h"/></outline></body></opml>')
    (tmp_path / "c.json").write_text(json.dumps([{"query": "q", "expect": "e", "today": "2026-08-22"}, {"query": "r", "expect": "e"}]))
    assert configs.video_sources(spark, str(tmp_path / "v.json")).first().lane == "news"
    p = configs.publications(spark, str(tmp_path / "p.json")).first()
    assert p.target_items == 6 and p.theme == {"a": "b"} and p.feeds == [["tr", "l", "p"]]
    assert configs.publications(spark, str(tmp_path / "broken.json")).count() == 0
    assert tuple(configs.feeds(spark, str(tmp_path / "f.opml")).first()) == ("G", "x", "u", "h")
    assert [r.today for r in configs.cases(spark, str(tmp_path / "c.json")).orderBy("query").collect()] == [dt.date(2026, 8, 22), None]
    assert [tuple(r) for r in configs.glossary(spark, "yayın = Veröffentlichung\n\nno term").collect()] == [("yayın", "Veröffentlichung")]
    t = configs.topics(spark, [{"name": "a", "enabled": True, "ranking": {"authority": 60, "freshness": 40}}]).first()
    assert t.ranking == {"authority": 60, "freshness": 40} and t.audiences is None


def test_frames(spark):
    s = spark.createDataFrame([(1, [0.0] * 1025), (2, [2.0] * 511), (3, [])], "i int, s array<double>")
    assert [r.n for r in s.select(F.size(frames.frames(F.col("s"))).alias("n")).collect()] == [2, 0, 0]
    one = s.where("i = 2").select(frames.rms(F.col("s")).alias("r"), frames.is_silent(F.col("s")).alias("q"), F.element_at(frames.pcm16(F.col("s")), 1).alias("p")).first()
    assert tuple(one) == (2.0, False, 32767)
    assert spark.sql("SELECT array(array(1.0D, 3.0D), array(3.0D, 5.0D)) AS c").select(frames.mono(F.col("c"))).first()[0] == [2.0, 4.0]


def test_collect_isolates_sources(spark):
    def fetch(source):
        import time

        if source == "bad":
            raise ValueError("no")
        if source == "slow":
            time.sleep(20)
        return [{"url": "u", "title": "t", "lang": "en"}] * 2

    items = collect.collect(spark.createDataFrame([("good",), ("bad",), ("slow",)], "source string"), fetch, 3.0).collect()
    assert sorted((r.source, r.error) for r in items) == sorted([("good", None), ("good", None), ("bad", "ValueError: no"), ("slow", "timed out")], key=str)
    pool = collect.pool(spark.createDataFrame([tuple(r) for r in items if r.source != "slow"], collect.ITEM)).collect()
    assert [(r.source, r.url) for r in pool] == [("good", "u")]
