import glob
import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import facts, providers
from loomspan.operators import notes, transcript
from loomspan.plans import jobs, streams
from loomspan.sources import configs, files
from loomspan.streaming import captions, sinks


def texts(path, key):
    return {p.split(f"{key}=")[1].split("/")[0]: open(p, encoding="utf-8").read() for p in glob.glob(f"{path}/{key}=*/part*")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(3, "en", "late", True), (1, "tr", "bir", True), (2, "en", "draft", False)], "at int, lang string, said string, final boolean")
    said = []
    sinks.scroll(said.append)(rows, 0)
    assert said == ["[00:00:01] (tr) bir", "[00:00:03] (en) late"]

    screen = lambda *x: spark.createDataFrame(x, "stream string, place int, key string, text string, source string")
    current, window = str(tmp_path / "current"), str(tmp_path / "window")
    for take in (sinks.current(current, F.col("source"), F.col("text"), "one-line"), sinks.broadcast(window)):
        take(screen(("a", 1, "k", "one", "eins"), ("a", 2, "l", "two", "zwei"), ("b", 1, "m", None, "drei")), 0)
        take(screen(("a", 1, "l", "two", "zwei")), 1)
        take(screen(("a", 1, "l", "two", "zwei")), 1)  # a batch that comes again
    assert texts(current, "stream") == {"a": "zwei — two\n", "b": "drei\n"}
    assert {s: [x["key"] for x in json.loads(t)] for s, t in texts(window, "stream").items()} == {"a": ["l"], "b": ["m"]}

    frames = spark.createDataFrame([("a", 0, [0.5, -2.0])], "stream string, seq long, samples array<double>")
    passed = []
    sinks.tee(str(tmp_path / "tee"), lambda df, k: passed.append(df.collect()))(frames, 4)
    kept = spark.read.parquet(str(tmp_path / "tee")).first()
    assert list(kept.pcm) == [16383, -32767] and kept.batch == 4 and [list(r.samples) for r in passed[0]] == [[0.5, -2.0]]

    log = str(tmp_path / "log")
    for k in (0, 1, 1):
        sinks.append(log)(rows.select("said"), k)
    assert spark.read.json(log).count() == 2 * rows.count()


def test_language_lock_and_second_hearing(spark):
    rows = spark.createDataFrame([("s", 1, None, "a"), ("s", 2, "tr", "b"), ("s", 3, "en", "c"), ("t", 1, None, "d")], "session string, at int, lang string, said string")
    assert sorted((r.said, r.lang) for r in transcript.lock_language(rows, "session", "at").collect()) == [("a", "tr"), ("b", "tr"), ("c", "tr"), ("d", None)]
    again = F.struct(F.lit("C").alias("text"), F.lit("de").alias("lang"))
    assert sorted((r.said, r.lang) for r in transcript.heard_again(rows, "session", "at", again).where("at = 3").collect()) == [("C", "de")]


def test_captions_with_defaults(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    known = spark.createDataFrame([("a", "A", None)], "k string, name string, colour string")
    assert sorted(map(tuple, captions.described(rows, known, "k", name="?", colour="grey").collect())) == [("a", 1, "A", "grey"), ("b", 2, "?", "grey")]


def test_translators():
    asked, warned = [], []

    def load():
        asked.append("load")
        return lambda texts, a, b: [f"{b}:{t}" for t in texts]

    say = providers.by_sentence(load, {"de": "deu", "en": "eng"}, batch=1)
    with pytest.raises(ValueError, match="xx"):
        say("Hallo", "xx", "en")
    assert not asked
    assert say("- Hallo Dr. Weiß. Ja!  – Nein", "de", "en") == "eng:Hallo Dr. Weiß. eng:Ja! eng:Nein" and say(" ", "de", "en") == "" and asked == ["load"]

    def down(*_):
        raise OSError("down")

    ask = providers.with_fallback(down, lambda x: x + 1, warned.append)
    assert [ask(1), ask(2)] == [2, 3] and len(warned) == 1
    with pytest.raises(RuntimeError, match="no host"):
        providers.with_fallback(down, down, warned.append)(1)

    wrong, right = (lambda: lambda *_: "saat 6"), (lambda: lambda *_: "saat 5")
    assert providers.choose("llm", wrong, right)[1]()("um 5", "de", "tr") == "saat 5"
    assert providers.choose("llm", wrong, None)[1]()("um 5", "de", "tr") == "" and providers.choose("llm", wrong, None)[0] is None
    assert providers.choose("pairs", None, right)[1]()("um 5", "de", "tr") == "saat 5"
    assert providers.choose("llm", lambda: down, right)[1]()("um 5", "de", "tr") == "saat 5"
    with pytest.raises(ValueError):
        providers.choose("pairs", right, None)


def test_recognition(spark):
    def make():
        def listen(samples, prompt):
            if not samples:
                raise ValueError
            return f"{len(samples)} {prompt}", {"fr": 0.6, "de": 0.3, "tr": 0.1}

        return listen

    rows = spark.createDataFrame([(1, [0.1, 0.2], "p"), (2, [], None), (3, None, "p")], "id int, samples array<double>, prompt string")
    got = {r.id: tuple(r.h) for r in rows.select("id", providers.recognition(make, ["tr", "de"])("samples", "prompt").alias("h")).collect()}
    assert got == {1: ("2 p", "de"), 2: (None, None), 3: (None, None)}


def test_topics_file_and_file_order(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "topics.yaml"
    path.write_text("topics:\n  - name: a\n    enabled: true\n    audiences: [x, y]\n    retention_days: 90\n    freshness_window: 30d\n    ranking: {authority: 45, relevance: 55}\n    report: {format: markdown, email: false}\n  - name: b\n    enabled: false\n")
    got = {r.name: r for r in configs.topics_file(spark, str(path)).collect()}
    assert got["a"].audiences == ["x", "y"] and got["a"].ranking == {"authority": 45, "relevance": 55} and got["a"].report == "markdown" and got["a"].retention_days == 90
    assert not got["b"].enabled and got["b"].ranking is None
    for name in ("b.docx", "a.docx", "~$a.docx", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in files.in_order(files.scan(spark, str(tmp_path))).collect()] == ["a.docx", "b.docx"]


def test_stream_and_notes_jobs(spark, tmp_path):
    made = streams.made_frames(spark, 2, 400).where("seq < 150")
    frames, out = str(tmp_path / "frames"), str(tmp_path / "out")
    made.write.parquet(frames)
    jobs.listen(spark, frames, out, str(tmp_path / "log"), idle=None)
    assert spark.read.parquet(out).where("not final").count() > 0
    folder = tmp_path / "said"
    folder.mkdir()
    (folder / "one.txt").write_text("# started: t\n\n[00:00:01] (de) Am Montag um 9\n           (tr) Pazartesi 9'da\n[00:00:05] (tr) tamam\n", encoding="utf-8")
    (folder / "two.txt").write_text("", encoding="utf-8")
    amiss = jobs.minutes(spark, str(folder), str(tmp_path / "notes"), lambda: lambda prompt: "## Kararlar\n- Salı 9'da" if "Kararlar" in prompt and "Montag" in prompt else "")
    assert [tuple(r) for r in amiss.select("session", "words", "numbers").collect()] == [("one.txt", ["Salı"], [])]
    written = texts(str(tmp_path / "notes"), "session")
    assert written["one.txt"] == "## Kararlar\n- Salı 9'da\n"
    assert providers.extractive_notes()("[00:00:01] (de) Montag um 9\n[00:00:02] (tr) tamam") == "## Kararlar\n- Montag um 9"
    assert all(h in notes.INSTRUCTIONS for h in notes.HEADINGS)


def test_repairs_are_edits_on_marks():
    found = facts.marks("Salı günü 4'e kadar, yirmi üç kişi")
    assert [(m.kind, m.value) for m in found] == [("days", 1), ("numbers", 4), ("numbers", 23)]
    assert facts.edited("Salı 4'e", [(5, 6, "16"), (6, 8, "'ya"), (0, 4, "Cuma")]) == "Cuma 16'ya"
