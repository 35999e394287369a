import random
import uuid

import pandas as pd
from pyspark.sql import functions as F

from loomspan.operators import transcript
from loomspan.plans import streams
from loomspan.streaming import captions, segments, state


def fold(rows, rule, flush=True):
    one = state.Utterances(None, rule)
    out = one.feed(pd.DataFrame(rows, columns=["stream", "seq", "speech", "power"]))
    return [tuple(o[k] for k in ("index", "version", "final", "at", "first", "last")) for o in out + (one.ended() if flush else [])]


def test_closed_form_and_fold_agree(spark):
    rng = random.Random(2)
    rows = []
    for stream in "abcdef":
        speech = False
        for seq in range(700):
            if rng.random() < (0.01 if speech else 0.05):
                speech = not speech
            rows.append((stream, seq, speech, 0.0 if rng.random() < 0.3 or stream == "f" and seq > 300 else 0.01))
    frames = spark.createDataFrame(rows, "stream string, seq long, speech boolean, power double")
    for rule in (segments.Rule(), segments.Rule(20, 4, 6, 3), segments.Rule(20, 4, 0, 0)):
        got = segments.intervals(frames, rule).collect()
        for stream in "abcdef":
            want = fold([r for r in rows if r[0] == stream], rule)
            assert sorted((r["index"], r["version"], r["final"], r["at"], r["first"], r["last"]) for r in got if r["stream"] == stream) == sorted(want)


def test_what_falls_due_is_what_the_closed_form_lists():
    """All showings of a segment of any length, by the lengths at which they come."""
    for rule in (segments.Rule(), segments.Rule(20, 4, 6, 3), segments.Rule(9, 8, 2, 0), segments.Rule(20, 0, 0, 0)):
        step = rule.longest - rule.carry
        for length in range(1, 5 * rule.longest):
            want, no = [], 0
            while True:
                start, end = no * step, min(no * step + rule.longest, length)
                drafts = rule.drafts(rule.carry if no else 0)
                want += [(start, start + n, v, False) for v, n in enumerate(drafts) if n <= end - start]
                last = length < no * step + rule.longest
                want.append((start, end, sum(n <= end - start for n in drafts), True))
                if last:
                    break
                no += 1
            got = [(n - back, n, v, final) for n in range(1, length + 1) for v, final, back in segments.due(n, rule)]
            version, final, back = segments.rest(length, rule)
            got.append((length - back, length, version, final))
            assert sorted(x for x in got if x[0] < x[1]) == sorted(x for x in want if x[0] < x[1])


def test_end_of_a_stream_and_idle_streams(spark, tmp_path):
    """An end mark closes what is open; so does a time without rows, and the state goes with it."""
    made = streams.made_frames(spark, 2, 400).where("seq < 90")
    mark = spark.createDataFrame([("0", None, None, None)], "stream string, seq long, speech boolean, power double")
    later = made.where("stream = '1' and seq < 0").unionByName(spark.createDataFrame([("9", 0, False, 0.0)], "stream string, seq long, speech boolean, power double"))
    source, out = str(tmp_path / "frames"), str(tmp_path / "out")
    for part in (made.where("stream = '0'").unionByName(mark), made.where("stream = '1'"), later):
        part.coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(source)
    state.drain(spark, state.run(rows, state.Utterances, state.UTTERANCE, idle=0), str(tmp_path / "log"), lambda df, k: df.write.mode("append").parquet(out))
    got = [tuple(r) for r in spark.read.parquet(out).where("final").select("stream", "first", "last").collect()]
    assert sorted(got) == [("0", 11, 89), ("1", 11, 89)]


def test_lengths_of_the_rule():
    rule = segments.Rule()
    assert (rule.longest, rule.carry, rule.drafts(0), rule.drafts(rule.carry)) == (188, 10, [63, 126], [73, 136])


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "frames")
    made = streams.made_frames(spark, 2, 400)
    made.where("seq < 150").coalesce(1).write.parquet(source)
    made.where("seq >= 150").coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    out = str(tmp_path / f"out-{uuid.uuid4().hex}")
    state.drain(spark, state.run(rows, state.Utterances, state.UTTERANCE), str(tmp_path / "log"), lambda df, k: df.write.mode("append").parquet(out))
    got = sorted((r["stream"], r["index"], r["version"], r["final"], r["first"], r["last"]) for r in spark.read.parquet(out).collect())
    want = []
    for stream in "01":
        own = sorted((r.stream, r.seq, r.speech, r.power) for r in made.where(F.col("stream") == stream).collect())
        want += [(stream, x[0], x[1], x[2], x[4], x[5]) for x in fold(own, segments.Rule(), flush=False)]
    assert got == sorted(want) and got


def test_screen():
    s = captions.Screen(lines=2, dwell=1.5)
    s.show("a", "one", 0.0, "src")
    s.show("a", "two", 0.5, "new")  # too soon: waits with its source
    assert s.visible(1.0) == [("a", "one", "src")] and s.visible(1.6) == [("a", "two", "new")]
    s.show("a", "three", 1.7)
    assert s.visible(1.7) == [("a", "three", "new")]
    s.show("b", "x", 2.0)
    s.show("b", "y", 2.1)
    s.show("b", "x", 2.2)  # back to what is shown: nothing waits
    assert s.visible(9.0)[1][1] == "x"
    s.show("b", "z", 9.0)
    s.show("c", "c", 9.1)
    assert [r[0] for r in s.visible(9.1)] == ["b", "c"]
    r = captions.Screen(lines=5, retain=30.0)
    r.show("a", "1", 0.0)
    r.show("b", "2", 20.0)
    assert [x[0] for x in r.visible(31.0)] == ["b"] and len(r.rows) <= 5


def test_stream_captions_equal_a_plain_screen(spark):
    sf = "/root/testdata/sf0.001"
    screens = {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").select("user_id", segments.seconds_of(F.col("ts")).alias("now"), "event_type", F.col("value").cast("string").alias("v")).collect(), key=lambda r: (r.now, r.event_type)):
        s = screens.setdefault(str(r.user_id), captions.Screen())
        s.show(r.event_type, r.v, r.now)
        s.last = r.now
    want = [(u, i, k, t) for u, s in screens.items() for i, (k, t, _) in enumerate(s.visible(s.last), 1)]
    assert sorted(map(tuple, streams.stream_captions(spark, sf).collect())) == sorted(want)


def test_transcript_round_trip_and_gaps(spark):
    lines = ["# a: transcript", "# started: 2026-08-22 10:00:00", "# languages: tr, en", "", "           (en) no entry above", "[00:00:01] (tr) bir", "           (en) one", "           (de) eins", "junk", "[00:00:09] (??) lost", "[100:00:00] (en) x (y) z"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, line_no int, line string")
    got = transcript.parse(df).orderBy("at").collect()
    assert [tuple(r) for r in got] == [("s", 1, "tr", "bir", "de", "eins"), ("s", 360_000, "en", "x (y) z", None, None)]
    assert transcript.read_header(df).first().header == {"started": "2026-08-22 10:00:00", "languages": "tr, en"}
    both = transcript.as_prompt(transcript.parse(df), translations=True).first().prompt
    assert both == "[00:00:01] (tr) bir\n           (de) eins\n[100:00:00] (en) x (y) z"
    assert transcript.header("t", ["tr", "en"]).startswith("# started: t\n# languages: tr, en\n")
    shown = spark.createDataFrame([("said", "told"), ("said", None)], "a string, b string")
    for style, want in {"both": ["said\ntold", "said"], "one-line": ["said — told", "said"], "translation": ["told", "said"], "original": ["said", "said"]}.items():
        assert [r[0] for r in shown.select(transcript.caption_line(F.col("a"), F.col("b"), style)).collect()] == want
