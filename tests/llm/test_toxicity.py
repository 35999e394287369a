import itertools
import random
import zlib

import pytest

from loomspan.llm import toxicity as T

MODEL = T.Model()


def corpus(n, seed=4):
    rng = random.Random(seed)
    syllables = ["an", "er", "tho", "ing", "la", "que", "ment", "sch", "ung", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["grolm", "grolmel", "grolmung", "zzipf"]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "", "ti", "ung"]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_readings():
    plain, aimed = MODEL.evidence("What an idiot."), MODEL.evidence("You idiot.")
    negated, reported = MODEL.evidence("You are not an idiot."), MODEL.evidence('He said "you idiot"')
    threat = MODEL.evidence("I will kill you.")
    assert [T.READINGS[e.argmax()] for e in (plain, aimed, negated, reported, threat)] == ["plain", "aimed", "negated", "reported", "threat"]
    assert MODEL.evidence("They kill time") is None and MODEL.evidence("") is None and MODEL.evidence(None) is None
    assert MODEL.score("You are not an idiot.") < T.THRESHOLD <= MODEL.score("You stupid idiot, you are worthless!")
    assert MODEL.score('She said "he is not stupid".') < MODEL.score("He is stupid.")


def test_learns_words_and_stems_and_holds_on_unseen_rows(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "grolm grolm", ""), (5000, None, ""), (5001, "", ""), (5002, "an er tho " * 60_000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (7, None, 1), (9999, 1, 1), (3, rows[3][2], 1)], "doc_id long, toxic int, quality int")
    model = T.train(docs, labels)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for _, p, y in held) >= 0.95 * len(held) > 200
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= T.THRESHOLD)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = T.reject(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_held_out_labels_are_never_read(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    models = [T.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in rows], flipped)]
    assert models[0].weights == pytest.approx(models[1].weights) and models[0].words == models[1].words


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(docs, T.train(docs, labels)).count() == 0


@pytest.mark.parametrize("insult", ["“idiot”", "idiot—", "idiot…", "«idiot»", "idiot’s", "—idiot–", "‘idiot’", "idiot\u00a0", "_idiot_", "idiot\u2028", "crétin»"])
def test_typographic_signs_do_not_hide_a_cue(insult):
    assert MODEL.evidence(f"You {insult} there.") is not None
    assert MODEL.score(f"You {insult} and {insult}, you are {insult}") >= T.THRESHOLD
    assert MODEL.evidence(f"I will “kill” you {insult}")[T.READINGS.index("threat")] > 0


def plain_readings(tags):
    """Readings by looking back and ahead from each place, without states."""
    out = []
    for i, t in enumerate(tags):
        near = any(x == T.TARGET for x in tags[max(0, i - 4) : i] + tags[i + 1 : i + 5])
        negated = T.NEGATION in tags[max(0, i - 3) : i]
        reported, quoted = T.REPORT in tags[:i], tags[:i].count(T.MARK) % 2 == 1
        if t == T.INSULT:
            out.append((i, 2 if negated else 3 if reported and (quoted or near) else 1 if near else 0, 1.0))
        elif t == T.THREAT and T.MODAL in tags[:i] and T.TARGET in tags[i + 1 : i + 4]:
            out.append((i, 2 if negated else 3 if reported else 4, 4.0))
    return out


def test_composition_against_enumeration():
    """Every string of up to five tags, and longer ones at random: the composed transducer, its
    parts in a row, and the plain definition agree."""
    rng = random.Random(3)
    strings = [list(s) for n in range(6) for s in itertools.product(T.TAGS, repeat=n)]
    strings += [[rng.choice(T.TAGS) for _ in range(rng.randint(6, 30))] for _ in range(3_000)]
    for tags in strings:
        assert T.readings(tags) == plain_readings(tags)
    for tags in strings[-500:]:
        tape, weights = [*reversed(T.AHEAD.run(reversed(tags))[0])], [1.0] * len(tags)
        whole = T.GRAMMAR.run(tape)
        for part in (T.BEHIND, T.NEGATED, T.REPORTED, T.POSSIBLE, T.READ):
            tape, w = part.run(tape)
            weights = [a * b for a, b in zip(weights, w, strict=True)]
        assert (tape, weights) == whole
    assert len(T.GRAMMAR.arcs) > 100


@pytest.mark.parametrize(
    ("short", "full"),
    [("you aren't an idiot", "you are not an idiot"), ("I'll kill you", "I will kill you"), ("you’re not an idiot", "you are not an idiot"), ("you're an idiot", "you are an idiot"), ("I won't kill you", "I will not kill you"), ("he'd hurt them", "he would hurt them"), ("they isn’t scum", "they is not scum"), ("you can't kill him", "you can not kill him"), ("the idiot's hat", "the idiot hat")],
)
def test_contractions_score_as_what_they_stand_for(short, full):
    assert T._TOKEN.findall(T.normal(short)) == T._TOKEN.findall(full.lower())
    a, b = MODEL.evidence(short), MODEL.evidence(full)
    assert (a is None and b is None) or a.tolist() == b.tolist()


def test_one_insult_weighs_less_in_a_long_text():
    short, long = "You idiot. " + "fine words here " * 5, "You idiot. " + "fine words here " * 20_000
    assert MODEL.score("fine words here") < MODEL.score(long) < MODEL.score(short)


def test_repeated_ids_with_different_texts_teach_the_same(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, "zz " + t[::-1]) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = T.train(docs, labels), T.train(docs.repartition(9).orderBy("text"), labels)
    assert (a.words, a.stems, a.weights) == (b.words, b.stems, b.weights)


def test_gate_agrees_with_the_grammar():
    rng = random.Random(6)
    bits = ["you", "idiot", "kill", "will", "grolm", "crétin", "é", "—", "…", "“", "”", "«", "»", "’", "\u0301", "_", "4", "²", " ", " ", ".", "n't", "'ll", "İ", "ſ", "K"]
    model = T.Model({**T.SEEDS, "crétin": 4.0}, {"grol": 2.0})
    hits = 0
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        total = [0.0] * len(T.READINGS)
        for clause in T._CLAUSE.split(T.normal(text)):
            for reading, weight in model.clause(T._TOKEN.findall(clause)):
                total[reading] += weight
        got = model.evidence(text)
        assert (got is None and not any(total)) or (got is not None and got.tolist() == total)
        hits += got is not None
    assert 100 < hits < 19_900
