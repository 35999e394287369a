import random
import re

from loomspan.llm import licenses as X

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def base(text):
    w = WORD.findall(low(text or ""))
    places, labels = [], set()
    for phrase, label in X.BASE.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def least_edits(phrase, text):
    """Sellers: fewest edits of the phrase against any part of the text."""
    row = list(range(len(phrase) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(phrase, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def garble(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        rng.choice([lambda: s.pop(i), lambda: s.insert(i, rng.choice("abc ")), lambda: s.__setitem__(i, rng.choice("xyz"))])()
    return "".join(s)


def test_against_brute_force(spark):
    rng = random.Random(8)
    notices = [p for _, _, p in X.NOTICES]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice([*notices, *X.BASE, "CC-BY", "All Rights, Reserved!", "General  Public\nLICENSE", "ünrelated text é", "the licence"])
            parts.append(garble(rng, p, rng.choice([0, 0, 1, 3, 5, 9])) if rng.random() < 0.7 else p)
        docs.append((i, rng.choice([" ", ". ", "\n"]).join(parts)))
    docs += [(500, None), (501, ""), (None, "cc by cc by"), (1, docs[1][1]), (502, "cc by " * 30_000), (503, "ccby cc byte occ by"), (504, "rights reserved all rights " * 3)]
    got = X.scan(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")).collect()
    assert len(got) == len(docs)
    rows = {(r.doc_id, r.n_words): r for r in got}
    for i, text in docs:
        want = base(text)
        r = rows[(i, want[0])]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if i is not None and i < 500:
            norm = " " + " ".join(WORD.findall(low(text))) + " "
            labels = {n[0] for n in X.NOTICES if least_edits(n[2], norm) <= X.errors(len(n[2]))}
            assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, want[4].split(",")))
    for r in got:
        for n in filter(None, r.notices.split(",")):
            label, a, b, edits = n.rsplit(":", 3)
            assert 0 <= int(a) < int(b)
    assert X.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_span_is_in_the_source():
    text = "Éa -- «Licensed under the Apche License, Version 2.0» x"
    out = X.Scanner().scan(text.encode())[-1]
    label, a, b, edits = out.split(":")
    assert (label, edits) == ("apache-2.0", "1") and text[int(a) : int(b)] == "Licensed under the Apche License, Version 2.0"


def test_a_garbled_notice_before_a_better_one():
    norm = " a genral public license and general public license b "
    i = next(i for i, n in enumerate(X.NOTICES) if n[2] == "general public license")
    assert [(norm[a:b].strip(), e) for a, b, n, e in X.Scanner().fuzzy(norm) if n == i] == [("genral public license", 1), ("general public license", 0)]
    assert len(X.Scanner().scan(b"All right reserved. All rights reserved. Al rights reserved.")[-1].split(",")) == 3


def test_spans_against_brute_force():
    rng = random.Random(11)
    scanner = X.Scanner()
    repeated = 0
    for _ in range(250):
        p = rng.choice([n[2] for n in X.NOTICES])
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += [garble(rng, p, rng.choice([0, 1, 1, 2, 3, 5])), *rng.choice([[], ["and"], ["some other words"], [p[: len(p) // 2]]])]
        norm = " " + " ".join(" ".join(parts).split()) + " "
        found = scanner.fuzzy(norm)
        for i, (_, _, phrase) in enumerate(X.NOTICES):
            most = X.errors(len(phrase))
            own = [(a, b, e) for a, b, n, e in found if n == i]
            repeated += len(own) > 1
            least = least_edits(phrase, norm)
            assert min((e for _, _, e in own), default=None) == (least if least <= most else None)
            pos = 0
            for a, b, e in [*own, (len(norm), len(norm), 0)]:
                # spans are apart, none is left between them, and edits are the least of their span
                assert pos <= a and (a - pos < len(phrase) - most or least_edits(phrase, norm[pos:a]) > most)
                assert a == b or least_edits(phrase, norm[a:b]) == e
                pos = b
    assert repeated > 100
