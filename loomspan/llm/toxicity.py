"""Toxicity by a weighted finite-state pattern grammar.

A lexicon tags words (insult, threat verb, modal, target, negation, report, quotation mark).
Small transducers over these tags each add one thing to a tag: whether a target follows (read
from the clause's end) or went before, whether a negation is in force, whether the clause is
reported or quoted, whether a modal made threats possible. A last one gives each insult or
threat the reading it stands in (plain, aimed, negated, reported, threat) and the arc's weight.
:func:`compose` makes one transducer of them; a clause is scored by its one path through it, so
words count as parts of matched clauses only. Contractions are written out before the words are
tagged ("aren't" is "are not", "I'll" is "I will").

Evidence by reading, and how dense it is in the text, goes through a logistic layer. Trained on
labelled rows outside the held-out third: insult words and word stems are chosen by a greedy
cover of the toxic texts (near copies count once, cues must be pure), their weights are log
odds, and the logistic layer is fitted with a ridge towards set priors. Training reads at most
``TRAIN_ROWS`` rows of either label, chosen by a hash of the id, of which one task takes the
distinct words and later the evidence, never the texts; everything else covers all rows.
Labels, lang, source and ids are never inputs of a score.

Rows: null and empty texts match nothing and get the base score. Labels that are null, have no
document or repeat (the larger counts) do no harm; of documents that share an id the least text
teaches; with one label missing the priors stand.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import Scratch

TRAIN_ROWS = 1500
THRESHOLD = 0.7
#: Each toxic training text is to be covered so many times; a cue must add so many texts, and
#: so large a share of them.
COVER, LEAST_NEW, LEAST_SHARE = 3, 4, 0.01
STEMS = range(4, 9)
SEEDS = dict.fromkeys("idiot idiots moron morons scum stupid loser losers pathetic worthless disgusting trash clown imbecile dumbass bastard asshole bitch retard retarded vermin scumbag idiota imbécil estúpido abschaum dummkopf trottel arschloch connard abruti crétin".split(), 4.0)
THREATS = frozenset("kill murder hurt destroy beat strangle shoot stab burn hang töten umbringen schlagen tuer frapper matar golpear".split())
MODALS = frozenset("will would gonna shall must should werde werden vais va voy deserve deserves".split())
TARGETS = frozenset("you your youre yourself u ya he she they them him her du dich dir euch ihr tu toi vous usted vosotros tú".split())
NEGATIONS = frozenset("not never isnt arent wasnt werent dont doesnt didnt wont cant nobody neither nor nicht kein keine keinen niemals nie pas jamais aucun aucune nunca jamás".split())
REPORTS = frozenset("said says say called calls wrote writes claimed claims quoted quote allegedly shouted sagte nannte schrieb dit disait appelé dijo llamó escribió".split())
MARKS = frozenset("\"“”«»")
READINGS = ("plain", "aimed", "negated", "reported", "threat")
#: Readings that count for how dense a text is with evidence.
MEANT = np.array([1.0, 1.0, 0.0, 0.0, 1.0])
#: Bias, a weight for each reading, and one for the density.
PRIOR = np.array([-3.5, 2.0, 2.4, 0.5, 0.6, 2.4, 0.3])
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»]")
_CONTRACTED = re.compile(r"(?<=[^\W\d_])(n?)['’ʼ](t|ll|re|ve|[msd])\b")
_FULL = {"ll": " will", "re": " are", "ve": " have", "m": " am", "s": "", "d": " would"}
#: What is left of a verb before "not".
_STUMPS = {stump: (re.compile(rf"\b{stump}\b"), verb) for stump, verb in (("wo not", "will not"), ("ca not", "can not"), ("sha not", "shall not"))}


def normal(text: str) -> str:
    """Lower case, contractions written out."""
    low = text.lower()
    if "'" not in low and "’" not in low and "ʼ" not in low:
        return low

    low = _CONTRACTED.sub(lambda m: " not" if m[1] and m[2] == "t" else m[1] + _FULL.get(m[2], " " + m[2]), low)
    for stump, (pattern, verb) in _STUMPS.items():
        if stump in low:
            low = pattern.sub(verb, low)
    return low


# --- the grammar ----------------------------------------------------------------------------

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, MARK = TAGS = range(8)
#: Reach of a target to either side of an insult, of a threat to its target, and of a negation.
NEAR, STRIKE, SCOPE = 4, 3, 3
THREAT_WEIGHT = 4.0


@dataclass
class Transducer:
    """States with one arc for each input symbol: (next state, output symbol, weight)."""

    arcs: list[dict[Hashable, tuple[int, Hashable, float]]]

    def run(self, symbols: Iterable[Hashable]) -> tuple[list[Hashable], list[float]]:
        state, out, weights = 0, [], []
        for s in symbols:
            state, o, w = self.arcs[state][s]
            out.append(o)
            weights.append(w)
        return out, weights

    def outputs(self) -> set[Hashable]:
        return {o for arcs in self.arcs for _, o, _ in arcs.values()}


def machine(start: Hashable, alphabet: Iterable[Hashable], step: Callable) -> Transducer:
    """The states that ``step`` (state, symbol) -> (state, output, weight) reaches from ``start``."""
    alphabet, number, todo, arcs = [*alphabet], {start: 0}, [start], []
    for state in todo:  # grows while it is read
        own = {}
        for symbol in alphabet:
            after, out, weight = step(state, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            own[symbol] = (number[after], out, weight)
        arcs.append(own)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds the output of ``first`` to ``second``; weights multiply."""

    def step(state: tuple[int, int], symbol: Hashable) -> tuple:
        a, middle, v = first.arcs[state[0]][symbol]
        b, out, w = second.arcs[state[1]][middle]
        return (a, b), out, v * w

    return machine((0, 0), first.arcs[0], step)


def _away(state: int, tag: int) -> int:
    """Steps from the last target, 0 for none within reach."""
    return 1 if tag == TARGET else state + 1 if 0 < state < NEAR else 0


#: Read from the clause's end: adds how far ahead a target is (0: none, 1: within a threat's
#: reach, 2: within an insult's).
AHEAD = machine(0, TAGS, lambda s, tag: (_away(s, tag), (tag, 0 if not s else 1 if s <= STRIKE else 2), 1.0))
#: Adds whether a target went before within reach.
BEHIND = machine(0, sorted(AHEAD.outputs()), lambda s, x: (_away(s, x[0]), (*x, s > 0), 1.0))
#: Adds whether a negation is in force.
NEGATED = machine(0, sorted(BEHIND.outputs()), lambda s, x: (SCOPE if x[0] == NEGATION else max(0, s - 1), (*x, s > 0), 1.0))
#: Adds whether a word of report went before, and whether a quotation is open.
REPORTED = machine((False, False), sorted(NEGATED.outputs()), lambda s, x: ((s[0] or x[0] == REPORT, s[1] != (x[0] == MARK)), (*x, *s), 1.0))
#: Adds whether a modal went before.
POSSIBLE = machine(False, sorted(REPORTED.outputs()), lambda s, x: (s or x[0] == MODAL, (*x, s), 1.0))


def _reading(state: int, x: tuple) -> tuple[int, int, float]:
    tag, ahead, behind, negated, reported, quoted, possible = x
    if tag == INSULT:
        near = behind or ahead > 0
        return 0, 2 if negated else 3 if reported and (quoted or near) else int(near), 1.0
    if tag == THREAT and possible and ahead == 1:
        return 0, 2 if negated else 3 if reported else 4, THREAT_WEIGHT
    return 0, -1, 0.0


#: Gives insults and threats their reading and weight.
READ = machine(0, sorted(POSSIBLE.outputs()), _reading)
GRAMMAR = reduce(compose, (BEHIND, NEGATED, REPORTED, POSSIBLE, READ))
_CLOSED = {w: tag for words, tag in ((TARGETS, TARGET), (MARKS, MARK), (MODALS, MODAL), (REPORTS, REPORT), (NEGATIONS, NEGATION)) for w in words}


def readings(tags: list[int]) -> list[tuple[int, int, float]]:
    """(place, reading, weight) of a clause's insults and threats."""
    ahead, _ = AHEAD.run(reversed(tags))
    found, weights = GRAMMAR.run(reversed(ahead))
    return [(i, r, w) for i, (r, w) in enumerate(zip(found, weights, strict=True)) if r >= 0]


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=lambda: dict(SEEDS))
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: PRIOR.tolist())

    def __post_init__(self):
        self._lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self._memo: dict[bytes | str, tuple[int, float]] = {}

    def tag(self, word: bytes | str) -> tuple[int, float]:
        """The lexicon: (tag, weight of an insult)."""
        got = self._memo.get(word)
        if got is None:
            if len(self._memo) > 400_000:
                self._memo.clear()
            w = word if isinstance(word, str) else word.decode()
            closed = _CLOSED.get(w)
            if closed is not None:
                got = (closed, 0.0)
            else:
                weight = max([self.words.get(w, 0.0), *(self.stems.get(w[:n], 0.0) for n in self._lengths if len(w) >= n)])
                got = (INSULT, weight) if weight else (THREAT if w in THREATS else OTHER, 0.0)
            self._memo[word] = got
        return got

    def clause(self, tokens: list[str]) -> list[tuple[int, float]]:
        """(reading, weight) of what the grammar finds in a clause."""
        tagged = [*map(self.tag, tokens)]
        tags = [t for t, _ in tagged]
        if INSULT not in tags and THREAT not in tags:
            return []
        return [(r, w * (tagged[i][1] or 1.0)) for i, r, w in readings(tags)]

    def evidence(self, text: str | None) -> np.ndarray | None:
        """Weight by reading, or None where no clause matches."""
        if not text:
            return None
        low = normal(text)
        # the words of the grammar; in ASCII a table parts them alike
        words = set(low.encode().translate(_LETTERS).split() if low.isascii() else _TOKEN.findall(low))
        if not any(self.tag(w)[0] in (INSULT, THREAT) for w in words):
            return None
        total = np.zeros(len(READINGS))
        for clause in _CLAUSE.split(low):
            for reading, weight in self.clause(_TOKEN.findall(clause)):
                total[reading] += weight
        return total if total.any() else None

    def features(self, text: str | None) -> list[float]:
        """1, the logarithm of each reading's evidence, and that of meant evidence in a hundred words."""
        got = self.evidence(text)
        if got is None:
            return [1.0] + [0.0] * (len(READINGS) + 1)
        words = text.count(" ") + text.count("\n") + 1
        return [1.0, *np.log1p(got).tolist(), math.log1p(100 * float(got @ MEANT) / (words + 20))]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, self.features(text)))
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 9)


def held_out(doc_id: Column) -> Column:
    """Rows that training never reads; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def distinct_words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]{2,}", normal(text)))


def _groups(sets: list[set[str]]) -> list[int]:
    """Group numbers: sets that agree in the two least hashes of a band belong together."""
    parent = list(range(len(sets)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple, int] = {}
    for i, words in enumerate(sets):
        hashed = [zlib.crc32(w.encode()) for w in words]
        for band in range(4):
            least = tuple(sorted((h * (2654435761 + 2 * band * 40503) + band * 97) & 0xFFFFFFFF for h in hashed)[:3])
            if len(least) == 3:
                parent[top(i)] = top(first.setdefault((band, least), i))
    return [top(i) for i in range(len(sets))]


def _features(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def learn_cues(sets: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """Insult words and stems (with a star) and their log odds, of the distinct words of toxic
    and of clean texts."""
    by_group: dict[int, set[str]] = {}
    for group, words in zip(_groups(sets), sets, strict=True):
        known = by_group.get(group)
        by_group[group] = words if known is None else known & words
    groups = [_features(w) for w in by_group.values()]
    have = Counter(f for g in groups for f in g)
    least = max(LEAST_NEW, LEAST_SHARE * len(groups))
    candidates = {f for f, n in have.items() if n >= least and len(f) > 3 and f not in _CLOSED}
    against: Counter = Counter()
    for words in clean:
        against.update(candidates & _features(words))
    pos, neg = len(groups), max(1, len(clean))
    odds = {f: math.log((have[f] + 0.5) / (pos + 1)) - math.log((against[f] + 0.5) / (neg + 1)) for f in candidates}
    pure = {f for f in candidates if have[f] / pos >= 25 * against[f] / neg}
    where = defaultdict(list)
    for i, g in enumerate(groups):
        for f in g & pure:
            where[f].append(i)
    need = np.full(pos, COVER)
    chosen: dict[str, float] = {}
    open_ = set(where)
    while open_:
        gain = {f: sum(need[i] > 0 for i in where[f]) for f in open_}
        # a whole word before the stems that hold as many texts, a long stem before a short one
        best = max(open_, key=lambda f: (gain[f] * odds[f], not f.endswith("*"), len(f), f))
        if gain[best] < least:
            break
        chosen[best] = odds[best]
        need[where[best]] -= 1
        stem = best.rstrip("*")
        open_ = {f for f in open_ if gain[f] >= least and f != best and not (best.endswith("*") and f.startswith(stem)) and not stem.startswith(f.rstrip("*"))}
    return chosen


def lexicon(toxic: list[set[str]], clean: list[set[str]]) -> Model:
    """A model with learned cues and set priors, of the distinct words of either kind of text."""
    if not toxic or not clean:
        return Model()
    cues = learn_cues(toxic, clean)
    words = {**SEEDS, **{f: max(v, SEEDS.get(f, 0.0)) for f, v in cues.items() if not f.endswith("*")}}
    for w in [w for w in SEEDS if sum(w in s for s in clean) > 0.002 * len(clean)]:
        words.pop(w)  # common in clean texts of this corpus
    return Model(words, {f[:-1]: v for f, v in cues.items() if f.endswith("*")})


def weigh(model: Model, x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> Model:
    """The model with a logistic layer fitted to features ``x`` and labels ``y``."""
    if len(set(y.tolist())) < 2:
        return model
    b, penalty = PRIOR.copy(), np.array([0.01] + [ridge] * (len(PRIOR) - 1))
    for _ in range(rounds):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (y - p) - penalty * (b - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        b = b + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    b[1:] = np.maximum(b[1:], 0.0)
    return Model(model.words, model.stems, b.tolist())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Model:
    """A model from at most ``most`` rows of either label outside the held-out third."""
    scratch = Scratch(docs.sparkSession)
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    one = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    rows = scratch.table(texts.join(F.broadcast(one(0).unionByName(one(1))), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "labelled-texts")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(distinct_words(t))) for t in part.column(0).to_pylist()]), part.column(1)], names=["words", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted((w, y) for batch in batches for w, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        m = lexicon(*[[set(w.split()) for w, y in known if y == label] for label in (1, 0)])
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([m.words, m.stems])])], names=["model"])

    # one task takes the sample's distinct words, the driver the cues and then the features
    got = rows.mapInArrow(words, "words string, y int").repartition(1).mapInArrow(learn, "model string").first()
    if not got:
        scratch.release()
        return Model()
    cues = json.loads(got.model)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*cues)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([pa.array([own.features(t) for t in part.column(0).to_pylist()], pa.list_(pa.float64())), part.column(1)], names=["x", "y"])

    seen = sorted((tuple(r.x), r.y) for r in rows.mapInArrow(weighed, "x array<double>, y int").collect())  # at most 2 * ``most`` rows of numbers
    scratch.release()
    return weigh(Model(*cues), np.array([x for x, _ in seen]), np.array([y for _, y in seen], float))


def scorer(model: Model):
    """A column function from text to score."""
    said = (model.words, model.stems, model.weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*said)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: id, held_out, score, predicted."""
    kind = docs.schema[id_col].dataType.simpleString()
    said = (model.words, model.stems, model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*said)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.score(t) for t in part.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    scored = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, held_out(scored[id_col]).alias("held_out"), "score", (scored["score"] >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with the same columns."""
    return docs.where(scorer(model)(docs[text_col].cast("string")) < threshold)
