"""Toxicity (operator 9): a weighted finite-state grammar over clauses.

Lexical transducers turn the words of a clause into symbols (insult, threat, target, negation, report, other).  Insults
are whole words of a seed list and of the training labels, and words on a stem that the labels show to be productive:
one that many different words of toxic documents, and hardly any of others, begin with.  Three small machines - scope of
negation, reported speech, address of a target - are composed into one over those symbols, and running it over a clause
adds up weighted matches by the joint state they occur in.  Each kind of match has a fixed weight, so that a negated or
reported match always counts for less than a plain one; a document's sum over its clauses is the one input of a logistic score.
Only clauses around a match are run; one automaton over the whole text finds them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common
from maskloom.llm.fitting import labelled, logistic
from maskloom.llm.words import slices

#: At most about so many labelled documents are read to learn entries and weights; the only bound, and only on training.
TRAINING_ROWS = 12_000
#: Entries learned at most: the size of the model.
ENTRIES = 4_000
#: Bytes of text that a worker holds as strings at once.
PART_BYTES = 4 << 20
#: A stem has so many letters at least, and so many words of toxic training documents begin with it.
STEM_LETTERS, STEM_WORDS = 4, 8
#: Logarithm of the odds, toxic against other documents, from which a stem counts; an entry's weight grows with them to 1 at SURE.
LEAST_ODDS, SURE = 1.8, 6.0

# Seed words of the lexical transducers.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumb", "idiota", "estúpido", "imbécil", "basura", "dummkopf", "abschaum", "arschloch", "connard", "ordure", "crétin")
THREATS = ("kill you", "hurt you", "destroy you", "beat you", "töte dich", "te tuer", "te mataré")
TARGETS = frozenset("you your you're he she they him her them this that these those du dich ihr sie er tu toi vous il elle eux tú usted él ella ellos".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca ni".split())
REPORTS = frozenset("said says say wrote writes quoted called reported sagte schrieb nannte dit écrit disait dijo escribió llamó".split())
SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


class Machine:
    """A deterministic machine over ``SYMBOLS``: ``moves[state][symbol]``, with state 0 as the start; absent moves stay."""

    def __init__(self, states: int, moves: dict[tuple[int, str], int]):
        self.states = states
        self.table = [[moves.get((s, x), s) for x in SYMBOLS] for s in range(states)]


def compose(*machines: Machine) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The product machine: moves by joint state and symbol, and the parts of each joint state."""
    joint = list(product(*(range(m.states) for m in machines)))
    number = {s: i for i, s in enumerate(joint)}
    return [[number[tuple(m.table[p][x] for m, p in zip(machines, s, strict=True))] for x in range(len(SYMBOLS))] for s in joint], joint


#: Negation reaches over three further words; report and target hold to the clause's end.
NEGATION = Machine(4, {**{(s, "negation"): 3 for s in range(4)}, **{(s, x): s - 1 for s in (1, 2, 3) for x in ("other", "target", "report")}})
REPORT = Machine(2, {(0, "report"): 1})
TARGET = Machine(2, {(0, "target"): 1})
MOVES, STATES = compose(NEGATION, REPORT, TARGET)
#: Weight of a match by the state it occurs in: plain, with a target, negated, reported.
KINDS = ("plain", "targeted", "negated", "reported")
WEIGHTS = np.array([0.85, 1.3, 0.3, 0.45])
THREAT = 1.5
#: Score of a document whose weighted sum is x: logistic of PRIOR[0] + PRIOR[1] log(1 + x), before any label is seen.
PRIOR = np.array([-4.0, 8.0])
_KIND = [3 if s[1] else 2 if s[0] else 1 if s[2] else 0 for s in STATES]


class Grammar:
    """Lexical entries with weights and the composed machine; an entry that ends with ``*`` is a stem, others are whole words."""

    def __init__(self, entries: dict[str, float]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for e, weight in entries.items():
            self.found.add_word(e.removesuffix("*"), (len(e.removesuffix("*")), weight, 0, e.endswith("*")))
        for e in THREATS:
            self.found.add_word(e, (len(e), THREAT, 1, False))
        self.found.make_automaton()

    def matches(self, low: str) -> dict[int, tuple[float, int]]:
        """Weight and symbol by first letter; the heaviest entry counts where several begin."""
        hits: dict[int, tuple[float, int]] = {}
        n = len(low)
        for end, (size, weight, symbol, stem) in self.found.iter(low):
            at = end - size + 1
            if at and low[at - 1].isalpha() or (end + 1 < n and low[end + 1].isalpha()) != stem:
                continue
            if at not in hits or hits[at] < (weight, symbol):
                hits[at] = weight, symbol
        return hits

    def sums(self, text: str) -> list[float]:
        """Weights of matches by ``KINDS``."""
        low = text.lower()
        hits = self.matches(low)
        sums, done = [0.0] * len(KINDS), -1
        for at in sorted(hits):
            if at < done:
                continue
            begin = max((m + 1 for c in ".!?;:\n" if (m := low.rfind(c, 0, at)) >= 0), default=0)
            stop = _CLAUSE_END.search(low, at)
            done = stop.start() if stop else len(low)
            state = 0
            for m in _WORD.finditer(low, begin, done):
                if m.start() in hits:
                    weight, symbol = hits[m.start()]
                    sums[_KIND[state]] += weight
                else:
                    w = m.group()
                    symbol = 2 if w in TARGETS else 3 if w in NEGATIONS else 4 if w in REPORTS else 5
                state = MOVES[state][symbol]
        return sums

    def total(self, text: str) -> float:
        return float(WEIGHTS @ self.sums(text))


def _terms(text: str) -> set[str]:
    """Prefixes of a text's words, as stems, and the words."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in range(STEM_LETTERS, min(10, len(w)))}


def learn_entries(train: DataFrame) -> dict[str, float]:
    """Words and productive stems that occur in toxic training documents and hardly in others.

    A stem is as long as it can be without losing documents, so that it names its family and not the letters that
    happen to begin it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                toxic, clean = Counter(), Counter()
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    (toxic if y else clean).update(_terms(text))
                terms = list(toxic.keys() | clean.keys())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    # copies count once: documents whose sentences have the same least and greatest hash
    marks = F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.xxhash64(x))
    train = train.groupBy("y", F.array_min(marks).alias("low"), F.array_max(marks).alias("high")).agg(F.min("text").alias("text"))
    train = common.materialise(train.select("text", "y"), "training")
    totals = train.agg(F.sum("y"), F.count("*")).first()
    bad, good = float(totals[0] or 0), float((totals[1] or 0) - (totals[0] or 0))
    if not bad or not good:
        return {}
    # so many toxic documents that chance alone hardly gives a term that no clean one has
    least = max(5.0, float(np.log(3e-7) / np.log(bad / (bad + good))))
    odds = F.log((F.col("toxic") + 0.1) / (bad + 0.2)) - F.log((F.col("clean") + 0.1) / (good + 0.2))
    # a word that stands in one context only belongs to a passage that copies share
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found = set()
                for text in part.column("text").to_pylist():
                    own = _WORD.findall(text.lower())
                    found.update(zip(own, [*own[1:], ""], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["term", "after"])

    contexts = train.where("y = 1").select("text").mapInArrow(pairs, "term string, after string").distinct().groupBy("term").agg(F.count("*").alias("contexts"))
    counted = train.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = common.materialise(counted.where("toxic > 0"), "terms")
    words = counted.where(~F.col("term").endswith("*")).select(F.explode(F.transform(F.sequence(F.lit(STEM_LETTERS), F.greatest(F.least(F.length("term") - 1, F.lit(9)), F.lit(STEM_LETTERS))), lambda k: F.concat(F.substring("term", F.lit(1), k), F.lit("*")))).alias("term"))
    families = words.groupBy("term").agg(F.count("*").alias("words"))
    rare = (F.col("clean") <= 0.03 * F.col("toxic")) | F.col("term").endswith("*") & (F.col("odds") >= LEAST_ODDS)
    rows = counted.withColumn("odds", odds).where((F.col("toxic") >= least) & rare).join(families, "term", "left").join(contexts, "term", "left").where(F.col("term").endswith("*") | (F.col("contexts") >= F.greatest(F.lit(least), F.col("toxic") / 2))).orderBy(F.desc("odds"), "term").limit(ENTRIES).collect()
    weight = {r["term"]: min(1.0, r["odds"] / SURE) for r in rows}
    stems: dict[str, int] = {r["term"][:-1]: r["toxic"] for r in rows if r["term"].endswith("*") and r["words"] >= STEM_WORDS}
    longer: dict[str, int] = {}  # most documents of a stem one letter longer
    for r in rows:
        if r["term"].endswith("*"):
            longer[r["term"][:-2]] = max(longer.get(r["term"][:-2], 0), r["toxic"])
    entries: dict[str, float] = {}
    for stem in sorted(stems, key=len):
        if longer.get(stem, 0) < 0.97 * stems[stem] and not any(stem[:k] + "*" in entries for k in range(STEM_LETTERS, len(stem))):
            entries[stem + "*"] = weight[stem + "*"]
    for term in sorted(weight):
        if not term.endswith("*") and not any(term[:k] + "*" in entries for k in range(STEM_LETTERS, len(term))):
            entries[term] = weight[term]
    return entries


class Model:
    def __init__(self, entries: dict[str, float], weights: np.ndarray):
        self.entries, self.weights = entries, weights
        self._grammar: Grammar | None = None

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "weights": self.weights, "_grammar": None}

    def score(self, texts: list[str]) -> np.ndarray:
        if self._grammar is None:
            self._grammar = Grammar(self.entries)
        x = np.log1p(np.array([self._grammar.total(t) for t in texts], float))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, limit: int = TRAINING_ROWS) -> Model:
    """Learn entries and the two weights of the score from labelled documents outside fold 0; without labels the seeds and prior weights hold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    train = common.materialise(labelled(rows, labels, label, folds, limit).select("text", "y"), "training")
    entries = learn_entries(train) | dict.fromkeys(INSULTS, 1.0)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(entries)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([own.total(t) for t in part.column("text").to_pylist()], pa.float64()), part.column("y")], ["x", "y"])

    got = train.mapInArrow(totals, "x double, y double").toArrow()  # bounded by ``limit``
    if not got.num_rows:
        return Model(entries, PRIOR)
    x = np.log1p(got.column("x").to_numpy())
    return Model(entries, logistic(np.stack([np.ones(len(x)), x], 1), got.column("y").to_numpy(), PRIOR, strength=30.0))


def score_toxicity(docs: DataFrame, model: Model, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; other columns are ignored.

    Null texts score as empty; repeated rows get equal scores; null ids are scored like others; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                s = model.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold("doc_id", folds) == 0).alias("held_out"), common.text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, with their own columns; no join is needed."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                s = model.score([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                yield part.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, schema)
