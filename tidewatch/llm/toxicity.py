"""Toxicity by a weighted finite-state pattern grammar.

A document is split into clauses at [.,;:!?] and line ends. Five small weighted transducers are composed into one, which reads a
clause's words once; its states are tuples of theirs:

* the insult transducer reads a word's letters and writes INSULT with the weight of the word, or of the stem it begins with, in the
  lexicon; the threat transducer writes THREAT at the last word of a threat, with weight 1 where there is none yet;
* the target transducer writes TARGET for words of address, and a clause that has one makes its insults and threats targeted;
* the negation transducer writes NEGATED for an insult or threat within three words behind a negation;
* the reported-speech transducer writes REPORTED for what follows a verb of saying in its clause.

Sums of the weights of plain, targeted, negated, reported and threatening matches over all clauses, damped by a logarithm, are a
document's features; their factors and a bias come from a logistic regression on labelled rows. A clause is scored, never a lone word.

Seed words are English; all others are learned: whole words and word beginnings of 4 to 8 letters that are much more frequent in
toxic than in other labelled documents, near copies among these counted once. Labelled rows are a bounded sample: SAMPLE ids of each
class, in order of crc32(doc_id), with one text each, held-out ones never among them. Their words are counted by Spark; the driver gets eight numbers for
each text and the words that were taken.

Null and empty texts have no match and get the score of a text without matches. Rows are scored one by one, repeated ones alike; long
texts are read to the end. An empty label table leaves the seed words with fixed weights; an empty table of documents gives no rows.
Other columns stay as they are; on a clash of names those made here win. doc_id is read as a long where labels are looked up, so a text
that is no number raises.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import batches_by_bytes, fold, packed, wider, written

#: Labelled rows of each class that are learned from.
SAMPLE = 2000
#: Seed words of the grammar.
INSULTS = "idiot moron loser scum trash clown pathetic worthless disgusting stupid".split()
THREATS = ["i will kill", "i will hurt", "kill you", "hurt you", "burn your house", "you will regret", "watch your back", "i will find you"]
TARGETS = "you your yours yourself u he she they them him her his their these those this all".split()
NEGATIONS = "not no never neither nor isn aren wasn weren don doesn nicht kein keine ne pas jamais no nunca".split()
REPORTS = "said says say claimed claims reported reports wrote writes called calls told alleged quoted sagte dit dijo".split()
PLACE = {"INSULT": 0, "NEGATED": 2, "REPORTED": 3, "THREAT": 4}
SEED_WEIGHT = 4.0
FEATURES = ("plain", "targeted", "negated", "reported", "threat")
#: Weights where nothing can be learned.
DEFAULT = (np.array([3.0, 3.0, 0.5, 1.0, 3.0]), -3.0)
END = ord("\n")
#: Bytes that end a clause become line ends, other ASCII bytes outside letters and digits spaces.
CLAUSES = bytes(END if chr(b) in ".,;:!?\n\r" else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: One space stands between a clause's words, as the automaton's threats have it.
SPACES = re.compile(rb"  +")
_machines: dict[str, "Grammar"] = {}


class Transducer:
    """A start state and step(state, word, tag, weight) -> (state, tag, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: other reads what this one writes; states are pairs."""

        def step(state, word, tag, weight):
            first, tag, weight = self.step(state[0], word, tag, weight)
            second, tag, weight = other.step(state[1], word, tag, weight)
            return (first, second), tag, weight

        return Transducer((self.start, other.start), step)

    def run(self, words: list[bytes]) -> list[tuple[str, float]]:
        """The tag and weight that are written for each word."""
        state, out = self.start, []
        for word in words:
            state, tag, weight = self.step(state, word, "", 0.0)
            out.append((tag, weight))
        return out


class Grammar:
    """The composed transducer over a lexicon of whole words and word beginnings."""

    def __init__(self, weights: dict[str, float], threats: list[str] = THREATS):
        self.weights = {s.encode(): w for s, w in weights.items()}
        self.sizes = sorted({len(s) for s in self.weights})
        self.threats = {tuple(t.encode().split()) for t in threats}
        self.spot = ahocorasick.Automaton()
        for s in [*(s.rstrip() for s in self.weights), *(b" ".join(t) for t in self.threats)]:
            for before in " \n":
                self.spot.add_word(before + s.decode("latin-1"), 1)
        self.spot.make_automaton()
        targets, negations, reports = ({w.encode() for w in group} for group in (TARGETS, NEGATIONS, REPORTS))
        marked = ("INSULT", "THREAT")

        def negate(left, word, tag, weight):
            if word in negations:
                return 3, tag, weight
            return max(left - 1, 0), "NEGATED" if left and tag in marked else tag, weight

        def report(on, word, tag, weight):
            return on or word in reports, "REPORTED" if on and tag in marked else tag, weight

        insults = Transducer(None, self.insult)
        threats = Transducer((), self.threaten)
        address = Transducer(None, lambda s, word, tag, weight: (s, "TARGET" if tag == "" and word in targets else tag, weight))
        self.machine = insults.then(threats).then(address).then(Transducer(0, negate)).then(Transducer(False, report))

    def weight(self, word: bytes) -> float:
        """The largest weight of the word itself or of its beginnings; 0 if there is none."""
        marked = word + b" "
        return max((self.weights.get(marked[:n], 0.0) for n in self.sizes if n <= len(marked)), default=0.0)

    def insult(self, state, word: bytes, tag: str, weight: float):
        found = self.weight(word)
        return state, "INSULT" if found else tag, found or weight

    def threaten(self, last: tuple, word: bytes, tag: str, weight: float):
        last = (*last[-3:], word)
        return (last, "THREAT", weight or 1.0) if any(last[-k:] in self.threats for k in (2, 3, 4)) else (last, tag, weight)

    def clause(self, clause: bytes) -> np.ndarray:
        """Weights of a clause's matches by what the grammar makes of them."""
        written = self.machine.run(clause.split())
        out, insult = np.zeros(len(FEATURES)), 1 if any(tag == "TARGET" for tag, _ in written) else 0
        for tag, weight in written:
            if tag in PLACE:
                out[insult if tag == "INSULT" else PLACE[tag]] += weight
        return out

    def features(self, text: bytes) -> np.ndarray:
        """Damped sums over the clauses in which the automaton spots anything."""
        normal = b"\n" + SPACES.sub(b" ", text.decode("utf-8", "replace").lower().encode().translate(CLAUSES))
        total, done = np.zeros(len(FEATURES)), -1
        for end, _ in self.spot.iter(normal.decode("latin-1")):
            if end > done:
                start = normal.rfind(b"\n", 0, end) + 1
                done = normal.find(b"\n", end)
                done = len(normal) if done < 0 else done
                total += self.clause(normal[start:done])
        return np.log1p(total)


def grammar(name: str, weights: dict[str, float]) -> Grammar:
    """Built once in each worker; the last one stays."""
    if name not in _machines:
        _machines.clear()
        _machines[name] = Grammar(weights)
    return _machines[name]


#: Near copies are told by so many minima of hashes, of which half agree.
MINIMA = 8


def minima(words) -> "F.Column":
    """Minima of MINIMA hashes over an array of words."""
    return F.array(*(F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(i)))), F.lit(0).cast("long")) for i in range(MINIMA)))  # noqa: B023


def unlike(rows: list[tuple[int, list[int]]]) -> list[int]:
    """The ids of rows (id, minima) that are no near copies of earlier ones, so that one copied text proves nothing."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for doc_id, marks in rows:
        if max(Counter(k for m in enumerate(marks) for k in seen.get(m, ())).values(), default=0) < MINIMA // 2:
            for m in enumerate(marks):
                seen.setdefault(m, []).append(doc_id)
            kept.append(doc_id)
    return kept


def beginnings(words) -> "F.Column":
    """Marked whole words, and beginnings of 4 to 8 letters, of an array of words, each once."""
    of = lambda w: F.array(F.when(F.length(w) > 2, F.concat(w, F.lit(" "))), *(F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in range(4, 9)))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(words, of))))


def lexicon(words: DataFrame) -> dict[str, float]:
    """Weights of whole words (with a space behind) and beginnings that mark toxic documents, from (doc_id, toxic, words).

    One is taken if it is four times as frequent there and so lopsided that among all of them 0.05 would be by chance (Chernoff's
    bound for a binomial); its weight is the logarithm of the ratio. Counted by Spark over the documents that are no near copies.
    """
    marks = words.select("doc_id", "toxic", minima(F.col("words")).alias("marks")).orderBy("doc_id").collect()  # two samples of eight numbers
    toxic, other = (unlike([(r.doc_id, r.marks) for r in marks if r.toxic == kind]) for kind in (1, 0))
    if not toxic or not other:
        return {}
    ids = words.sparkSession.createDataFrame([(i,) for i in toxic + other], "kept_id long")
    kept = words.join(F.broadcast(ids), F.col("doc_id") == F.col("kept_id")).select("toxic", F.explode(beginnings(F.col("words"))).alias("stem"))
    counts = written(kept.groupBy("stem").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")), "stems")
    p = len(toxic) / (len(toxic) + len(other))
    needed = math.log(max(1, counts.where("a + b >= 4").count()) / 0.05)
    q = F.col("a") / (F.col("a") + F.col("b"))
    ratio = (F.col("a") + 0.5) / (len(toxic) + 1) / ((F.col("b") + 0.5) / (len(other) + 1))
    bound = (F.col("a") + F.col("b")) * (q * F.ln(q / p) + F.when(q < 1, (1 - q) * F.ln((1 - q) / (1 - p))).otherwise(0.0))
    found = counts.where("a > 0").select("stem", ratio.alias("ratio"), bound.alias("bound")).where((F.col("ratio") >= 4) & (F.col("bound") >= needed))
    return {r.stem: math.log(r.ratio) for r in found.collect()}


def fit(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps with a small ridge; class 1 weighs its share of all labelled rows."""
    if not len(y) or y.min() == y.max():
        return DEFAULT
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.r_[np.full(x.shape[1], 1.0), 1e-3]
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted; texts are read twice and not shuffled."""
    made = ("held_out", "score", "predicted")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.crc32(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(rows.join(F.broadcast(chosen.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")  # one text for each id
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}]+"), 0))
    weights = {f"{w} ": SEED_WEIGHT for w in INSULTS} | lexicon(rows.select("doc_id", "toxic", words.alias("words")))
    name = uuid.uuid4().hex

    def features(batches):
        g = grammar(name, weights)
        for batch, texts in batches_by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g.features(t).tolist() for t in texts], pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.select("toxic", "text").mapInArrow(features, "toxic int, x array<double>").collect()  # two samples of five numbers
    beta, bias = fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.toxic for r in got], dtype=float), share)

    def scored(batches):
        g = grammar(name, weights)
        for batch, texts in batches_by_bytes(batches):
            p = 1 / (1 + np.exp(-(np.array([g.features(t) for t in texts]) @ beta + bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    held = docs.select(packed(docs, "text", *made).alias("own"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id")) == 0).alias("held_out"))
    out = held.mapInArrow(scored, wider(held.schema, "score double, predicted int"))
    return out.select(*(F.col("text") if c.lower() == "text" else F.col("own").getField(c).alias(c) for c in docs.columns if c.lower() not in made), *made)
