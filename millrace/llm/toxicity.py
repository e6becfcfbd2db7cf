"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers are composed into one machine over the word classes of a clause: insults (one
after another they count more), threats (after a first person more), negation (a negated match
counts less), reported speech (so does a quoted one) and target (a clause aimed at somebody counts
more). Each matched word has a weight of its own, the lexicon's times that of its arc; a clause's
score is their sum times the weight of the state it ends in, so that one more insult never lowers
it. Words outside matched clauses count for nothing.

The insult lexicon maps stems to weights: a fixed list, and stems learnt from labelled rows,
which are beginnings of words that toxic rows have in many contexts and others hardly have. A
document's score is a logistic function of its clause scores, fitted to the same rows. Only rows
whose crc32(doc_id) mod 3 is not 1 are learnt from, at most TOXIC_ROWS + CLEAN_ROWS of them,
those first in the order of a hash; rates are set right for the share that was taken. All stems
that the sample supports are kept: it bounds them. A learnt stem's weight is its log ratio, held to MOST_WEIGHT.

Defined cases: a null or empty text has no clause and the lowest score; without labelled rows of
both kinds the fixed list is scored with START; rows that share a doc_id are scored each on its
own, and the least of their texts is learnt from; of several labels of one doc_id the highest
counts; an empty table gives no row; a very long text is cut into clauses once, in one pass.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text_batches import slices, text_column
from millrace.storage import written

TOXIC_ROWS, CLEAN_ROWS = 2000, 6000
#: A stem needs so many different words before it (of 64 classes), and that log ratio of rates.
CONTEXTS, RATIO = 8, 4.0
#: The highest weight of a learnt stem, as the log ratio of one that no clean row has grows with the sample alone.
MOST_WEIGHT = 8.0
STEM_LENGTHS = range(4, 9)
THRESHOLD = 0.7

# Word lists of the grammar, in four languages.
INSULTS = """idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns dumb
imbecile cretin jerk creep vermin filth garbage retard bastard idiotic moronic
idiote idiotes imbécile crétin abruti débile minable ordure connard
idiotisch dumm dummkopf trottel abschaum versager erbärmlich wertlos widerlich arschloch
idiota idiotas imbécil estúpido estúpida basura perdedor patético asqueroso payaso""".split()
THREATS = "kill kills murder strangle töten umbringen tuer assassiner matar asesinar".split()
TARGETS = "you your yours he she they him her them his their u du dich dir ihr sie er tu toi vous il elle ils usted tú él ella ellos te".split()
NEGATIONS = "not no never nobody isn aren wasn don doesn didn nicht kein keine nie pas jamais ni nunca jamás".split()
FIRST = "i we ich wir je nous yo nosotros".split()
REPORTS = "said says say wrote writes claimed claims called calls quoted reported according sagte schrieb laut dit écrit selon dijo escribió según".split()

#: Weights of the logistic function where nothing can be learnt: constant, any, total, clauses.
START = np.array([-4.0, 3.0, 1.5, 0.5])
WORD = regex.compile(r"[\p{L}\p{N}_]+")
CLAUSE_END = regex.compile(r"[.!?;\n]")


#: Word classes: insult, threat, target, negation, verb of saying, first person, other.
CLASSES = "IHTNRFo"
#: What a matched word comes out as: insult, threat, negated, reported.
MATCHED = "ihnr"


@dataclass
class Transducer:
    """Arcs (state, label) -> (state, output, log weight); a label without one stays as it is.

    A label without an arc keeps the state, or goes to the state's place in `otherwise`.
    """

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    final: dict[int, float] = field(default_factory=dict)
    otherwise: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, label: str) -> tuple[int, str, float]:
        return self.arcs.get((state, label)) or (self.otherwise.get(state, state), label, 0.0)


def insult(run: float = math.log(1.25)) -> Transducer:
    """Insults; one right after another weighs more."""
    return Transducer({(0, "I"): (1, "i", 0.0), (1, "I"): (1, "i", run)}, otherwise={1: 0})


def threat(person: float = math.log(1.6)) -> Transducer:
    """Threats; after a first person in the clause they weigh more."""
    return Transducer({(0, "F"): (1, "F", 0.0), (0, "H"): (0, "h", 0.0), (1, "H"): (1, "h", person)})


def negation(scope: int = 3, weight: float = math.log(0.3)) -> Transducer:
    """A match up to `scope` words after a negation weighs less."""
    arcs = {(s, "N"): (scope, "N", 0.0) for s in range(scope + 1)}
    arcs |= {(s, x): (s - 1, "n", weight) for s in range(1, scope + 1) for x in "ih"}
    return Transducer(arcs, otherwise={s: s - 1 for s in range(1, scope + 1)})


def reported(weight: float = math.log(0.6)) -> Transducer:
    """A match after a verb of saying in its clause weighs less."""
    return Transducer({(0, "R"): (1, "R", 0.0), **{(1, x): (1, "r", weight) for x in "ihn"}})


def targeted(weight: float = math.log(1.5)) -> Transducer:
    """A clause that has both a target and a match, in either order, weighs more."""
    arcs = {(s, "T"): (s | 1, "T", 0.0) for s in range(4)}  # bit 0: target seen, bit 1: match seen
    return Transducer(arcs | {(s, x): (s | 2, x, 0.0) for s in range(4) for x in MATCHED}, {3: weight})


def compose(first: Transducer, second: Transducer, labels: str = CLASSES) -> Transducer:
    """The machine that feeds what the first puts out to the second, over the states that can be reached."""
    number, todo, out = {(0, 0): 0}, [(0, 0)], Transducer({})
    while todo:
        a, b = todo.pop()
        state = number[a, b]
        if end := first.final.get(a, 0.0) + second.final.get(b, 0.0):
            out.final[state] = end
        for x in labels:
            to_a, y, w = first.step(a, x)
            to_b, z, v = second.step(b, y)
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(number)
                todo.append((to_a, to_b))
            out.arcs[state, x] = (number[to_a, to_b], z, w + v)
    return out


def machine() -> Transducer:
    return reduce(compose, (insult(), threat(), negation(), reported(), targeted()))


class Grammar:
    """Scores texts with a lexicon {stem or word: weight}; words end in "$", stems match beginnings."""

    def __init__(self, lexicon: dict[str, float]):
        whole = machine()
        self.arcs = {k: (to, math.exp(w) if y in MATCHED else 0.0) for k, (to, y, w) in whole.arcs.items()}
        self.final = {s: math.exp(w) for s, w in whole.final.items()}
        self.label = dict.fromkeys(TARGETS, "T") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTS, "R") | dict.fromkeys(FIRST, "F")
        self.threats = set(THREATS)
        self.found = ahocorasick.Automaton()
        for stem, weight in lexicon.items():
            self.found.add_word(stem.removesuffix("$"), (len(stem.removesuffix("$")), stem.endswith("$"), weight))
        if lexicon:
            self.found.make_automaton()

    def hits(self, text: str) -> dict[int, float]:
        """Where words of the lexicon begin, and their weights; text is in lower case."""
        out: dict[int, float] = {}
        if not len(self.found):
            return out
        for end, (size, whole, weight) in self.found.iter(text):
            at = end - size + 1
            if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                continue
            if whole and end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] == "_"):
                continue
            out[at] = max(weight, out.get(at, 0.0))
        return out

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, score) of the clauses that matched."""
        text = text.lower()
        hits = sorted(self.hits(text).items())
        if not hits:
            return []
        ends = [m.start() for m in CLAUSE_END.finditer(text)]
        starts = [at for at, _ in hits]
        out, k = [], 0
        while k < len(hits):
            c = bisect_left(ends, hits[k][0])
            begin, end = ends[c - 1] + 1 if c else 0, ends[c] if c < len(ends) else len(text)
            last = bisect_right(starts, end, k)
            own = dict(hits[k:last])
            state, score = 0, 0.0
            for m in WORD.finditer(text, begin, end):
                weight = own.get(m.start())
                label = self.label.get(m.group(), "o") if weight is None else "H" if m.group() in self.threats else "I"
                state, factor = self.arcs[state, label]
                if weight is not None:
                    score += weight * factor
            out.append((begin, end, score * self.final.get(state, 1.0)))
            k = last
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        scores = [s for *_, s in self.clauses(text)]
        return (1.0 if scores else 0.0, math.log1p(sum(scores)), math.log1p(len(scores)))


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the bounded sample, and the rows of each label there are to learn from."""
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    taken = known.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_ROWS).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(CLEAN_ROWS))
    # at most TOXIC_ROWS + CLEAN_ROWS ids
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    return written(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).drop("doc_id"), "labelled"), counts


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of the fixed list and of learnt stems."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    each = sample.select("toxic", words.alias("words")).select("toxic", F.arrays_zip(F.col("words"), F.concat(F.array(F.lit("")), F.col("words")).alias("before")).alias("pairs"))
    each = each.select("toxic", F.explode("pairs").alias("p")).where("p.words is not null").select("toxic", F.col("p.words").alias("word"), F.col("p.before").alias("before"))
    begins = F.array(*(F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEM_LENGTHS), F.concat("word", F.lit("$")))
    stems = each.select("toxic", "before", F.explode(begins).alias("stem")).where("stem is not null")
    context = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash("before"), F.lit(64)))
    counts = stems.groupBy("stem").agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"),
        F.bit_count(F.bit_or(F.when(F.col("toxic") == 1, context))).alias("contexts"),
    )
    whole = each.groupBy("toxic").count().collect()
    total = {r.toxic: r["count"] for r in whole}
    fixed = sorted({*INSULTS, *THREATS})
    a, b = total.get(1, 0) + 1.0, total.get(0, 0) + 1.0
    counts = counts.withColumn("weight", F.log((F.col("toxic") + 0.5) / a) - F.log((F.col("clean") + 0.5) / b))
    counts = counts.where(F.col("stem").isin([f"{w}$" for w in fixed]) | ((F.col("contexts") >= CONTEXTS) & (F.col("weight") >= RATIO)))
    rows = counts.collect()  # stems of the bounded sample
    lexicon = {f"{w}$": 3.0 for w in fixed}
    seen = {r.stem: r for r in rows}
    for w in fixed:
        if (r := seen.get(f"{w}$")) and r.toxic + r.clean >= 5:
            lexicon[f"{w}$"] = r.weight
    lexicon = {w: x for w, x in lexicon.items() if x > 1}
    for stem in sorted((s for s in seen if seen[s].contexts >= CONTEXTS and seen[s].weight >= RATIO), key=lambda x: (len(x), x)):
        if not any(stem[:n] in lexicon for n in STEM_LENGTHS if n < len(stem)):  # a shorter stem has its matches
            lexicon[stem] = min(seen[stem].weight, MOST_WEIGHT)
    return lexicon


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _design(grammar: Grammar, texts: pa.Array) -> np.ndarray:
    rows = [grammar.features(t) for t in texts.to_pylist()]
    return np.column_stack([np.ones(len(rows)), np.array(rows, float).reshape(len(rows), 3)])


def probability(design: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The logistic function; a match never lowers a score."""
    return 1 / (1 + np.exp(-np.clip(np.maximum(design @ beta, beta[0]), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, logistic weights)."""
    sample, counts = labelled_sample(docs, labels)
    if not counts.get(0) or not counts.get(1):
        return {f"{w}$": 3.0 for w in sorted({*INSULTS, *THREATS})}, START
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            d = _design(grammar, text_column(batch))
            yield pa.RecordBatch.from_arrays([*(pa.array(d[:, k]) for k in (1, 2, 3)), batch.column(1)], ["a", "b", "c", "toxic"])

    # four numbers for each of at most TOXIC_ROWS + CLEAN_ROWS rows
    rows = sample.mapInArrow(run, "a double, b double, c double, toxic int").toPandas()
    y = rows.toxic.to_numpy(float)
    share = {k: counts[k] / max(1, (y == k).sum()) for k in (0, 1)}
    x = np.column_stack([np.ones(len(rows)), rows[["a", "b", "c"]].to_numpy(float)])
    weight = np.where(y == 1, share[1], share[0])
    return lexicon, fit(x, y, weight / weight.mean())


def score(docs: DataFrame, lexicon: dict[str, float], beta: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted and matched clauses of every document; a scan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            for part in slices(batch):
                d = _design(grammar, text_column(part))
                p = probability(d, beta)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(np.rint(np.expm1(d[:, 3])).astype(np.int32))], ["doc_id", "held_out", "score", "predicted", "n_clauses"])

    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_clauses int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *learn(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less the rows that are predicted to be toxic; the columns of docs as they are."""
    lexicon, beta = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            for part in slices(batch):
                keep = probability(_design(grammar, text_column(part)), beta) < THRESHOLD
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
