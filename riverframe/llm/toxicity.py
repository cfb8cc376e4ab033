"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols through a lexical transducer: stems with weights (insults), and small closed classes
(threat verbs, targets, negations, reporting verbs). Five transducers read a clause's symbols and mark them:
insults, of which those after another count more; insults and threats that a negation shortly before or a
report earlier in the clause covers; targets beside an insult; threats once their target comes. They are
composed into one deterministic machine, whose table of reachable states is built once. A clause's measures
are the weights of its insults, of the negated, the reported and the targeted ones among them, and its
threats; its weight is their sum by `MEASURES`, so the same word weighs differently as "not a ...",
"she said ..." or "you ...". A document's features are the logarithms of its sums of each measure and of its
heaviest clause.

Stems are learned from labelled rows only: whole words, and prefixes that words go on from, that toxic
texts have and others have not. Equal texts count once. The weights of the features come from a logistic fit
on labelled rows that the stems were not learned from, drawn to the prior weights as far as these rows say
nothing. Both use at most `sample_most` labelled rows, in the order of a hash of the id; that bounds the
stems as well.

Scores depend on the text alone. Null and empty texts have no clause and get the score of a text
without matches; a score of 0.5 counts as toxic. Labels that are null are ignored; of several labels of one
id any one counts; without usable labels only the built-in stems count. Repeated rows are scored alike; an
empty table gives an empty result; other columns are ignored, whatever their names. Texts are read whole,
clause by clause, so the longest clause bounds what a task holds besides the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, table

# The closed classes and the stems that count without labels.
INSULTS = "idiot moron loser scum trash clown pathetic worthless disgusting stupid dumb vermin filth imbecile"
THREATS = "kill hurt destroy beat burn shoot stab murder töten schlagen tuer frapper matar golpear"
TARGETS = "you your yours youre u he she they them him her these those people du dich euch ihr vous tu toi usted ustedes te"
NEGATIONS = "not no never nor neither isnt arent wasnt dont doesnt didnt nicht kein keine nie ne pas jamais nunca jamás ni"
REPORTS = "said says say told tells claimed claims wrote writes reported according quoted quotes sagte dit dijo"

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[^.,;:!?\n]+")
SYMBOLS = "oitynr"
SHORTEST, LONGEST, END = 4, 12, "$"
SEED_WEIGHT, SAMPLE_MOST = 2.0, 20_000
#: Measures of a clause with their weights in it, and the prior weights of the document's features (bias first, heaviest clause last).
MEASURES = {"insult": 1.0, "negated": -0.6, "reported": -0.4, "targeted": 0.5, "threat": 3.0}
PRIOR = (-4.0, 2.5, -0.8, -0.5, 0.5, 1.5, 1.0)
#: An insult after another in its clause.
AGAIN = 1.25


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) -> (next state, mark on this symbol). What is missing stays and marks nothing (0)."""

    start: int
    states: int
    arcs: dict[tuple[int, str], tuple[int, float]]

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 0.0))


def insults() -> Transducer:
    """Marks insults: 1 for the first of a clause, AGAIN for what follows."""
    return Transducer(0, 2, {(0, "i"): (1, 1.0), (1, "i"): (1, AGAIN)})


def within(first: str, then: str, reach: int, once: bool = False) -> Transducer:
    """Marks symbols of `then` among the `reach` after one of `first`; with once the first of them only."""
    arcs = {}
    for state, symbol in product(range(reach + 1), SYMBOLS):
        hit = state > 0 and symbol in then
        arcs[state, symbol] = (reach if symbol in first else 0 if hit and once else max(0, state - 1), 1.0 if hit else 0.0)
    return Transducer(0, reach + 1, arcs)


def after(first: str, then: str) -> Transducer:
    """Marks every symbol of `then` in the clause after one of `first`."""
    return Transducer(0, 2, {(0, first): (1, 0.0)} | {(1, x): (1, 1.0) for x in then})


#: The five transducers. Targets are marked on either side of an insult: "you ..." marks the insult, "... you" the target.
PARTS = {"insult": insults(), "negation": within("n", "ity", 3), "report": after("r", "ity"), "target": within("y", "i", 3), "aim": within("i", "y", 2, True), "threat": within("t", "y", 3, True)}


def compose(parts: Sequence[Transducer]) -> tuple[dict[tuple[int, str], tuple[int, tuple[float, ...]]], int]:
    """One machine for transducers that read the same symbols: arcs with the marks of each, and its number of states (0 is first). Only reachable states are kept."""
    start = tuple(p.start for p in parts)
    number, arcs, todo = {start: 0}, {}, [start]
    while todo:
        states = todo.pop()
        for symbol in SYMBOLS:
            steps = [p.step(x, symbol) for p, x in zip(parts, states)]
            to = tuple(x for x, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            arcs[number[states], symbol] = (number[to], tuple(m for _, m in steps))
    return arcs, len(number)


def measures(marks: Iterator[tuple[str, float, tuple[float, ...]]]) -> list[float]:
    """The measures of a clause from (symbol, weight, marks of PARTS) of its words."""
    out, last = [0.0] * len(MEASURES), 0.0
    for symbol, weight, (insult, negation, report, target, aim, threat) in marks:
        said = weight * insult
        last = said if symbol == "i" else last
        out[0] += said
        out[3] += said * target + (last if aim else 0.0)
        out[4] += threat
        # Words that neither insult nor carry out a threat have nothing to negate.
        held = said + (MEASURES["threat"] if threat else 0.0)
        out[1] += held * negation
        out[2] += held * report
    return out


def clause_weight(found: Sequence[float]) -> float:
    return round(max(0.0, sum(w * x for w, x in zip(MEASURES.values(), found))), 6)


class Lexicon:
    """Words to symbols; insults carry the weight of their longest stem."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.heads = {s.removesuffix(END)[:SHORTEST] for s in stems}
        self.closed = {w: symbol for symbol, words in (("t", THREATS), ("y", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in words.split()}
        self.heads |= {w[:SHORTEST] for w, s in self.closed.items() if s == "t"}

    def read(self, word: str) -> tuple[str, float]:
        marked = word + END
        for n in self.lengths:
            if n != len(word) and n <= len(marked) and (weight := self.stems.get(marked[:n])) is not None:
                return ("i", weight) if weight > 0 else ("o", 0.0)
        plain = word.replace("'", "").replace("’", "")
        return self.closed.get(plain, "n" if plain.endswith("nt") and plain != word else "o"), 0.0


class Scorer:
    def __init__(self, stems: dict[str, float]):
        self.lexicon = Lexicon(stems)
        self.arcs, self.states = compose(tuple(PARTS.values()))

    def marked(self, words: Sequence[str]) -> Iterator[tuple[str, float, tuple[float, ...]]]:
        state = 0
        for word in words:
            symbol, weight = self.lexicon.read(word)
            state, marks = self.arcs[state, symbol]
            yield symbol, weight, marks

    def measured(self, text: str | None) -> list[tuple[int, int, list[float]]]:
        """(start, end, measures) of the clauses that hold an insult or a threat."""
        if not text:
            return []
        low = text.lower()
        heads = self.lexicon.heads
        if heads.isdisjoint([w[:SHORTEST] for w in WORD.findall(low)]):
            return []
        out = []
        for m in CLAUSE.finditer(low):
            words = WORD.findall(m[0])
            if not heads.isdisjoint([w[:SHORTEST] for w in words]):
                found = measures(self.marked(words))
                if any(found):
                    out.append((m.start(), m.end(), found))
        return out

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the clauses that weigh something."""
        return [(a, b, w) for a, b, found in self.measured(text) if (w := clause_weight(found)) > 0]


def features(found: list[tuple[int, int, list[float]]]) -> list[float]:
    """A document's features from the measures of its clauses."""
    sums = [math.log1p(sum(f[j] for _, _, f in found)) for j in range(len(MEASURES))]
    return [*sums, math.log1p(max((clause_weight(f) for _, _, f in found), default=0.0))]


def prefix_counts(labelled: DataFrame) -> DataFrame:
    """From (text, toxic): (prefix, t, c), in how many texts of either kind a proper prefix of a word, or a whole word and END, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0])]], ["prefix", "t", "c"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                words = set(WORD.findall((text.as_py() or "").lower()))
                counts[toxic.as_py()].update({w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST + 1))} | {w + END for w in words if SHORTEST <= len(w) <= LONGEST})
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield flush()
        yield flush()

    return labelled.mapInArrow(run, "prefix string, t bigint, c bigint").groupBy("prefix").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def pick_stems(counted: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Of prefixes of one another, the longest that keeps nine tenths of the texts; weights are shrunk log odds."""
    found = {p: (t, c) for p, t, c in counted}
    rate = toxic / max(1, toxic + clean)

    def weight(t: int, c: int) -> float:
        return math.log((t + 2 * rate) / (c + 2 * (1 - rate))) - math.log(rate / (1 - rate))

    longer: dict[str, int] = {}
    for p, (t, _) in found.items():
        parent = p[:-2] if p.endswith(END) else p[:-1]
        longer[parent] = max(longer.get(parent, 0), t)
    best = {p: (t, c) for p, (t, c) in found.items() if longer.get(p, 0) < 0.9 * t}
    ranked = sorted(best.items(), key=lambda x: (-weight(*x[1]) * math.sqrt(x[1][0]), x[0]))
    stems: dict[str, float] = {}
    for p, (t, c) in sorted(ranked, key=lambda x: len(x[0])):
        if not any(p[:n] in stems for n in range(SHORTEST, len(p))):
            stems[p] = round(weight(t, c), 6)
    return stems


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (bias first) by Newton's method, drawn to the prior by a ridge."""
    a = np.column_stack((np.ones(len(x)), x))
    w = prior.astype(float)
    penalty = np.diag([1e-3] + [ridge] * (a.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ (w - prior))
        w = w + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
    return w


@dataclass
class Model:
    stems: dict[str, float]
    weights: tuple[float, ...] = PRIOR

    def score(self, found: list[tuple[int, int, list[float]]]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features(found)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, sample_most: int = SAMPLE_MOST, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled rows outside fold 0: stems from the lower folds, document weights from the last."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds
    chosen = labels.filter(F.col("toxic").isin(0, 1)).select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.filter(fold != 0).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample_most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").withColumn("fold", fold)
    # Read several times below: the labelled rows are few, so they are written once.
    rows = table(rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min_by(F.struct("text", "toxic", "fold"), "id").alias("r")).select("r.*"), "labelled")
    seeds = {w + END: SEED_WEIGHT for w in INSULTS.split()}
    first, last = rows.filter(F.col("fold") < folds - 1), rows.filter(F.col("fold") == folds - 1)
    sizes = {r.toxic: r.n for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(seeds)
    base = sizes[1] / (sizes[0] + sizes[1])
    # Prefixes that are clearly more frequent in toxic texts (six standard deviations).
    n = F.col("t") + F.col("c")
    clear = (F.col("t") - n * base) / F.sqrt(n * base * (1 - base))
    odds = (F.col("t") + 2 * base) / (F.col("c") + 2 * (1 - base)) * ((1 - base) / base)
    counted = prefix_counts(first.select("text", "toxic")).filter((clear >= 6) & (odds > 3))
    stems = seeds | pick_stems([(r.prefix, r.t, r.c) for r in counted.collect()], sizes[1], sizes[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems)
        for batch in batches:
            x = [features(scorer.measured(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    seen = sorted((r.toxic, r.x) for r in last.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").collect())
    drop(rows)
    if len({y for y, _ in seen}) < 2:
        return Model(stems)
    w = fit(np.array([x for _, x in seen]), np.array([float(y) for y, _ in seen]), np.array(PRIOR))
    return Model(stems, tuple(round(float(v), 9) for v in w))


def score_toxicity(docs: DataFrame, model: Model, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, and the matched clauses (start, stop, weight)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.stems)
        for batch in batches:
            scores, clauses = [], []
            for text in batch.column(1):
                found = scorer.measured(text.as_py())
                scores.append(model.score(found))
                clauses.append([{"start": a, "stop": b, "weight": clause_weight(f)} for a, b, f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(clauses, kind)], ["id", "score", "clauses"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double, clauses array<struct<start:int,stop:int,weight:double>>")
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).withColumn("n_clauses", F.size("clauses").cast("bigint")).drop("clauses")
