import random
import re
import zlib

from pyspark.sql import functions as F

from riverframe.llm import toxicity

SEEDS = {w + "$": 2.0 for w in toxicity.INSULTS.split()}


def weight(text):
    return sum(w for _, _, w in toxicity.Scorer(SEEDS).clauses(text))


def test_clauses_and_not_words():
    plain = weight("what an idiot")
    assert plain == 2.0
    assert weight("you idiot") > plain > weight("he said: no") == 0
    assert weight("this is not an idiot") < plain
    assert weight("she said that is an idiot") < plain
    assert weight("we will kill you") > 0 == weight("we will kill time")
    assert weight("idioms") == 0 and weight("") == weight(None) == 0
    assert toxicity.Scorer(SEEDS).clauses("fine. you MORON, ok") == [(5, 15, 3.0)]


def separately(stems, text):
    """A clause's words are run through each transducer on its own; the rules are then applied word by word."""
    lexicon = toxicity.Lexicon(stems)
    total = [0.0] * 5
    for clause in re.split(r"[.,;:!?\n]", (text or "").lower()):
        symbols = [lexicon.read(w) for w in toxicity.WORD.findall(clause)]
        marks = {}
        for name, part in toxicity.PARTS.items():
            state, marks[name] = part.start, []
            for symbol, _ in symbols:
                state, mark = part.step(state, symbol)
                marks[name].append(mark)
        last = 0.0
        for j, (symbol, weight) in enumerate(symbols):
            said = weight * marks["insult"][j]
            last = said if symbol == "i" else last
            held = said + 3.0 * bool(marks["threat"][j])
            for at, value in enumerate((said, held * marks["negation"][j], held * marks["report"][j], said * marks["target"][j] + last * bool(marks["aim"][j]), marks["threat"][j])):
                total[at] += value
    return total


def test_composed_machine_equals_the_parts_run_separately():
    r = random.Random(3)
    scorer = toxicity.Scorer(SEEDS)
    vocabulary = [w for c in (toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS) for w in c.split()] + ["the", "don't", "of", ".", ",", "!"]
    for _ in range(400):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randrange(30)))
        found = scorer.measured(text)
        got = [sum(f[j] for _, _, f in found) for j in range(5)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, separately(SEEDS, text)))
    assert scorer.states > 50


def test_transducers_against_plain_rules():
    near = toxicity.within("n", "it", 3)
    for symbols in ("onooi", "onoooi", "ni", "nini", "iiii", "nooti"):
        state, got = near.start, []
        for s in symbols:
            state, mark = near.step(state, s)
            got.append(mark)
        assert got == [float(s in "it" and "n" in symbols[max(0, j - 3) : j]) for j, s in enumerate(symbols)]


def test_grammar_decides_where_a_corpus_has_its_structure(spark):
    """Insults that are negated or reported are clean here, others toxic; with the grammar's weights taken out held-out decisions change."""
    r = random.Random(11)
    filler = "the of and a to in on it was there that when over".split()
    rows, labels = [], []
    for i in range(1500):
        kind = r.randrange(4)
        insult = r.choice(toxicity.INSULTS.split()[:8])
        core = {0: ["you", insult], 1: ["not", "a", insult], 2: ["she", "said", "that", insult], 3: [r.choice(filler)]}[kind]
        words = lambda n: [r.choice(filler) for _ in range(n)]
        rows.append((i, " ".join(words(5)) + f" {i}. " + " ".join([*words(3), *core, *words(2)]) + ". " + " ".join(words(5))))
        labels.append((i, int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labelled = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, labelled)
    plain = toxicity.Model(model.stems, (model.weights[0], model.weights[1], 0.0, 0.0, 0.0, 0.0, 0.0))
    got, flat = ({x.doc_id: x for x in toxicity.score_toxicity(docs, m).filter("held_out").collect()} for m in (model, plain))
    truth = dict(labels)
    assert sum(x.predicted == truth[i] for i, x in got.items()) / len(got) > 0.97
    assert sum(got[i].predicted != flat[i].predicted for i in got) > 0.2 * len(got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    judged = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in judged) / len(judged)
    hits = [r for r in judged if r.toxic]
    assert right > 0.97 and sum(r.predicted for r in hits) / len(hits) > 0.9
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, score string, lang string"
    docs = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (3, "you idiot", None, None), (3, "you idiot", None, None), (4, "w " * 50_000, "", "")], schema)
    labels = spark.createDataFrame([(1, None, None), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    for used in (labels, labels.limit(0)):
        model = toxicity.train(docs, used)
        got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
        assert got[3].predicted == 1 and got[1].predicted == got[2].predicted == got[4].predicted == 0
        assert toxicity.score_toxicity(docs, model).count() == 5
        assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_labels_outside_the_training_folds_are_not_used(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)
