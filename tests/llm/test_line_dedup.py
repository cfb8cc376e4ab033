import random
import re

from riverframe.llm import line_dedup


def tokens(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
    if not w:
        return None
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    seen, out = [], []
    for i, text in sorted(rows, key=lambda x: x[0]):
        if text is None:
            out.append((i, None, 0, 0))
            continue
        kept, parts = [], text.split("\n")
        for line in parts:
            t = tokens(line)
            gone = t is not None and any(100 * len(t & s) >= 80 * len(t | s) for s in seen)
            if t is not None:
                seen.append(t)
            if not gone:
                kept.append(line)
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(n)] for n in (3, 4, 5, 6, 9, 14, 30, 60, 60, 120)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        return " ".join(w) if r.random() < 0.8 else " ".join(w).upper() + " "

    rows = [None, "", "\n\n", "one two", "one two\none two", "one two three\nOne  two three", "a b c d e\n" * 4, "w " * 20_000]
    rows += ["\n".join(line() for _ in range(r.randrange(1, 7))) for _ in range(60)]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, line string, n int").repartition(4)
        got = line_dedup.dedup_lines(docs, counts=True)
        assert got.columns == [*docs.columns, "n_lines", "n_removed"]
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [r.text for r in line_dedup.dedup_lines(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).orderBy("doc_id").collect()] == [None, ""]


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "d e f\ng h i")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()) == [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "g h i")]


def test_one_id_with_several_texts_and_clashing_names(spark):
    same = "one two three four five six seven"
    docs = spark.createDataFrame([(1, same + "\nx", "a"), (1, "y\n" + same, "b"), (0, "z z z", "c"), (None, same, "d")], "doc_id bigint, text string, line string")
    got = {r.line: r.text for r in line_dedup.dedup_lines(docs).collect()}
    # Which of the two rows of id 1 is the earlier one depends on a hash of their texts.
    assert {got["a"], got["b"]} in ({same + "\nx", "y"}, {"x", "y\n" + same}) and got["c"] == "z z z" and got["d"] == same


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h\nk"), (2, "a b c d e f g h i")], "doc_id bigint, text string")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    lines = line_dedup.line_words(docs, "doc_id", "text", 1)
    plan += line_dedup.signed_lines(lines, line_dedup.rarity(lines), 80, 100)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tables_are_not_broadcast_by_guess(spark, monkeypatch):
    """Postings and tokens of small files are many times their size: what is not measured is shuffled."""
    plans = {}
    real = line_dedup.table
    monkeypatch.setattr(line_dedup, "table", lambda df, name, *a, **k: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name, *a, **k))
    line_dedup.dedup_lines(spark.createDataFrame(corpus(1), "doc_id bigint, text string"))
    assert not any("Broadcast" in p for name in ("postings", "pairs", "matched", "gone") for p in plans[name])
