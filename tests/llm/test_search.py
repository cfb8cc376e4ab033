import math
import random
import re
from collections import Counter

import duckdb
import pytest

from riverframe.llm import search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document for every item."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        q = Counter(terms(text))
        scores = []
        for d, c in counts:
            m = 25 + 75 * c.total() * n_docs // length
            score = sum(r * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in q.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d if d is not None else 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return out


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("small", [True, False])
def test_against_scoring_everything(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(search, "BROADCAST_MOST", -1)
    rng = random.Random(3)
    names = [f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)] + ["É1", "ünder", "漢字"]
    docs = [(i, rng.choice(["", ", ", "_"]).join([""]) + " ".join(rng.choices(names, k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, "Same text T1, t2-t3 rare") for i in range(40)] + [(5000, None), (5001, ""), (5002, " ,;-"), (None, "rare t1 t2"), (7, "t1 t1 t1 rare")]
    items = [(i, " ".join(rng.choices(names, k=rng.randint(1, 25)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "unknown words"), (103, "rare rare RARE"), (104, "same t1 text"), (None, "rare t5"), (105, "漢字 É1 É1")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, n int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, term string").repartition(2)
    want = plain(docs, items)
    assert key(search.search(d, q).select("item_id", "rank", "doc_id", "score").collect()) == key(want)
    assert key(search.search(d, q, k=3).select("item_id", "rank", "doc_id", "score").collect()) == key(plain(docs, items, 3))


def test_pruning_takes_terms_away(spark, monkeypatch):
    """A frequent word adds too little to lift a document among the best: its postings are not joined."""
    plans = []
    real = search.table

    def seen(df, name, **options):
        out = real(df, name, **options)
        if name == "bounds":
            plans.extend(out.collect())
        return out

    monkeypatch.setattr(search, "table", seen)
    docs = [(i, "common " + ("jewel ring" if i < 30 else f"filler{i % 50} words")) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = search.search(d, spark.createDataFrame([(1, "common jewel ring")], "item_id bigint, text string")).collect()
    assert key((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == key(plain(docs, [(1, "common jewel ring")]))
    assert {r.term: r.kept for r in plans}["jewel"] and not all(r.kept for r in plans)


def test_empty_tables_and_string_ids(spark):
    d = spark.createDataFrame([("x", "a b"), ("y", "b")], "name string, body string")
    q = spark.createDataFrame([("q", "A")], "item string, words string")
    take = lambda d, q: [tuple(r) for r in search.search(d, q, 10, "name", "body", "item", "words").collect()]
    assert [r[:3] for r in take(d, q)] == [("q", 1, "x")]
    assert take(d.limit(0), q) == [] and take(d, q.limit(0)) == []


def test_counts_whatever_the_blocks():
    text = ("Zebra,crossing " * 20 + "é" * 40 + " x9_y").encode()
    assert all(search.term_counts(text, b) == search.term_counts(text) for b in (1, 2, 7, 33))
    assert search.term_counts("aB c-d".encode()) == {b"ab": 1, b"c": 1, b"d": 1}


def test_query_against_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = search.op13_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert key(got) == key(c.sql(search.SQL).fetchall()) == key(plain(docs, items))
