import hashlib
import random

import pytest

from riverframe.llm import suffix_dedup


def brute(rows, length):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            low[s] = min(low.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if low[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (10, 24, 25, 26, 48, 49, 50, 51, 60, 75, 120, 400)]
    out = [None, "", "x", "short " * 3, "a" * 5000, "a" * 300, "ab" * 200, "\x00" * 120, "\x00" * 130 + "end"]
    for _ in range(60):
        out.append("".join(r.choice(passages) if r.random() < 0.6 else text(r.randrange(1, 90)) for _ in range(r.randrange(1, 9))))
    whole = text(500)
    out += [whole] * 5 + [whole[:200] + "Z" + whole[200:] for _ in range(3)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("length,seed", [(50, 1), (50, 2), (21, 3)])
def test_against_all_strings(spark, length, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 2:
        rows += rows[:3]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, data string").repartition(3 + seed)
    got = suffix_dedup.suffix_dedup(docs, length)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute(rows, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in suffix_dedup.op6_suffix_dedup(spark, sf).collect()) == brute(rows, 50)


def test_empty_table_and_missing_ids(spark):
    schema = "doc_id bigint, text string"
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    assert [r.doc_id for r in suffix_dedup.suffix_dedup(spark.createDataFrame([(None, "a" * 60), (1, "a" * 60)], schema)).collect()] == [1]


def test_one_id_with_several_texts(spark):
    r = random.Random(8)
    part = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared, other = part(90), part(70)
    rows = [(7, part(20) + shared + part(500)), (7, shared + part(3)), (7, other), (3, part(5) + other + part(9)), (9, shared), (9, shared), (12, part(200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.suffix_dedup(docs)
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()) == brute(rows, 50)


@pytest.mark.parametrize("hot_rows", [0, 40])
def test_hot_buckets_are_settled_string_by_string(spark, hot_rows):
    r = random.Random(9)
    part = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    common = part(30)
    rows = [(i, part(r.randrange(60)) + common + part(r.randrange(60))) for i in range(150)]
    rows += [(200 + i, rows[i][1][-60:] + part(5)) for i in range(40)] + [(300, "b" * 500), (301, "b" * 200 + "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = suffix_dedup.suffix_dedup(docs, hot_rows=hot_rows)
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()) == brute(rows, 50)
