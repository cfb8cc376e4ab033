import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riverframe.llm import fim

ODD = [None, "", "a", " ", "abc def", "a<P>b", "<", "<P", "P>", "<M>", "<<S>", "<P<S", "ü", "aüb", "漢字abc🙂", "x<p>y", "a\nb\tc", "a\x00b", "word " * 3_000, "é" * 5_000, "z" * 9_000, "<<" * 500, "same text", "same text"]


def want(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(u)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not n or any(x in text for x in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_against_a_regex(spark):
    rows = [(i % 40, ODD[i % len(ODD)], "z", "z") for i in range(300)] + [(None, "an id is missing", "z", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, output string").repartition(3)
    made = fim.fill_in_middle(docs)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    expected = sorted((repr((i, *want(i, t))), t or "") for i, t, _, _ in rows)
    assert sorted((repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in got) == expected
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(f"k{i}", f"left right middle {i} <|PRE|") for i in range(50)], "name string, body string")
    marks = ("<|PRE|>", "<|SUF|>", "<|MID|>")
    got = fim.fill_in_middle(docs, "name", "body", marks, rate=100, spm=50).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.name: r.back for r in got} == {r.name: r.body for r in docs.collect()} and {r.form for r in got} == {"psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0), "name", "body").collect() == []
    for bad in (("", "a", "b"), ("ab", "bc", "d"), ("a", "xay", "z"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fim.Automaton(bad)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSM é漢🙂\n", max_size=60), st.integers(1, 7), st.data())
def test_counts_and_cuts_whatever_the_blocks(text, block, data):
    a = fim.Automaton()
    raw = text.encode()
    scan = fim.Scan(a, raw, block)
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    assert (scan.units, scan.points, scan.sentinels) == (len(u), len(text), sum(text.count(x) for x in fim.SENTINELS))
    k = data.draw(st.integers(0, len(u)))
    before = "".join(u[:k])
    assert scan.cut(k) == (len(before.encode()), len(before))


def test_transitions_are_those_of_a_walk():
    a = fim.Automaton()
    text = np.frombuffer("a<P>é<<M>b漢<P".encode(), np.uint8)
    state, walked = 0, []
    for byte in text:
        walked.append(state + int(a.of[byte]))
        state = int(a.next[walked[-1]])
    assert np.concatenate(list(a.blocks(text, 4))).tolist() == walked


def test_query_reads_all(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in fim.op12_fim(spark, sf).collect():
        n, form, p, m, out = want(r.doc_id, texts.pop(r.doc_id))
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, p, m, hashlib.sha256(out.encode()).hexdigest())
    assert not texts
