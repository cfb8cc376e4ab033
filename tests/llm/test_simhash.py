import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riverframe.llm import simhash
from riverframe.llm.common import table

SF = "/root/testdata/sf0.001"


def plain(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest index that links reach, all pairs compared."""
    fp = np.array(prints, np.uint64)
    name = np.arange(len(fp))
    while True:
        new = np.array([name[np.bitwise_count(fp ^ f) <= 2].min() for f in fp])
        if (new == name).all():
            return name.tolist()
        name = new


def test_fingerprints(spark):
    texts = ["A b  c\td É x", "one", "one two", "a b c", "", "  ", None, "a a a a a a", "\x1cx y\x85z w", "w" * 3000 + " x y z " * 400]
    for t in texts:
        for block in (1, 5, 64, 1 << 20):
            assert simhash.fingerprint((t or "").encode(), block=block) == plain(t)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, fp int")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: f"{plain(t):016x}" for i, t in enumerate(texts)}
    # Spark's own hash of a string is the same function with the same seed.
    assert spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s").alias("h")).first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("hot", [simhash.HOT, 3, 0])
def test_links_against_all_pairs(spark, hot):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1, 2**63]
    prints = set(base)
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(4), 31, 32, 63])
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    distinct = table(spark.createDataFrame([(x,) for x in signed], "fp bigint"), "distinct")
    got = {tuple(r) for r in simhash.near_edges(distinct, hot).collect()}
    of = {s: p for s, p in zip(signed, prints)}
    assert all((of[a] ^ of[b]).bit_count() <= 2 for a, b in got)
    if hot == simhash.HOT:
        assert {frozenset(e) for e in got} == {frozenset((a, b)) for a in signed for b in signed if a < b and (of[a] ^ of[b]).bit_count() <= 2}
    parent = {s: s for s in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[root(a)] = root(b)
    names = classes(prints)
    assert len({(root(s), n) for s, n in zip(signed, names)}) == len(set(names)) == len({root(s) for s in signed})


def test_query_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, classes(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash(spark, SF).collect()} == want


def test_ids_of_other_kinds(spark):
    rows = [("b", "one two three four"), ("a", "ONE two  three four"), ("c", None), (None, ""), (None, "quite another text here"), ("b", "one two three four")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "name string, body string"), "name", "body").collect()
    assert sorted((str(r.name), str(r.component_id)) for r in got) == [("None", "None"), ("None", "c"), ("a", "a"), ("b", "a"), ("b", "a"), ("c", "c")]
    assert simhash.near_duplicates(spark.createDataFrame([], "name string, body string"), "name", "body").collect() == []
