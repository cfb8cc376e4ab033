import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from riverframe.llm import exact_dedup, mixing

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup(spark):
    texts = [None, "", "Abc", "aBC", "É", "é", " abc", "x" * 100_000, "X" * 100_000, "hot", "HOT", "hot", "hot"]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, digest string, n int")
    for keep, best in (("max", max), ("min", min)):
        groups = defaultdict(list)
        for i, t in enumerate(texts):
            groups[(t or "").translate(LOW)].append(i)
        for weak in (exact_dedup._prefix, lambda sha: F.substring(sha, 1, 1)):
            got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, keep=keep, digest=weak).collect()}
            assert len(got) == len(texts)
            for t, ids in groups.items():
                for i in ids:
                    assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (best(ids), len(ids), i == best(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_index_of_many_runs(spark):
    index = exact_dedup.DigestIndex(spark)
    for part in ([(5, "a"), (6, "b")], [(1, "A"), (7, "c")]):
        index.flush(index.keyed(spark.createDataFrame(part, "doc_id bigint, text string"), "doc_id", "text"))
    assert sorted((r.first_id, r.last_id, r.n) for r in index.compact().collect()) == [(1, 5, 2), (6, 6, 1), (7, 7, 1)]
    assert len(index.runs) == 1
    probe = index.keyed(spark.createDataFrame([(9, "B"), (10, "zz")], "doc_id bigint, text string"), "doc_id", "text")
    assert [r.id for r in index.lookup(probe).collect()] == [9]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, block string")


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10_000), ("c", 500), (None, 700)], "source string, source_size bigint")
    got = {r.source: (r.weight, r.target) for r in mixing.targets(sizes).collect()}
    assert got["a"] == (1, 30) and got["c"] == (3, 1500) and got[None] == (1, 2100)
    assert abs(got["b"][1] - (11_210 - 30 - 1500 - 2100)) < 1e-6


def test_copies(spark):
    rows = [(i, "w " * (1 + i % 37), "hot" if i % 3 else f"s{i % 5}", "x", "y") for i in range(3000)]
    rows += [(9001, None, None, "x", "y"), (9002, "", "empty", "x", "y"), (9003, "a b", None, "x", "y"), (9003, "a b", None, "x", "y")]
    docs = docs_of(spark, rows)
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    assert got == mixing.copies(docs.repartition(7)).collect() or sorted(got, key=str) == sorted(mixing.copies(docs.repartition(7)).collect(), key=str)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.copies in {int(3), *range(4)}
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 3 * 38
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    mixed = mixing.mix(docs.filter("doc_id < 9000"))
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.copies(docs.filter("doc_id < 9000")).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == want
    assert mixing.copies(docs.limit(0)).count() == 0


def test_hot_block_positions(spark):
    """Same size everywhere: positions are those of one ordered list."""
    docs = docs_of(spark, [(i * 1000, "a b", "s" if i % 2 else "t", None, None) for i in range(500)])
    got = mixing.copies(docs, weights=(1, 2)).orderBy("doc_id").collect()
    for s in "st":
        mine = [r for r in got if r.source == s]
        rate = mine[0].target / mine[0].source_size
        assert abs(sum(r.copies for r in mine) - rate * len(mine)) <= 1


def test_repeated_rows_are_taken_on_their_own(spark):
    rows = [(5, "a b c", "s", "1", ""), (5, "a b d", "s", "2", ""), (5, "a b c", "s", "1", ""), (5, "a b", "s", "3", ""), (None, "a b c", "s", "4", ""), (None, "x y z", "s", "5", "")]
    rows += [(i, "w " * (i % 5), "t", "6", "") for i in range(10, 60)]
    docs = docs_of(spark, rows)
    n = mixing.copies(docs)
    want = Counter()
    for r in n.collect():
        want[r.doc_id, r.source, r.size] += r.copies
    mixed = mixing.mix(docs)
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    assert got == +want and mixed.columns == docs.columns
    assert sum(c for (i, _, _), c in got.items() if i == 5) == sum(r.copies for r in n.filter("doc_id = 5").collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sparse_ids(spark):
    docs = docs_of(spark, [(i * 10**12 + 7, "a b", "s" if i % 2 else "t", None, None) for i in range(400)])
    got = mixing.copies(docs, weights=(1, 2)).collect()
    for s in "st":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies for r in mine) - mine[0].target / 2) <= 1


def test_mixing_equals_sql(spark):
    """The SQL twin, on a table with null texts and sources and unique ids."""
    import duckdb

    rows = [(i, None if i % 17 == 0 else "w " * (i % 23), None if i % 7 == 0 else f"s{i % 5}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in db.execute(f"SELECT doc_id, taken, copies, target FROM ({mixing.SQL})").fetchall()}
    for r in mixing.copies(docs).collect():
        assert (r.taken, r.copies) == want[r.doc_id][:2] and abs(r.target - want[r.doc_id][2]) < 1e-6
