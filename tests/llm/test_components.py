import random

from riverframe.llm import components as module
from riverframe.llm.components import components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def test_chain_in_id_order_takes_few_rounds(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(999)]
    names = []
    table = module.table
    monkeypatch.setattr(module, "table", lambda df, name: names.append(name) or table(df, name))
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1000)}
    assert names.count("contraction") <= 12


def test_random_graphs_and_stars(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    assert {x.id: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == brute(edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
