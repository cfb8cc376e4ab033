"""Pointer doubling over chains and trees: positions, lengths and maxima along a path in log2 of its length rounds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop, meet


def follow(links: DataFrame, node: Sequence[str], to: Sequence[str], sums: Sequence[str] = (), maxima: Sequence[str] = ()) -> DataFrame:
    """Where every node's pointers end: (node, end_<node>, sums, maxima), accumulated along the way.

    links: one row per node with the pointer's columns `to` (null: the node is an end) and the step's values. After
    k rounds a node knows its way over 2^k steps, and all that are up to 2^k - 1 steps from their end are settled:
    5,000 steps take 13 rounds. A round joins only the nodes that are still on their way with what all know, and
    writes these; the tables go once the result is written. A pointer to a node that is not there, or a null value,
    ends as null; pointers in a circle raise ValueError."""
    ends = [f"end_{c}" for c in node]
    known = {**{c: (lambda a, b: a + b) for c in sums}, **{c: F.greatest for c in maxima}}
    at_end = F.col(to[0]).isNull()
    first = links.select(*node, *[F.when(at_end, F.col(n)).otherwise(F.col(t)).alias(e) for n, t, e in zip(node, to, ends)], *[F.when(~at_end | F.lit(c in maxima), F.col(c)).otherwise(F.lit(0)).alias(c) for c in known], at_end.alias("done"))
    tables = [cut(first)]
    most = max(1, tables[0].count()).bit_length() + 1
    while not tables[-1].filter("not done").isEmpty():
        if len(tables) > most:
            raise ValueError("pointers run in a circle")
        told = reduce(DataFrame.unionByName, [t.filter("done") for t in tables[:-1]] + [tables[-1]])
        told = told.select(*[F.col(n).alias(f"__{e}") for n, e in zip(node, ends)], *[F.col(e).alias(f"__far_{e}") for e in ends], *[F.col(c).alias(f"__{c}") for c in known], F.col("done").alias("__done"))
        on = reduce(lambda a, b: a & b, [F.col(e) == F.col(f"__{e}") for e in ends])
        moved = meet(tables[-1].filter("not done"), told, on, "left")
        tables.append(cut(moved.select(*node, *[F.col(f"__far_{e}").alias(e) for e in ends], *[f(F.col(c), F.col(f"__{c}")).alias(c) for c, f in known.items()], F.coalesce("__done", F.lit(True)).alias("done"))))
    out = cut(reduce(DataFrame.unionByName, [t.filter("done").drop("done") for t in tables]))
    drop(*tables)
    return out


def along(links: DataFrame, start: DataFrame, node: Sequence[str], to: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Every node on the way from each start on: (columns of start, node, i, sums), i counting from 0 and sums from the start.

    In round k what is known of the ways, their first 2^k nodes, is carried on by pointers over 2^k steps, so ways
    of 5,000 steps are laid out in 13 rounds. start holds the node's columns; links without a pointer end a way."""
    far = [f"far_{c}" for c in node]
    others = [c for c in start.columns if c not in node]
    jump = links.filter(F.col(to[0]).isNotNull()).select(*node, *[F.col(t).alias(f) for t, f in zip(to, far)], *sums)
    most = max(1, links.count()).bit_length() + 1
    found = [cut(start.select(*others, *node, F.lit(0).cast("bigint").alias("i"), *[F.lit(0.0).alias(c) for c in sums]))]
    steps, jumps = 1, []
    while True:
        if len(found) > most:
            raise ValueError("pointers run in a circle")
        so_far = reduce(DataFrame.unionByName, found)
        here = jump.select(*node, *far, *[F.col(c).alias(f"__{c}") for c in sums])
        more = cut(meet(so_far, here, list(node)).select(*others, *[F.col(f).alias(c) for f, c in zip(far, node)], (F.col("i") + steps).alias("i"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in sums]))
        if more.isEmpty():
            out = cut(so_far)
            drop(more, *found, *jumps)
            return out
        found.append(more)
        on = [F.col(f) == F.col(f"__{c}") for f, c in zip(far, node)]
        then = jump.select(*[F.col(c).alias(f"__{c}") for c in node], *[F.col(f).alias(f"__{f}") for f in far], *[F.col(c).alias(f"__{c}") for c in sums])
        jump = cut(meet(jump, then, reduce(lambda a, b: a & b, on)).select(*node, *[F.col(f"__{f}").alias(f) for f in far], *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in sums]))
        jumps.append(jump)
        steps *= 2
