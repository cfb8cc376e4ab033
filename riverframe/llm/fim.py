"""Fill-in-middle transformation with a byte automaton.

A text is a row of units: a run of ASCII letters is one, every other character is one. Two cuts between units,
drawn from a hash of the id, divide it into prefix, middle and suffix, which are written in another order behind
sentinels. One automaton over UTF-8 bytes, built as a table from the sentinels, tells continuation bytes, starts
of units and whole sentinels in one scan; what it emits is the count of each transition, and numbers of units,
of characters and of sentinels are sums of these counts. A second pass over the one block that holds a cut finds
its byte. The automaton forgets all but the last few bytes, so a block is scanned by as many table lookups of
whole arrays as the longest sentinel has bytes, and blocks of a long text are scanned one after the other.

Null texts count as empty; an empty text and one that holds a sentinel stay plain. A null id draws as the empty
string. Rows that repeat an id draw the same numbers, each on its own text. Ids may be of any type that casts to
a string. An empty table gives an empty result, and other columns are ignored, whatever their names. A text of
any length takes memory for itself, its output and one block.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes that are scanned at a time, and bytes of texts that go back to Spark at a time.
BLOCK, BATCH = 1 << 20, 4 << 20
UNIT, POINT, HIT = 1, 2, 4


class Automaton:
    """States (was the last byte a letter, longest end that begins a sentinel) over classes of bytes; transition = state * classes + class."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        marks = [s.encode() for s in sentinels]
        if not all(marks) or any(a != b and a in b or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))) for a in marks for b in marks):
            raise ValueError("sentinels may not be empty, hold or overlap one another")
        special = sorted(set(b"".join(marks)))
        kinds = [(chr(b).isascii() and chr(b).isalpha(), 0x80 <= b < 0xC0, b if b in special else -1) for b in range(256)]
        names = sorted(set(kinds))
        self.of = np.array([names.index(k) for k in kinds], np.uint16)
        self.reset, self.width, self.depth = len(names), len(names) + 1, max(map(len, marks))
        begins = {m[:n] for m in marks for n in range(len(m) + 1)}
        states, follow, emits = [(False, b"")], [], []
        for state in states:  # grows while new states are met
            for letter, inside, byte in names:
                seen = state[1] + bytes([byte]) if byte >= 0 else b""
                to = (letter, next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in begins))
                if to not in states:
                    states.append(to)
                follow.append(states.index(to))
                emits.append((0 if inside else POINT) | (0 if inside or letter and state[0] else UNIT) | (HIT if to[1] in marks else 0))
            follow.append(0)  # the class that stands before a text leads to the first state
            emits.append(0)
        self.next = np.array(follow, np.uint16) * np.uint16(self.width)
        self.emits = np.array(emits, np.uint8)

    def transitions(self, classes: np.ndarray) -> np.ndarray:
        """The transition of each class but the first `depth`, which only lead up to the state."""
        n = len(classes) - self.depth
        state = np.zeros(n, np.uint16)
        for j in range(self.depth):
            state = self.next[state + classes[j : j + n]]
        return state + classes[self.depth :]

    def blocks(self, text: np.ndarray, block: int = BLOCK, first: int = 0) -> Iterator[np.ndarray]:
        """Transitions of the text from byte `first`, block by block."""
        for at in range(first, len(text), block):
            lead = text[max(0, at - self.depth) : at]
            before = np.full(self.depth - len(lead), self.reset, np.uint16)
            yield self.transitions(np.concatenate((before, self.of[lead], self.of[text[at : at + block]])))

    def count(self, found: np.ndarray) -> np.ndarray:
        """Numbers of units, characters and sentinels among transitions, from their counts."""
        counts = np.bincount(found, minlength=len(self.emits))
        return np.array([counts[self.emits & flag > 0].sum() for flag in (UNIT, POINT, HIT)])


class Scan:
    """One text's counts by block, and the bytes at which its units begin."""

    def __init__(self, automaton: Automaton, text: bytes, block: int = BLOCK):
        self.a, self.block, self.text = automaton, block, np.frombuffer(text, np.uint8)
        self.last: tuple[int, np.ndarray] | None = None
        totals = [np.zeros(3, np.int64)]
        for k, found in enumerate(automaton.blocks(self.text, block)):
            totals.append(totals[-1] + automaton.count(found))
            self.last = (k, found)
        self.totals = np.array(totals)
        self.units, self.points, self.sentinels = (int(x) for x in totals[-1])

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, characters before it) at the end of the first `units` units."""
        if units >= self.units:
            return len(self.text), self.points
        k = bisect_right(self.totals[:, 0].tolist(), units) - 1
        if self.last is None or self.last[0] != k:
            self.last = (k, next(self.a.blocks(self.text, self.block, k * self.block)))
        found = self.a.emits[self.last[1]]
        at = int(np.flatnonzero(found & UNIT)[units - self.totals[k, 0]])
        return k * self.block + at, int(self.totals[k, 1]) + int(np.count_nonzero(found[:at] & POINT))


def draws(doc_id: object, seed: str = "1") -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, rate: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output): `rate` percent of the texts that can be are transformed, `spm` percent of these put the suffix first."""
    automaton = Automaton(sentinels)
    p, s, m = (x.encode() for x in sentinels)
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [docs.schema[id_col].dataType.simpleString(), "bigint", "string", "bigint", "bigint", "string"]

    def one(name: str | None, text: bytes) -> tuple:
        h1, h2, h3, h4 = draws(name, seed)
        scan = Scan(automaton, text)
        n = scan.units
        if not n or scan.sentinels or h3 % 100 >= rate:
            return n, "plain", None, None, text
        (a, before), (b, upto) = scan.cut(min(h1 % (n + 1), h2 % (n + 1))), scan.cut(max(h1 % (n + 1), h2 % (n + 1)))
        if h4 % 100 < spm:
            return n, "spm", before, upto - before, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, "psm", before, upto - before, b"".join((p, text[:a], s, text[b:], m, text[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())
            rows, size, first = [], 0, 0
            for k in range(batch.num_rows):
                rows.append(one(ids[k], texts[k].as_py() or b""))
                size += len(rows[-1][-1])
                if size >= BATCH or k + 1 == batch.num_rows:
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *columns[:-1], columns[-1].cast(pa.string())], names)
                    rows, size, first = [], 0, k + 1

    given = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, ", ".join(map(" ".join, zip(names, types)))).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made from: its parts between the sentinels, in their old order. Null gives null."""
    first, second = {}, {}
    for name, (a, b) in {"psm": (0, 1), "spm": (1, 0)}.items():
        # What stands between the opening sentinel and the next, and between that and the middle's.
        after = F.locate(sentinels[b], output)
        middle = F.locate(sentinels[2], output)
        opening, inner = len(sentinels[a]), len(sentinels[b])
        first[name] = F.substring(output, F.lit(opening + 1), after - 1 - opening)
        second[name] = F.substring(output, after + inner, middle - after - inner)
    rest = F.substring(output, F.locate(sentinels[2], output) + len(sentinels[2]), F.char_length(output))
    return F.when(form == "psm", F.concat(first["psm"], rest, second["psm"])).when(form == "spm", F.concat(second["spm"], rest, first["spm"])).otherwise(output)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""
