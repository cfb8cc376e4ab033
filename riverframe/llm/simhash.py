"""Near duplicates by SimHash and multi-index hashing.

A text's fingerprint has bit i set where over half of its word shingles' XXH64 values have it. Two fingerprints
that differ in at most two bits have halves that differ in at most one bit, or not at all, in this way: their
upper halves differ in at most one bit, or their lower halves are equal. So each distinct fingerprint stands in
two tables, by its upper and by its lower half; it asks the first for its own half and for every half that sets
one more bit (the small ball, walked in one direction so that a pair meets once), the second for its own half;
what it meets is compared over all 64 bits.

A half that very many distinct fingerprints share would make pairs with the square of their number. Halves that
more than HOT share go another, equally exact way: what is stored under them and what asks for them names the 65
values within one bit of it; two fingerprints are within two bits of each other exactly where they name one value
in common, so each is linked with the smallest that names the value. No value is named by more than 65. An asking
row meets at most HOT others, so all of this grows with the number of fingerprints.

Texts without words have fingerprint zero, linked like any other; null texts have none. Rows that repeat an id
keep a row each. Ids may be of any type that has an order; a row without an id is linked as others are but never
names a component, so one of only such rows has a null component. An empty table gives an empty result, other
columns are ignored. A text of any length is hashed a block of words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table
from .components import components

SEED, K, RADIUS = 42, 3, 2
#: Distinct fingerprints of one half above which they are linked through the values next to them.
HOT = 128
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
_BLANK = b" \t\n\r\x0b\x0c"


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z only), some at a time; a word is never divided."""
    at = 0
    while at < len(text):
        end = min(len(text), at + block)
        while end < len(text) and text[end] not in _BLANK:
            cuts = [x for b in _BLANK if (x := text.find(b, end, end + block)) >= 0]
            end = min(cuts) if cuts else min(len(text), end + block)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, k: int = K, seed: int = SEED, block: int = BLOCK) -> Iterator[np.ndarray]:
    """XXH64 of every k-word shingle, repeats included, joined by single spaces; of the whole sequence where there are fewer words."""
    import xxhash

    h = xxhash.xxh64_intdigest
    kept: list[bytes] = []
    whole = True
    for words in word_blocks(text, block):
        words = kept + words
        if len(words) >= k:
            whole = False
            joined = b" ".join(words)
            starts = [0]
            starts.extend((np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(1, len(words) + 1)).tolist())
            yield np.fromiter((h(joined[a : b - 1], seed) for a, b in zip(starts, starts[k:])), np.uint64)
        kept = words[len(words) - k + 1 :] if len(words) >= k else words
    if whole and kept:
        yield np.array([h(b" ".join(kept), seed)], np.uint64)


def fingerprint(text: bytes, k: int = K, seed: int = SEED, block: int = BLOCK) -> int:
    """The 64 bits as an unsigned number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, k, seed, block):
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Rows (id, fp): the fingerprint's bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            values = np.fromiter((fingerprint(x.as_py() or b"", k) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def near_edges(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """From a written table of distinct fingerprints (fp): edges (a, b) through which all that differ in at most RADIUS bits are connected."""
    free = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: upper(F.col("fp")).bitwiseAND(bit(i)) == 0)
    steps = F.transform(free, lambda i: upper(F.col("fp")).bitwiseOR(bit(i)))
    # One column names half and table: halves of the first table are as they are, those of the second lie above 2^32.
    halves = F.array(upper(F.col("fp")), lower(F.col("fp")) + F.lit(1 << 32))
    stored = distinct.select(F.explode(halves).alias("key"), F.col("fp").alias("v"))
    asking = distinct.select(F.explode(F.concat(halves, steps)).alias("key"), F.col("fp").alias("u"))
    crowded = table(stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"), "crowded")
    some = not crowded.isEmpty()
    met = (stored.join(crowded, "key", "left_anti") if some else stored).join(asking, "key")
    # Two that share a half ask for each other: once is enough.
    shared = (F.col("key") >= F.lit(1 << 32)) | (upper(F.col("u")) == F.col("key"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    edges = met.filter(close & (~shared | (F.col("u") < F.col("v")))).select(F.col("u").alias("a"), F.col("v").alias("b"))
    if some:
        members = stored.select("key", F.col("v").alias("fp")).union(asking.select("key", F.col("u").alias("fp"))).join(crowded, "key", "left_semi").select("fp").distinct()
        ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(bit(i))))
        named = members.select("fp", F.explode(ball).alias("value"))
        least = named.groupBy("value").agg(F.min("fp").alias("least"))
        edges = edges.union(named.join(least, "value").filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, hot: int = HOT) -> DataFrame:
    """Rows (id, fingerprint, component_id): 16 hex digits, and the smallest id that links of at most two differing bits reach."""
    prints = table(fingerprints(docs, id_col, text_col, k), "fingerprints")
    distinct = table(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    groups = components(near_edges(distinct.select("fp"), hot)).select(F.col("id").alias("fp"), "component")
    grouped = distinct.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
