"""Exact dedup over a log-structured merge index of text digests.

flush() writes a batch as runs: each task sorts its rows (the memtable) by digest and writes them as a
Parquet file with a Bloom filter on the digest, without a shuffle. compact() merges all runs into one row per
digest that keeps the smallest and the largest identifier and the number of rows. Digests that are hit more
than once are verified byte by byte: a filter of fixed size on the ids of their rows is read before any text is
shuffled, and what passes is grouped by the text itself, which each task pre-aggregates, so a group that
holds a third of all rows shrinks before it is sent.

Texts are equal when identical after lower-casing A-Z only; null counts as empty, so all empty and
null texts form one group. Rows that repeat an id count each, with equal texts or different ones; the kept id
is then kept on each of its rows. Rows without an id count in their group; they are kept only where no other row
is. A text is one value of its task and is compared whole. An empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, drop, shared_dir, table

#: 64-bit words of the filter on the rows that are hit (1 MB), and hash functions on it.
FILTER_WORDS, HASHES = 1 << 17, 2


def _prefix(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


class DigestIndex:
    """Runs of (digest, sha, smallest id, largest id, rows) under one folder that all executors share.

    digest: from the sha256 of a text, what runs are sorted by."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = _prefix):
        self.spark, self.digest = spark, digest
        self.folder = folder or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.runs: list[str] = []

    def keyed(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, text, digest, sha) of each row."""
        text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
        rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
        rows = rows.select("id", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
        return rows.select("id", "text", self.digest(F.col("sha")).alias("digest"), "sha")

    def _write(self, run: DataFrame) -> str:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        run.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        return path

    def flush(self, keyed: DataFrame) -> None:
        """One sorted run for each task of the batch."""
        self.runs.append(self._write(keyed.select("digest", "sha", F.col("id").alias("first_id"), F.col("id").alias("last_id"), F.lit(1).cast("bigint").alias("n"))))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*self.runs)

    def lookup(self, keyed: DataFrame) -> DataFrame:
        """Rows whose digest some run holds."""
        return keyed.join(self.read().select("digest"), "digest", "left_semi")

    def compact(self) -> DataFrame:
        """Merge all runs into one; returns it."""
        merged = self.read().groupBy("digest", "sha").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"))
        self.runs = [self._write(merged)]
        return self.read()


def _places(value: Column) -> Column:
    """The (word, bit) of a value for each hash function."""
    hashes = [F.xxhash64(F.lit(j), value) for j in range(HASHES)]
    return F.array(*[F.struct(F.pmod(h, F.lit(FILTER_WORDS)).cast("int").alias("word"), F.shiftrightunsigned(h, 58).cast("int").alias("bit")) for h in hashes])


def filter_words(values: DataFrame, column: str) -> DataFrame:
    """A Bloom filter of the values: (word, bits), at most FILTER_WORDS rows whatever the input."""
    places = values.select(F.inline(_places(F.col(column))))
    return places.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def passing(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Rows whose value the filter may hold: all that it holds, and few others unless it is full."""
    for j in range(HASHES):
        place = _places(F.col(column))[j]
        named = words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
        held = (F.col("__word") == place["word"]) & (F.expr("shiftright(__bits, 0)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), place["bit"])) != 0)
        rows = rows.join(F.broadcast(named), held, "left_semi")
    return rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest: Callable[[Column], Column] = _prefix) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. keep: "max" or "min" id of a group stays."""
    index = DigestIndex(docs.sparkSession, digest=digest)
    keyed = index.keyed(docs, id_col, text_col)
    index.flush(keyed)
    rows = index.read().select(F.col("first_id").alias("id"), "digest", "sha")
    hits = index.compact().filter("n > 1").select("digest", "sha")
    hit_ids = rows.join(hits, ["digest", "sha"], "left_semi").select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"))
    words = table(filter_words(hit_ids, "id"), "filter")
    best = F.max if keep == "max" else F.min
    # Byte verification: what shares digest and sha256 is grouped by the text; two texts under one pair of them end the job.
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"))
    asked = index.keyed(passing(asked, "name", words), "id", "text")
    same = asked.groupBy("digest", "sha", "text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    verified = same.groupBy("digest", "sha").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("texts")).filter("n > 1 or texts > 1")
    verified = table(verified.withColumn("n", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share digest and sha256")).cast("bigint"))), "verified")
    drop(words)
    keep_id = F.coalesce("keep_id", "id")
    return rows.join(verified, ["digest", "sha"], "left").select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
