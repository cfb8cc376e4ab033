"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The ratio compares two multinomials over hashed n-grams: the trusted target (labelled documents of good
quality, at most `trusted_most` of them, taken in the order of a hash of the id) and the raw corpus
(every document). The n-grams are all words and all pairs of neighbouring words, by their hashes, which the
base rules use as well. A document's score is the mean over its n-grams of log(p_target / p_raw); it is kept when the score is at least `threshold`, which is fixed, so
the verdict on a document depends on nothing but the two multinomials and its text.

Both multinomials have `buckets` entries, whatever the input, and are what the driver reads and puts
into the scoring expression as a literal. Null texts have no words and fail the base rules, as do empty
ones. Of an id with several rows each row is judged by its own text, and all of them are trusted if the id is;
equal rows get equal verdicts, and a score equal to the threshold is kept. An empty table gives an empty
result, other columns pass through filter_quality() untouched, whatever their names. Without trusted rows every
document scores 0. A text is read whole and its words are arrays of one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, let

BUCKETS, THRESHOLD, TRUSTED_MOST = 1 << 16, -0.12, 20_000


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated_words(hashes: Column) -> Column:
    """Number of words, given by their hashes, in 3-word windows that the text holds twice or more."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda x, i: F.least(F.lit(3), x - F.get(starts, i)))
        return F.aggregate(gaps, F.lit(3), lambda a, x: a + x)

    def sorted_starts(ranked: Column) -> Column:
        twice = F.filter(ranked, lambda e, j: (e["t"] == F.get(ranked, j + 1)["t"]) | ((j > 0) & (e["t"] == F.get(ranked, F.greatest(j - 1, F.lit(0)))["t"])))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def counted(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ranked, sorted_starts))

    def windows(h: Column) -> Column:
        first = F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0)))
        return let(F.transform(first, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), counted)

    return windows(hashes)


def grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all words, given by their hashes, and of all pairs of neighbouring words."""
    mod = F.lit(buckets).cast("bigint")
    ones = F.transform(hashes, lambda x: F.pmod(x, mod).cast("int"))
    first = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.concat(ones, F.transform(first, lambda x, i: F.pmod(F.xxhash64(x, F.get(hashes, i + 1)), mod).cast("int")))


def multinomials(docs: DataFrame, trusted: DataFrame, buckets: int, trusted_most: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (gram, raw, target): counts over all documents and over the trusted ones."""
    chosen = trusted.select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(trusted_most).withColumn("__trusted", F.lit(1))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.join(F.broadcast(chosen), "__id", "left").select("__trusted", word_array(F.col("__text")).alias("__words"))
    return rows.select("__trusted", F.explode(let(word_hashes(F.col("__words")), lambda h: grams(h, buckets))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("target"))


def weights(counts: DataFrame, buckets: int) -> list[float]:
    """log(p_target / p_raw) of each bucket, add-one smoothed; zeros without trusted n-grams."""
    found = {r.gram: (r.raw, r.target) for r in counts.collect()}
    raw, target = (sum(x[j] for x in found.values()) for j in (0, 1))
    if not target:
        return [0.0] * buckets
    return [round(math.log((found.get(g, (0, 0))[1] + 1) / (target + buckets)) - math.log((found.get(g, (0, 0))[0] + 1) / (raw + buckets)), 6) for g in range(buckets)]


def score(hashes: Column, table: list[float]) -> Column:
    """Mean weight of a text's n-grams (0 without any)."""
    literal = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    total = let(grams(hashes, len(table)), lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(literal, x)) / F.greatest(F.size(g), F.lit(1)))
    return F.round(total, 9)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, trusted_most: int = TRUSTED_MOST) -> DataFrame:
    """One row per input row: the base counts, base_failed, llr and kept. trusted: rows with the ids of trusted documents."""
    table = weights(multinomials(docs, trusted, buckets, trusted_most, id_col, text_col), buckets)
    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = let(word_hashes(word_array(text)), lambda h: F.struct(F.size(h).cast("bigint").alias("n_words"), repeated_words(h).cast("bigint").alias("n_repeat_words"), score(h, table).alias("llr")))
    rows = rows.select(
        "__id",
        found.alias("__f"),
        F.char_length(F.translate(text, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    failed = base_failed(F.col("__f.n_words"), F.col("__f.n_repeat_words"))
    return rows.select(
        F.col("__id").alias(id_col), F.col("__f.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__f.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (F.col("__f.llr") >= threshold)).alias("kept"), F.col("__f.llr").alias("llr"),
    )


def trusted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def filter_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, trusted_most: int = TRUSTED_MOST) -> DataFrame:
    """docs' rows that are kept, with their columns: each is judged where it stands, so no text is shuffled and a null id is no matter."""
    table = weights(multinomials(docs, trusted, buckets, trusted_most, id_col, text_col), buckets)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = let(word_hashes(word_array(text)), lambda h: F.when(base_failed(F.size(h), repeated_words(h)), False).otherwise(score(h, table) >= threshold))
    return docs.filter(kept)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), trusted_rows(spark, sf_dir))
