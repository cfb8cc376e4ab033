"""Ranked lexical search: the k best documents of every query by a threshold-seeded join.

Scores are integers: a term's weight w comes from the number of documents that hold it, a posting's impact from
the term's frequency and the document's length, and a score sums weight times impact over the query's terms,
repeats included (`op13_search` states the figures). All queries are answered together:

1. One pass counts each document's terms and keeps those that some query has (one row per document, written).
2. Each term stores its k postings of highest impact. A query's sums over the stored postings of its terms bound
   the scores of the documents they name from below; the kth of them, made tight by scoring those documents
   exactly, bounds the query's kth score from below: its threshold.
3. A query's terms stand by their highest possible contribution. Terms whose contributions from there to the end
   add up to less than the threshold are pruned: a document that holds only such terms cannot rank.
4. The other terms are joined with their postings. Documents whose sum, with all that pruned terms could add,
   reaches the threshold are candidates. The kth of their sums raises the threshold once more; those that still
   reach it are scored exactly over all terms, and the best k are kept.

Thresholds, bounds and scores are whole numbers, so nothing is lost to rounding, and ties at the kth score stay
among the candidates.

Documents without terms, null texts among them, are found by nothing; queries without terms find nothing. Equal
scores rank by id, rows without an id last. Rows that repeat an id are documents, or queries, of their own, and
equal ones rank in any order. Ids may be of any type that has an order. Empty tables give an empty result and
other columns are ignored. Texts of any length are counted a block at a time.

A common term's postings never meet in one task where the queries are small enough to broadcast, which is checked
by bytes (BROADCAST_MOST); otherwise they are shuffled by term and by a salt.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, size_at_most, table

#: Separators become spaces and A-Z becomes a-z; letters, digits and all bytes of other characters are terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text that are split at a time, rows that go back to Spark at a time.
BLOCK, ROWS = 1 << 20, 512
#: Most bytes of query terms that are sent to all tasks; salts of a term where there are more.
BROADCAST_MOST, SALTS = 8 << 20, 64


def term_counts(text: bytes, block: int = BLOCK) -> Counter:
    """How often each term occurs."""
    counts: Counter = Counter()
    rest = b""
    for at in range(0, len(text), block):
        part = rest + text[at : at + block].translate(FOLD)
        if at + block >= len(text):
            counts.update(part.split())
        else:
            cut = part.rfind(b" ") + 1
            counts.update(part[:cut].split())
            rest = part[cut:]
    return counts


def counted(docs: DataFrame, id_col: str, text_col: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """Rows (id, n, terms, tfs) of texts that have terms: n counts all of them, the arrays hold those that are wanted (None: all)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = batch.column(1).cast(pa.large_binary())
            keep, n, terms, tfs = [], [], [], []
            for k, text in enumerate(texts):
                counts = term_counts(text.as_py() or b"")
                if counts:
                    names = list(counts) if wanted is None else list(counts.keys() & wanted)
                    keep.append(k)
                    n.append(counts.total())
                    terms.append(names)
                    tfs.append([counts[t] for t in names])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))], ["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n bigint, terms array<string>, tfs array<int>")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def impact(tf: Column, m: Column) -> Column:
    return div(F.lit(1_000_000_000) * tf.cast("bigint"), F.lit(1000) * tf.cast("bigint") + F.lit(8) * m)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Rows (query id, rank, id, score): each query's k best documents."""
    spark = docs.sparkSession
    asked = table(counted(queries, query_id, query_text).withColumn("item", F.monotonically_increasing_id()), "queries")
    query_terms = table(asked.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("item", F.col("x.terms").alias("term"), F.col("x.tfs").cast("bigint").alias("q")), "query-terms")
    wanted = query_terms.select("term").distinct()
    small = size_at_most(query_terms, F.octet_length("term") + 32, BROADCAST_MOST)
    vocabulary = frozenset(r.term.encode() for r in wanted.collect()) if small else None
    texts = table(counted(docs, id_col, text_col, vocabulary).withColumn("doc", F.monotonically_increasing_id()), "terms")
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total.n, total.l or 1
    m = F.lit(25) + div(F.lit(75).cast("bigint") * F.col("n") * F.lit(n_docs), F.lit(n_terms).cast("bigint"))
    rows = texts.select("doc", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    postings = rows.select("doc", F.col("x.terms").alias("term"), impact(F.col("x.tfs"), F.col("m")).alias("impact"))
    if not small:
        postings = postings.join(wanted, "term", "left_semi")

    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weights = table(query_terms.join(frequency, "term").select("item", "term", (F.col("q") * weight).alias("qw"), "df", "most").filter("qw > 0"), "weights")
    mine = F.broadcast(weights) if small else weights

    def scored(found: DataFrame) -> DataFrame:
        """From rows (item, doc): with the exact score."""
        few = size_at_most(found, F.lit(24), BROADCAST_MOST)
        pairs = (F.broadcast(found) if few else found).join(texts, "doc").select("item", "doc", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        each = pairs.select("item", "doc", F.col("x.terms").alias("term"), impact(F.col("x.tfs"), F.col("m")).alias("impact"))
        return each.join(mine.select("item", "term", "qw"), ["item", "term"]).groupBy("item", "doc").agg(F.sum(F.col("qw") * F.col("impact")).alias("score"))

    def kth(sums: DataFrame) -> DataFrame:
        best = sums.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("r") <= k)
        return best.groupBy("item").agg(F.min(F.when(F.col("r") == k, F.col("score"))).alias("threshold"))

    top = Window.partitionBy("term").orderBy(F.desc("impact"), "doc")
    stored = table(postings.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k).drop("r"), "stored")
    seeds = mine.select("item", "term", "qw").join(stored, "term").groupBy("item", "doc").agg(F.sum(F.col("qw") * F.col("impact")).alias("score"))
    seeds = seeds.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))).filter(F.col("r") <= 4 * k)
    seeds = table(seeds.select("item", "doc"), "seeds")
    thresholds = table(kth(scored(seeds)), "thresholds")

    upto = Window.partitionBy("item").orderBy(F.desc("bound"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    bounds = weights.withColumn("bound", F.col("qw") * F.col("most")).withColumn("suffix", F.sum("bound").over(upto))
    bounds = bounds.join(thresholds, "item", "left").withColumn("threshold", F.greatest(F.coalesce("threshold", F.lit(1)), F.lit(1)))
    plan = table(bounds.withColumn("kept", F.col("suffix") >= F.col("threshold")), "bounds")
    rest = plan.groupBy("item").agg(F.first("threshold").alias("threshold"), F.sum(F.when(~F.col("kept"), F.col("bound")).otherwise(0)).alias("rest"))
    essential = plan.filter("kept").select("item", "term", "qw")
    if small:
        met = postings.join(F.broadcast(essential), "term")
    else:
        salted = essential.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = postings.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    sums = met.groupBy("item", "doc").agg(F.sum(F.col("qw") * F.col("impact")).alias("partial"))
    rest = F.broadcast(rest) if small else rest
    candidates = table(sums.join(rest, "item").filter(F.col("partial") + F.col("rest") >= F.col("threshold")).select("item", "doc", "partial", "rest"), "candidates")
    # What candidates have so far bounds the kth score from below as well, and closer.
    closer = kth(candidates.select("item", F.col("partial").alias("score")))
    closer = F.broadcast(closer) if small else closer
    candidates = table(candidates.join(closer, "item").filter(F.col("threshold").isNull() | (F.col("partial") + F.col("rest") >= F.col("threshold"))).select("item", "doc"), "rescored")

    final = scored(candidates).filter("score > 0").join(texts.select("doc", F.col("id").alias("__id")), "doc")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("__id"), "doc")
    ranked = final.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", F.col("id").alias("__item")), "item").select(F.col("__item").alias(query_id), "rank", F.col("__id").alias(id_col), "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents: w = floor(1000 ln((2N + 2) / (2 df + 1))), impact = (10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT doc_id, t, len(t)::BIGINT AS n FROM f WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY doc_id, n, term),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * (SELECT nd FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
r AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * s.nd) // s.l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
