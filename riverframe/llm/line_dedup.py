"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct 5-word shingles after lower-casing (a shorter line is one token); lines
of fewer than `min_words` words are left alone. A line goes when a line of an earlier (id, position) has
the same tokens or a Jaccard similarity of num/den or more with it; earlier lines count whether or not
they stay themselves.

1. Rarity: counts of all shingles by hashed bucket (a table of fixed size) rank the buckets; a token is a
   63-bit hash that starts with its bucket's rank, so sorting numbers puts rare tokens first.
2. Lines with equal token sets collapse by a 128-bit digest; the first stands for them.
3. Prefix filter: two similar sets share a token among the first n - ceil(t n) + 1 of each. Only tokens
   that several sets have in their prefixes go on. Sets too small to be similar to any but an equal one
   have no prefix.
4. Length and positional filters cut pairs; the rest are verified on their whole token sets. Each set is
   first held against the most copied set of each of its tokens, and only what that does not settle is
   held against all earlier ones, so a large group of variants of one line makes no pairs among itself.

Null texts stay null, empty ones empty; the lines that stay are joined by line feeds. Rows without an id
pass unchanged. Rows of equal id and text share their lines' fate; rows of equal id and different texts
are ordered by a hash of the text. A line of any length is one array of its task; positions are ints, so
more than 2^31 words in a line are beyond Spark's arrays. An empty table gives an empty result, other
columns pass through dedup_lines() untouched, whatever their names (those starting with __ excepted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, keyed, let, measured, size_at_most, table

WORDS, NUM, DEN, MIN_WORDS = 5, 80, 100, 1
BUCKET_BITS, LOW_BITS = 14, 49
#: Most bytes of line numbers that may be broadcast to meet their texts; more are joined by a shuffle.
BROADCAST_MOST = 8 << 20


def plain(text: Column) -> Column:
    """The text in lower case with spaces for other white space than line feeds."""
    odd = [text.contains(c) for c in "\t\x0b\f\r"]
    return F.lower(F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text))


def word_hashes(line: Column) -> Column:
    return F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w))


def line_words(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """Rows (doc, line, h): hashes of the words of each line that takes part."""
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(plain(F.col(text)), "\n")).alias("line", "x"))
    # The pattern reads no farther than the words that are asked for; a filter on h would make h twice.
    return lines.filter(F.col("x").rlike(f"^ *(?:[^ ]+ +){{{max(1, min_words) - 1}}}[^ ]")).select("doc", "line", word_hashes(F.col("x")).alias("h"))


def rarity(lines: DataFrame) -> Column:
    """Rank of each bucket of shingles by how many shingles of all lines it holds, rare first, as an array."""
    count = F.greatest(F.size("h") - WORDS + 1, F.lit(0))
    runs = lines.select(F.inline(F.arrays_zip(*[F.slice("h", j + 1, count).alias(f"w{j}") for j in range(WORDS)])))
    bucket = F.shiftrightunsigned(F.xxhash64(*[f"w{j}" for j in range(WORDS)]), 64 - BUCKET_BITS)
    found = runs.select(bucket.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    ranks = [0] * (1 << BUCKET_BITS)
    for rank, r in enumerate(sorted(found, key=lambda r: (r.n, r.b))):
        ranks[r.b] = rank
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def token_set(h: Column, ranks: Column) -> Column:
    """The sorted distinct tokens of a line's word hashes, rare first."""
    low = F.lit((1 << LOW_BITS) - 1)
    runs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - WORDS + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WORDS)]))
    ranked = F.transform(runs, lambda t: F.shiftleft(F.get(ranks, F.shiftrightunsigned(t, 64 - BUCKET_BITS).cast("int")), LOW_BITS).bitwiseOR(t.bitwiseAND(low)))
    return F.when(F.size(h) < WORDS, F.array(F.xxhash64(h).bitwiseAND(F.lit((1 << 63) - 1)))).otherwise(F.sort_array(F.array_distinct(ranked)))


def token_lines(lines: DataFrame, ranks: Column) -> DataFrame:
    """(doc, line, t): the token set of each line."""
    return lines.select("doc", "line", let(F.col("h"), lambda h: token_set(h, ranks)).alias("t"))


def signed_lines(lines: DataFrame, ranks: Column, num: int, den: int) -> DataFrame:
    """(doc, line, d1, d2, n, prefix), d1 and d2 the digest of a line's token set.

    Prefix tokens are cut to their first 40 bits: chance agreements only add pairs, which are verified."""
    n = F.size("t")
    length = F.when(n * (den - num) >= num, n - F.ceil(n * num / den).cast("int") + 1).otherwise(0)
    prefix = F.transform(F.slice("t", 1, length), lambda x: F.shiftright(x, BUCKET_BITS + LOW_BITS - 40))
    return token_lines(lines, ranks).select("doc", "line", F.xxhash64("t").alias("d1"), F.xxhash64(F.lit(7), "t").alias("d2"), n.alias("n"), prefix.alias("prefix"))


def earlier(a: str, b: str) -> Column:
    return (F.col(f"{a}_doc") < F.col(f"{b}_doc")) | ((F.col(f"{a}_doc") == F.col(f"{b}_doc")) & (F.col(f"{a}_line") < F.col(f"{b}_line")))


def possible(num: int, den: int) -> Column:
    """Length and positional filters on sets a and b that share a token at a_at and b_at (from 0)."""
    both = F.col("a_n") + F.col("b_n")
    length = F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num
    overlap = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    return length & (overlap * (den + num) >= both * num)


def later_matches(rows: DataFrame, key: str, text: str, unique: bool, num: int, den: int, min_words: int) -> DataFrame:
    """Distinct (doc, line) of the lines to remove, as a table."""
    lines = line_words(rows, key, text, min_words)
    ranks = rarity(lines)
    signed = table(signed_lines(lines, ranks, num, den), "lines")
    groups = signed.groupBy("d1", "d2").agg(F.min(F.struct("doc", "line", "n", "prefix")).alias("first"), F.count(F.lit(1)).alias("copies"))
    postings = groups.select("copies", "first.*").select("doc", "line", "n", "copies", F.posexplode("prefix").alias("at", "token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    postings = table(postings.join(shared.hint("shuffle_hash"), "token"), "postings")
    kinds = ("doc", "line", "n", "at")
    b = postings.select("token", *[F.col(c).alias(f"b_{c}") for c in kinds])
    a = postings.select("token", *[F.col(c).alias(f"a_{c}") for c in kinds])
    hub = postings.groupBy("token").agg(F.min(F.struct((-F.col("copies")).alias("k"), *kinds)).alias("h")).select("token", *[F.col(f"h.{c}").alias(f"a_{c}") for c in kinds])
    ends = ["a_doc", "a_line", "b_doc", "b_line"]
    near_hub = table(b.join(hub, "token").filter(earlier("a", "b") & possible(num, den)).select(*ends).distinct(), "pairs")
    settled = matched(rows, near_hub, key, text, unique, ranks, num, den)
    rest = b.join(settled, ["b_doc", "b_line"], "left_anti")
    pairs = table(rest.join(a, "token").filter(earlier("a", "b") & possible(num, den)).select(*ends).distinct().join(near_hub, ends, "left_anti"), "pairs")
    drop(postings, near_hub)
    more = matched(rows, pairs, key, text, unique, ranks, num, den)
    gone = settled.union(more).select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line"), F.lit(True).alias("gone"))
    judged = groups.select("d1", "d2", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), "copies").join(gone, ["doc", "line"], "left").filter("gone or copies > 1").select("d1", "d2", F.col("doc").alias("first_doc"), F.col("line").alias("first_line"), "gone")
    later = F.col("gone").isNotNull() | (F.col("doc") != F.col("first_doc")) | (F.col("line") != F.col("first_line"))
    out = table(signed.select("doc", "line", "d1", "d2").join(judged, ["d1", "d2"]).filter(later).select("doc", "line").distinct(), "gone")
    drop(signed, pairs, settled, more)
    return out


def matched(rows: DataFrame, pairs: DataFrame, key: str, text: str, unique: bool, ranks: Column, num: int, den: int) -> DataFrame:
    """Distinct (b_doc, b_line) of the pairs whose whole token sets are similar, as a table."""
    wanted = pairs.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")).union(pairs.select("b_doc", "b_line"))
    wanted = table(wanted.groupBy("doc").agg(F.collect_set("line").alias("__wanted")), "wanted")
    few = size_at_most(wanted, 16 + 4 * F.size("__wanted"), BROADCAST_MOST)
    of = rows.select(F.col(key).alias("doc"), F.col(text).alias("x")).join(F.broadcast(wanted) if few else wanted, "doc")
    lines = let(F.split(plain(F.col("x")), "\n"), lambda x: F.transform("__wanted", lambda i: F.struct(i.alias("line"), F.get(x, i).alias("x"))))
    lines = of.select("doc", F.inline(lines)).select("doc", "line", word_hashes(F.col("x")).alias("h"))
    found = token_lines(lines, ranks)
    found = table(found if unique else found.dropDuplicates(["doc", "line"]), "tokens")
    a, b = (found.select(F.col("doc").alias(f"{x}_doc"), F.col("line").alias(f"{x}_line"), F.col("t").alias(f"{x}_t")) for x in "ab")
    inter, both = F.size(F.array_intersect("a_t", "b_t")), F.size("a_t") + F.size("b_t")
    out = table(pairs.join(a, ["a_doc", "a_line"]).join(b, ["b_doc", "b_line"]).filter(inter * (den + num) >= both * num).select("b_doc", "b_line").distinct(), "matched")
    drop(wanted, found)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later matches taken out of the text; with counts also n_lines and n_removed."""
    rows, _, unique = keyed(docs, id_col, text_col)
    with measured(docs.sparkSession, BROADCAST_MOST):
        found = later_matches(rows.filter(F.col("__key").isNotNull()), "__key", text_col, unique, num, den, min_words)
    gone = found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    if size_at_most(gone, 16 + 4 * F.size("__gone"), BROADCAST_MOST):
        gone = F.broadcast(gone)
    joined = rows.join(gone, F.col("__key") == F.col("__doc"), "left")
    split = F.split(F.col(text_col), "\n")
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains("__gone", i)), "\n"))
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("bigint")
    columns = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([F.greatest(n_lines, F.lit(0)).alias("n_lines"), F.greatest(F.coalesce(F.size("__gone"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_removed")] if counts else []))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
),
w AS (SELECT doc_id, pos, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
s AS (
  SELECT doc_id, pos, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM w WHERE len(w) >= 1
),
t AS (SELECT doc_id, pos, len(s) AS n, unnest(s) AS t FROM s),
gone AS (
  SELECT b.doc_id, b.pos FROM t a JOIN t b ON a.t = b.t AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.pos < b.pos)
  GROUP BY a.doc_id, a.pos, b.doc_id, b.pos, a.n, b.n HAVING count(*) * 180 >= (a.n + b.n) * 80
),
g AS (SELECT DISTINCT doc_id, pos FROM gone),
k AS (
  SELECT l.doc_id, count(g.pos) AS n_removed, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
