"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regex of a word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all is one process, as in tests."""
    if path := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="riverframe-"))


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs within; then as before."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def measured(spark: SparkSession, most: int) -> contextlib.AbstractContextManager[None]:
    """Within, Spark broadcasts on its own only what it has shuffled and found to be `most` bytes or less.

    It guesses a table by its files otherwise, which hold repeated hashes once: exploded, they may take fifty times as much."""
    return settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": str(most)})


def table(df: DataFrame, name: str, batch: int | None = None, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go as soon as it has ended, not when the driver next collects garbage. With `batch`,
    Arrow functions get so many rows at a time: what a task holds of whole texts on either side of the pipe."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.riverframe_path = path
    return out


def give_back() -> None:
    """Return to the system what an Arrow function has freed: worker processes stay after a task, and others need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def drop(*tables: DataFrame) -> None:
    """Delete the files of table() results that no later step reads: call it once what came of them is written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.riverframe_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII texts take the fast built-in; others are translated letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as bigint (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def size_at_most(df: DataFrame, row_bytes: Column, most: int) -> bool:
    """Whether the rows of df, of row_bytes each, take at most `most` bytes together: the check before a broadcast."""
    return (df.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0) <= most


def keyed(docs: DataFrame, id_col: str, text_col: str, name: str = "__key") -> tuple[DataFrame, DataFrame | None, bool]:
    """(docs with a bigint key in column `name`, the table (key, id) that names keys or None where they are the ids, whether no key repeats).

    Keys are ids where no id has two different texts. Otherwise keys number the distinct (id, text) in that
    order, so rows of equal id and text share a key and rows of equal id and different texts do not. A null
    id has a null key."""
    docs_id, digest = F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.filter(docs_id.isNotNull()).select(docs_id.alias("id"), digest.alias("v"))
    seen = texts.groupBy("id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).agg(F.bool_or(F.expr("low <> high")).alias("several"), F.max("n").alias("n")).first()
    unique = (seen.n or 0) <= 1
    if not seen.several:
        return docs.withColumn(name, docs_id), None, unique
    pairs = table(texts.distinct().repartitionByRange("id", "v").select("id", "v", F.spark_partition_id().alias("part")), "ids")
    counts = sorted((r.part, r.n) for r in pairs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for part, n in counts:
        starts[part], total = total, total + n
    first = F.create_map(*[F.lit(x) for item in starts.items() for x in item])[F.col("part")]
    place = F.row_number().over(Window.partitionBy("part").orderBy("id", "v"))
    names = table(pairs.select((first + place).cast("bigint").alias(name), "id", "v"), "keys")
    drop(pairs)
    of = names.select(name, F.col("id").alias("__id"), F.col("v").alias("__v"))
    return docs.join(of, (docs_id == F.col("__id")) & (digest == F.col("__v")), "left").drop("__id", "__v"), names.select(name, "id"), unique
