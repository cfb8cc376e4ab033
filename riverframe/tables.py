"""Written intermediate tables for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all is one process, as in tests."""
    if path := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="riverframe-"))


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back. Survives lost executors, and unlike a checkpoint
    it does not carry the constraints of the plan so far, which grow with every round of an iteration."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.riverframe_path = path
    return out


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, in rounds: both are shuffled and none is sent through the driver."""
    return left.join(right.hint("merge"), on, how)


def drop(*tables: DataFrame) -> None:
    """Delete the files of cut() results that no later step reads: call it once what came of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.riverframe_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
