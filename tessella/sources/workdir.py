"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A stored table gets no more files than one for each so many bytes of what it is made from, and LEAST_FILES.
FILE_BYTES, LEAST_FILES = 8 << 20, 8

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, an own folder if the master is local, as in tests, else a ValueError."""
    global _own
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def file_count(df: DataFrame, each: int = FILE_BYTES) -> int:
    """How many files of each bytes a table made from df may have: by Catalyst's size of df, for a scan that of its files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 20, max(LEAST_FILES, -(-size // each)))


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, survives lost executors.

    files: the most files it may have, so that many small tasks don't leave as many small files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a stored table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
