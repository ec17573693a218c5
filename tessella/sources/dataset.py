"""Datasets on disk: a folder with the tables bins and, for contacts, pixels, as Parquet with statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save_dataset(tables: dict[str, DataFrame], path: str, rows: int) -> None:
    """A new folder; one that exists is an OSError. Pixels are sorted within files, so that region filters skip row groups."""
    spark = next(iter(tables.values())).sparkSession
    files, where = _hadoop(spark, path)
    if files.exists(where):
        raise OSError(f"{path} exists")
    for name, df in tables.items():
        keys = ["bin1_id", "bin2_id"] if name == "pixels" else ["bin_id"]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", rows).parquet(f"{path}/{name}")


def load_dataset(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """No folder is an OSError, one with other entries a ValueError."""
    files, where = _hadoop(spark, path)
    if not files.exists(where) or not files.getFileStatus(where).isDirectory():
        raise OSError(f"{path} is not a folder")
    found = {s.getPath().getName() for s in files.listStatus(where)}
    if found != set(names):
        raise ValueError(f"{path} holds {', '.join(sorted(found)) or 'nothing'}, not {', '.join(names)}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def replace_table(df: DataFrame, path: str) -> None:
    """Writes df in the place of the table that it may be read from. The old table is set aside first and only deleted when
    the new one is in place; if that fails it is put back.
    """
    spark = df.sparkSession
    files, where = _hadoop(spark, path)
    _, fresh = _hadoop(spark, path + ".new")
    _, aside = _hadoop(spark, path + ".old")
    df.write.mode("overwrite").parquet(path + ".new")
    files.delete(aside, True)
    if files.exists(where) and not files.rename(where, aside):
        raise OSError(f"{path} can't be set aside")
    if not files.rename(fresh, where):
        files.rename(aside, where)
        raise OSError(f"{path} can't be replaced")
    files.delete(aside, True)
    spark.catalog.refreshByPath(path)
