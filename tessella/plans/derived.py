"""Bins, pixels and annotations derived from order tables, on which the queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.tables import BinTable, PixelTable
from ..sources.frames import with_index
from ..sources.workdir import file_count

SIZE = 10_000
#: Bytes of order lines, as a scan of their columns counts them, for each task that pairs lines or counts pairs.
TASK_BYTES = 2 << 20


def bins(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    named = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = with_index(named.select(F.col("r_name").alias("chrom"), "s_suppkey", "s_acctbal"), "bin_id", ["chrom", "s_suppkey"])
    start = ((F.row_number().over(Window.partitionBy("chrom").orderBy("s_suppkey")) - 1) * SIZE).cast("int")
    return rows.select("bin_id", "chrom", start.alias("start"), (start + SIZE).cast("int").alias("end"), F.when(F.col("s_acctbal") > 0, 1 / F.sqrt("s_acctbal")).alias("weight"), "s_suppkey")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    tasks = file_count(items, TASK_BYTES)  # fixed counts: else few tasks are made of many small partitions, and each grows with the input
    placed = items.join(F.broadcast(bins(spark, sf).select("bin_id", "s_suppkey")), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "bin_id")
    placed = placed.repartition(tasks, "l_orderkey")
    x, y = placed.alias("x"), placed.alias("y")
    met = x.join(y, F.expr("x.l_orderkey = y.l_orderkey and x.l_linenumber < y.l_linenumber"))
    pairs = met.select(F.least("x.bin_id", "y.bin_id").alias("bin1_id"), F.greatest("x.bin_id", "y.bin_id").alias("bin2_id"))
    return pairs.repartition(tasks, "bin1_id", "bin2_id").groupBy("bin1_id", "bin2_id").agg(F.count(F.lit(1)).alias("count"))


def states(spark: SparkSession, sf: str) -> DataFrame:
    lengths = bins(spark, sf).groupBy("chrom").agg(F.max("end").cast("long").alias("length"))
    k = lengths.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / 8500))).alias("k")).where("k % 3 <> 0")
    named = k.join(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type"), F.col("k") == F.col("event_id"))
    return named.select("chrom", (F.col("k") * 8500).alias("start"), F.least(F.col("k") * 8500 + 7000, "length").alias("end"), F.col("event_type").alias("state"))


def bin_table(spark: SparkSession, sf: str) -> BinTable:
    return BinTable(bins(spark, sf).drop("s_suppkey"), spark=spark)


def pixel_table(spark: SparkSession, sf: str) -> PixelTable:
    return PixelTable(pixels(spark, sf), bins=bin_table(spark, sf), spark=spark)


#: The same tables in SQL, as the beginning of a with clause.
SQL = """with bins_all as (
  select row_number() over (order by r_name, s_suppkey) - 1 as bin_id, r_name as chrom,
    cast((row_number() over (partition by r_name order by s_suppkey) - 1) * 10000 as int) as "start",
    cast(row_number() over (partition by r_name order by s_suppkey) * 10000 as int) as "end",
    case when s_acctbal > 0 then 1 / sqrt(s_acctbal) end as weight, s_suppkey
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
bins as (select bin_id, chrom, "start", "end", weight from bins_all),
placed as (select l_orderkey, l_linenumber, bin_id from lineitem join bins_all on l_suppkey = s_suppkey),
pixels as (
  select least(x.bin_id, y.bin_id) as bin1_id, greatest(x.bin_id, y.bin_id) as bin2_id, count(*) as "count"
  from placed x join placed y on x.l_orderkey = y.l_orderkey and x.l_linenumber < y.l_linenumber group by 1, 2),
states as (
  select chrom, k * 8500 as "start", least(k * 8500 + 7000, length) as "end", event_type as state
  from (select chrom, max("end") as length from bins group by chrom) l, (select range as k from range(0, 100000)) r, events
  where k * 8500 < length and k % 3 <> 0 and event_id = k),
"""
