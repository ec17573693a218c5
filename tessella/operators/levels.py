"""What follows the inference of nested partitions, as plain relational steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def kept_levels(counts: list[int], vertices: int) -> list[int]:
    """Of cluster counts by level, the levels that stay: up to the first that repeats the one before, or is 1 above level
    0; then leading levels of singletons go while more than one level is left.
    """
    kept = []
    for level, n in enumerate(counts):
        if level and (n == counts[level - 1] or n == 1):
            break
        kept.append(level)
    while len(kept) > 1 and counts[kept[0]] == vertices:
        kept.pop(0)
    return kept


def trimmed(levels: DataFrame) -> DataFrame:
    """(bin_id, level, cluster) with only kept levels, counted from 0 again."""
    rows = levels.groupBy("level").agg(F.countDistinct("cluster").alias("n"), F.count(F.lit(1)).alias("v")).orderBy("level").collect()  # a row a level
    kept = kept_levels([r.n for r in rows], rows[0].v if rows else 0)
    out = levels.where(F.col("level").isin(kept))
    for new, old in enumerate(kept):
        out = out.withColumn("level", F.when(F.col("level") == old, new).otherwise(F.col("level")))
    return out.select("bin_id", F.col("level").cast("int").alias("level"), "cluster")


def dense_levels(levels: DataFrame) -> DataFrame:
    """Cluster ids of each level become 1, 2, ... in their order."""
    # only the different clusters are ranked, not all bins of a level
    ranks = levels.select("level", "cluster").distinct().withColumn("__rank", F.row_number().over(Window.partitionBy("level").orderBy("cluster")).cast("int"))
    return levels.join(ranks, ["level", "cluster"]).withColumn("cluster", F.col("__rank")).select(*levels.columns)


def wide_levels(levels: DataFrame, n: int) -> DataFrame:
    """bin_id with a column level_(k) for each level k below n."""
    return levels.groupBy("bin_id").agg(*[F.max(F.when(F.col("level") == k, F.col("cluster"))).alias(f"level_({k})") for k in range(n)])


def project_to_edges(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(bin1_id, bin2_id, level, cluster): the cluster of both ends where they share it, else 0."""
    one = levels.select(F.col("bin_id").alias("bin1_id"), "level", F.col("cluster").alias("c1"))
    two = levels.select(F.col("bin_id").alias("bin2_id"), "level", F.col("cluster").alias("c2"))
    both = edges.select("bin1_id", "bin2_id").join(one, "bin1_id").join(two, ["bin2_id", "level"])
    return both.select("bin1_id", "bin2_id", "level", F.when(F.col("c1") == F.col("c2"), F.col("c1")).otherwise(0).alias("cluster"))


def pixel_groups(original: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """(bin1_id, bin2_id, pix_group, pix_prob): 0 in both, 1 only reconstructed, 2 only original, with probability 0."""
    old = original.select("bin1_id", "bin2_id", F.lit(True).alias("old"))
    new = reconstructed.select("bin1_id", "bin2_id", "pix_prob", F.lit(True).alias("new"))
    group = F.when(F.col("old") & F.col("new"), 0).when(F.col("new"), 1).otherwise(2)
    return old.join(new, ["bin1_id", "bin2_id"], "full_outer").select("bin1_id", "bin2_id", group.alias("pix_group"), F.coalesce("pix_prob", F.lit(0.0)).alias("pix_prob"))


def bin_probability(samples: DataFrame) -> DataFrame:
    """(bin_id, bin_prob): share of the most frequent cluster over sampled partitions (bin_id, cluster, n)."""
    return samples.groupBy("bin_id").agg((F.max("n") / F.sum("n")).alias("bin_prob"))
