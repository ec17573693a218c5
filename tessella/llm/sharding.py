"""Sharding by a hierarchical weighted hash tree.

A tree is a list of leaves (region, rack, shard, weight). A key descends region, rack and shard: at each level every child
draws -ln(u)/weight from a hash of key and child, and the least draw wins. A child's weight is the sum below it. A
changed weight changes the draws of its ancestors only, so rows move into or out of these subtrees only. A shard that is added
takes a region of its own, so that what moves to it can't land on any other shard.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import file_count, stored, table

SHARDS = 40
SHARDS_PER_RACK, RACKS_PER_REGION = 5, 2
#: Parts of a shard that are numbered at the same time.
LANES = 64

Leaf = tuple[int, int, int, int]


def layout(shards: int, base: int = SHARDS, per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION) -> list[Leaf]:
    """The tree of a shard count: full racks and regions up to base, then a region of its own for each further shard."""
    leaves = [(s // (per_rack * racks), s // per_rack, s, 1) for s in range(min(shards, base))]
    regions, rack = math.ceil(base / (per_rack * racks)), math.ceil(base / per_rack)
    return leaves + [(regions + i, rack + i, s, 1) for i, s in enumerate(range(base, shards))]


def draw(key: Column, level: str, child: int, weight: float) -> Column:
    """An exponential draw at the rate of weight, from 52 bits of the key's hash with the child."""
    digest = F.md5(F.concat(key, F.lit(f"/{level}{child}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / float(weight)


def _least(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[F.struct(draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(weights.items())])).c


def descend(rows: DataFrame, key: Column, leaves: list[Leaf], out: str) -> DataFrame:
    """Adds the shard of each row's key under the name out."""
    regions, racks, shards = defaultdict(float), defaultdict(lambda: defaultdict(float)), defaultdict(dict)
    for region, rack, shard, weight in leaves:
        regions[region] += weight
        racks[region][rack] += weight
        shards[rack][shard] = weight
    pick = lambda at, level, below: F.coalesce(*[F.when(at == parent, _least(key, level, dict(children))) for parent, children in sorted(below.items())])
    kept = rows.columns
    rows = rows.withColumn("__region", _least(key, "region", dict(regions)))
    rows = rows.withColumn("__rack", pick(F.col("__region"), "rack", racks))
    return rows.withColumn(out, pick(F.col("__rack"), "shard", shards).cast("int")).select(*kept, out)


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null doc_id has the key "null"; repeated doc_ids go together; a null text has no bytes. Slots number a shard's
    rows from 0 without gaps: in LANES parts by a hash of doc_id, each numbered by doc_id after the rows of the parts before it.
    A very long text counts with all its bytes. An empty table gives no rows. Other columns, whatever their names, play no part.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = descend(descend(rows, key, layout(shards), "shard"), key, layout(shards + 1), "grown_shard")
    files = file_count(docs)
    rows = stored(rows.withColumn("__lane", F.expr(f"cast(conv(substring(md5(coalesce(cast(doc_id as string), 'null') || '/lane'), 1, 4), 16, 10) as int) % {LANES}")), "shards", files)
    lanes = rows.groupBy("shard", "__lane").count()  # shards * LANES rows at most
    before = Window.partitionBy("shard").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lanes.select("shard", "__lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    in_lane = Window.partitionBy("shard", "__lane").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("__nth", F.row_number().over(in_lane) - 1).join(F.broadcast(offsets), ["shard", "__lane"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__nth")).cast("long").alias("slot"), "grown_shard").coalesce(files)


def op6_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents"))


def op6_sql(shards: int = SHARDS) -> str:
    """The same in DuckDB. CRC-32 is folded over bytes with the reflected polynomial's table."""

    def pick(level: str, parent: str | None, pairs: list[tuple[int, int, float]]) -> str:
        rows = ", ".join(f"({p}, {c}, {w}.0)" for p, c, w in pairs)
        on = f"t.parent = {parent}" if parent else "true"
        return f"(select arg_min(c, -ln((cast('0x' || substr(md5(k || '/{level}' || c), 1, 13) as bigint) + 0.5) / 4503599627370496.0) / w) from (values {rows}) t(parent, c, w) where {on})"

    def tree(n: int) -> tuple[list, list, list]:
        regions, racks, leaves = defaultdict(int), defaultdict(int), []
        for region, rack, shard, weight in layout(n):
            regions[region] += weight
            racks[region, rack] += weight
            leaves.append((rack, shard, weight))
        return [(0, r, w) for r, w in regions.items()], [(a, b, w) for (a, b), w in racks.items()], leaves

    steps, last = [], "base"
    for name, n in (("shard", shards), ("grown_shard", shards + 1)):
        regions, racks, leaves = tree(n)
        steps.append(f"r_{name} as (select *, {pick('region', None, regions)} as g_{name} from {last})")
        steps.append(f"k_{name} as (select *, {pick('rack', f'r_{name}.g_{name}', racks)} as a_{name} from r_{name})")
        steps.append(f"s_{name} as (select *, {pick('shard', f'k_{name}.a_{name}', leaves)} as {name} from k_{name})")
        last = f"s_{name}"
    return f"""
with recursive bits(b, v, i) as (
  select range, cast(range as bigint), 0 from range(256)
  union all select b, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i + 1 from bits where i < 8),
crc as (select list(v order by b) as t from bits where i = 8),
base as (
  select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, octet_length(encode(coalesce(text, ''))) + 16 as size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(coalesce(text, ''))), 2), lambda i: cast('0x' || substr(hex(encode(coalesce(text, ''))), i, 2) as bigint))),
      lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) as text_crc32
  from documents, crc),
{", ".join(steps)}
select doc_id, size, text_crc32, 'key' as law, cast(shard as int) as shard, cast(grown_shard as int) as grown_shard,
  row_number() over (partition by shard order by cast('0x' || substr(md5(k || '/lane'), 1, 4) as bigint) % {LANES}, doc_id, text_crc32, size) - 1 as slot
from {last}"""
