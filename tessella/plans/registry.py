"""Queries over the derived tables, each with its SQL where SQL can express it. Computed numbers are rounded alike in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.normalisers import log_count
from ..operators import annotate, expected, graph, levels
from ..operators.overlap import overlap_join
from ..operators.strategies import annotate_pixels, balance_pixels, over_stream, subset_region
from ..operators.tables import BinTable, PixelTable, written_back
from ..sources.workdir import new_path
from ..streaming.chunks import pixel_counts
from .derived import SIZE, SQL as TABLES, bin_table, bins, pixel_table, pixels, states
from .plotdata import BinTrack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REGION, WHOLE = "ASIA:20000-90000", "EUROPE"
#: Least count of the pixels that make a sparse map.
SPARSE = 25
_ASIA = """b as (select * from bins where chrom = 'ASIA' and "start" >= 20000 - 9999 and "end" <= 90000 + 9999),
ext as (select min(bin_id) as lo, max(bin_id) + 1 as hi from b),
sub as (select p.* from pixels p, ext where bin1_id >= lo and bin1_id < hi and bin2_id >= lo and bin2_id < hi)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = TABLES + sql.strip()
        return f

    return add


@query('x as (select 1) select bin_id, chrom, "start", "end", round(weight, 9) as weight from bins')
def bin_scan(spark, sf):
    return bin_table(spark, sf).df.withColumn("weight", F.round("weight", 9))


@query('x as (select 1) select bin_id, chrom, "start", "end", "end" - "start" as bin_size from bins order by bin_id limit 1')
def bin_first_row(spark, sf):
    t = bin_table(spark, sf)
    return t.df.orderBy("bin_id").limit(1).select("bin_id", "chrom", "start", "end", F.lit(t.bin_size).alias("bin_size"))


@query(f"{_ASIA} select bin1_id, bin2_id, \"count\" from sub")
def region_subset(spark, sf):
    return pixel_table(spark, sf).subset(REGION).df


@query(f"{_ASIA} select lo as lower_id, hi as upper_id from ext")
def extent(spark, sf):
    lo, hi = bin_table(spark, sf).extent(REGION)
    return spark.createDataFrame([(lo, hi)], "lower_id long, upper_id long")


@query("""b as (select * from bins where chrom = 'ASIA' and "start" < 90000 and "end" > 20000) select bin_id, chrom, "start", "end" from b""")
def region_strict(spark, sf):
    return bin_table(spark, sf).get_dataframe(REGION, strict=True).select("bin_id", "chrom", "start", "end")


_SIDES = """p.bin1_id, p.bin2_id, "count", a.chrom as chrom1, a."start" as start1, a."end" as end1, round(a.weight, 9) as weight1,
c.chrom as chrom2, c."start" as start2, c."end" as end2, round(c.weight, 9) as weight2"""


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 9) for c in names})


@query(f"x as (select 1) select {_SIDES} from pixels p left join bins a on a.bin_id = p.bin1_id left join bins c on c.bin_id = p.bin2_id")
def annotate_both_sides(spark, sf):
    return _rounded(annotate_pixels(pixels(spark, sf), bins_df=bin_table(spark, sf).df), "weight1", "weight2")


@query('x as (select 1) select bin1_id, bin2_id, round("count" * a.weight * c.weight, 9) as "count" from pixels join bins a on a.bin_id = bin1_id join bins c on c.bin_id = bin2_id where a.weight is not null and c.weight is not null')
def balance(spark, sf):
    return _rounded(balance_pixels(pixels(spark, sf), bins_df=bin_table(spark, sf).df), "count")


@query('x as (select 1) select bin1_id, bin2_id, round("count" * a.weight * c.weight, 9) as "count" from pixels left join bins a on a.bin_id = bin1_id left join bins c on c.bin_id = bin2_id')
def balance_keep_masked(spark, sf):
    return _rounded(balance_pixels(pixels(spark, sf), bins_df=bin_table(spark, sf).df, drop_nulls=False), "count")


@query(f"""{_ASIA}, q as (
  select s.bin1_id, s.bin2_id, s."count" * a.weight * c.weight as "count" from sub s join b a on a.bin_id = bin1_id join b c on c.bin_id = bin2_id)
select p.bin1_id, p.bin2_id, round("count", 9) as "count", {_SIDES.split('"count", ')[1]} from q p join b a on a.bin_id = p.bin1_id join b c on c.bin_id = p.bin2_id where "count" is not null""")
def annotate_balance(spark, sf):
    return _rounded(pixel_table(spark, sf).get_dataframe(REGION, balance=True), "count", "weight1", "weight2")


@query(f"""q as (select p.bin1_id, p.bin2_id, p."count" * a.weight * c.weight as "count" from pixels p join bins a on a.bin_id = bin1_id join bins c on c.bin_id = bin2_id)
select p.bin1_id, p.bin2_id, round("count", 9) as "count", {_SIDES.split('"count", ')[1]} from q p join bins a on a.bin_id = p.bin1_id join bins c on c.bin_id = p.bin2_id where "count" is not null""")
def annotate_balance_whole(spark, sf):
    return _rounded(pixel_table(spark, sf).get_dataframe(balance=True), "count", "weight1", "weight2")


@query(f"""{_ASIA}, q as (select s.bin1_id, s.bin2_id, s."count" * a.weight * c.weight as "count" from sub s join b a on a.bin_id = bin1_id join b c on c.bin_id = bin2_id)
select bin1_id, bin2_id, round("count", 9) as "count" from q where "count" > 0.001 and bin1_id <> bin2_id""")
def user_strategies(spark, sf):
    strategies = [lambda df: df.where("count > 0.001"), lambda df: df.where("bin1_id <> bin2_id")]
    return _rounded(pixel_table(spark, sf).get_dataframe(REGION, annotate=False, balance=True, strategies=strategies), "count")


@query(f'x as (select 1) select bin1_id, bin2_id, "count" from pixels where "count" >= {SPARSE}')
def applied_filter(spark, sf):
    return pixel_table(spark, sf).apply(lambda df: df.where(F.col("count") >= SPARSE)).df


@query("""x as (select 1) select bin1_id, bin2_id, "count", bin1_id % 2 = 0 as flag from pixels where (bin1_id + bin2_id) % 3 = 0""")
def pix_annotation_inner(spark, sf):
    t = pixel_table(spark, sf)
    t.add_pix_annotation(t.df.where("(bin1_id + bin2_id) % 3 = 0").select("bin1_id", "bin2_id", (F.col("bin1_id") % 2 == 0).alias("flag")))
    return t.df


@query("""x as (select 1) select bin1_id, bin2_id, "count", case when (bin1_id + bin2_id) % 3 = 0 then bin1_id % 2 = 0 end as flag from pixels""")
def pix_annotation_left(spark, sf):
    t = pixel_table(spark, sf)
    t.add_pix_annotation(t.df.where("(bin1_id + bin2_id) % 3 = 0").select("bin1_id", "bin2_id", (F.col("bin1_id") % 2 == 0).alias("flag")), how="left")
    return t.df


@query('x as (select 1) select bin1_id, bin2_id, "count", round(atan("count" / (select avg("count") from pixels)) / (pi() / 2), 9) as norm_count from pixels')
def normalize_arctan(spark, sf):
    t = pixel_table(spark, sf)
    t.normalize_counts()
    return _rounded(t.df, "norm_count")


@query('x as (select 1) select bin1_id, bin2_id, "count", round(ln("count" + 1), 9) as norm_count from pixels')
def normalize_log(spark, sf):
    t = pixel_table(spark, sf)
    t.normalize_counts(log_count)
    return _rounded(t.df, "norm_count")


_MET = """met as (
  select b.chrom, b."start", b."end", s.state, least(b."end", s."end") - greatest(b."start", s."start") as bp, s."start" as a, s."end" as z
  from bins b join states s on s.chrom = b.chrom and s."start" < b."end" and b."start" < s."end"),
rest as (
  select b.chrom, b."start", b."end", null as state, b."end" - b."start" - coalesce(c.bp, 0) as bp from bins b left join
  (select chrom, "start", "end", sum(bp) as bp from met group by all) c on c.chrom = b.chrom and c."start" = b."start"),
raw as (select chrom, "start", "end", state, bp, 0 as last, a, z from met union all select chrom, "start", "end", state, bp, 1, 0, 0 from rest where bp <> 0),
one as (select chrom, "start", "end", state, sum(bp) as bp, min(last) as last, min(a) as a, min(z) as z from raw group by chrom, "start", "end", state),
frac as (select *, bp / ("end" - "start") as v from one),
rawfrac as (select *, bp / ("end" - "start") as v from raw),
enrich as (select *, log2(1 + (bp / ("end" - "start")) / ((sum(bp) over (partition by chrom, state)) / (sum(bp) over (partition by chrom)))) as v from one)"""


def _label(of: str, ignore: bool) -> str:
    keep = 'where not has or state is not null' if ignore else ""
    return f"""{_MET}, m as (select *, bool_or(state is not null) over (partition by chrom, "start") as has from {of}),
r as (select *, row_number() over (partition by chrom, "start" order by round(v, 9) desc, last, a, z, state) as nth from m {keep})
select bin_id, b.chrom, b."start", b."end", coalesce(r.state, 'None') as state from bins b left join r on r.chrom = b.chrom and r."start" = b."start" and nth = 1"""


@query(f"{_MET} select chrom, \"start\", \"end\", state, bp from met")
def overlap_bp(spark, sf):
    return overlap_join(bin_table(spark, sf).df.select("chrom", "start", "end"), states(spark, sf), SIZE).select("chrom", "start", "end", "state", "bp")


@query(f"{_MET} select chrom, \"start\", \"end\", coalesce(state, 'None') as mod, round(v, 9) as value from enrich")
def annot_candidates(spark, sf):
    found = annotate.candidates(bin_table(spark, sf).df, states(spark, sf), "chrom_enrich", SIZE)
    return found.select("chrom", "start", "end", F.coalesce("mod", F.lit("None")).alias("mod"), F.round("value", 9).alias("value"))


def _annotated(metric: str, **options):
    def run(spark, sf):
        t = bin_table(spark, sf)
        t.add_annotation(states(spark, sf), metric=metric, **options)
        return t.df.drop("weight")

    return run


for _name, _metric, _of, _options in (
    ("annot_frac", "frac_overlap", "frac", {}),
    ("annot_frac_keep_null", "frac_overlap", "frac", {"ignore_null_mode": False}),
    ("annot_frac_unconsolidated", "frac_overlap", "rawfrac", {"consolidate": False}),
    ("annot_frac_unconsolidated_keep_null", "frac_overlap", "rawfrac", {"consolidate": False, "ignore_null_mode": False}),
    ("annot_bp", "bp_overlap", "frac", {}),
    ("annot_enrich", "chrom_enrich", "enrich", {}),
    ("annot_enrich_ignore_null", "chrom_enrich", "enrich", {"ignore_null_mode": True}),
):
    QUERIES[_name] = _annotated(_metric, **_options)
    SQL[_name] = TABLES + _label(_of, _options.get("ignore_null_mode", not _metric.endswith("enrich")))


def annot_pivot(spark, sf):
    t = bin_table(spark, sf)
    t.add_annotation(states(spark, sf), metric="frac_overlap", save_all_mods=True)
    values = [c for c in t.col_names if c.endswith("_frac_overlap")]
    return t.df.select("bin_id", F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_frac_overlap")).alias("mod"), F.round(c, 9).alias("value")) for c in values])).alias("x")).select("bin_id", "x.mod", "x.value").where("value is not null")


QUERIES["annot_pivot"] = annot_pivot
SQL["annot_pivot"] = TABLES + f"{_MET} select bin_id, coalesce(state, 'null') as mod, round(v, 9) as value from frac f join bins b on b.chrom = f.chrom and b.\"start\" = f.\"start\""

_CELLS = f"""ext as (select min(bin_id) as lo, max(bin_id) + 1 as hi from bins where chrom = '{WHOLE}'),
up as (select bin1_id - lo as i, bin2_id - lo as j, cast("count" as double) as value from pixels, ext where "count" >= {SPARSE} and bin1_id >= lo and bin2_id < hi)"""


def _sparse(spark, sf):
    return pixel_table(spark, sf).apply(lambda df: df.where(F.col("count") >= SPARSE))


@query(f"{_CELLS} select i, j, value from up")
def matrix_upper(spark, sf):
    return _sparse(spark, sf).get_matrix_cells(WHOLE, mode="upper")


@query(f"{_CELLS} select j as i, i as j, value from up")
def matrix_lower(spark, sf):
    return _sparse(spark, sf).get_matrix_cells(WHOLE, mode="lower")


@query(f"{_CELLS} select i, j, value from up where i <> j union all select j, i, value from up where i <> j")
def matrix_full_masked(spark, sf):
    return _sparse(spark, sf).get_matrix_cells(WHOLE, mode="full", mask_diagonal=True)


@query(f"""{_CELLS}, al as (select i, j, value from up union all select j, i, value from up where i <> j),
side as (select unnest(range(0, (select hi - lo from ext))) as k)
select a.k as i, c.k as j, value from side a cross join side c left join al on al.i = a.k and al.j = c.k""")
def matrix_complete(spark, sf):
    return _sparse(spark, sf).get_matrix_cells(WHOLE, complete=True)


@query(f"{_CELLS} select i, j, round(log10(value), 9) as value from up where i <> j union all select j, i, round(log10(value), 9) from up where i <> j")
def plot_counts(spark, sf):
    from .plotdata import PixelTrack

    return PixelTrack(_sparse(spark, sf)).cells(WHOLE).where("i <> j").withColumn("value", F.round("value", 9))


_EXPECT = """w as (
  select p.bin1_id, p.bin2_id, a.chrom as chrom1, c.chrom as chrom2, "count" * a.weight * c.weight as v
  from pixels p join bins a on a.bin_id = bin1_id join bins c on c.bin_id = bin2_id where a.weight is not null and c.weight is not null),
cis as (
  select d.chrom, d.dist, case when d.dist >= 2 and n > 0 then coalesce(s.v, 0) / n end as expected
  from (select chrom, bin_id - min(bin_id) over (partition by chrom) as dist from bins) d
  left join (select a.chrom, c.bin_id - a.bin_id as dist, count(*) as n from bins a join bins c on c.chrom = a.chrom and c.bin_id >= a.bin_id and a.weight is not null and c.weight is not null group by all) n on n.chrom = d.chrom and n.dist = d.dist
  left join (select chrom1, bin2_id - bin1_id as dist, sum(v) as v from w where chrom1 = chrom2 group by all) s on s.chrom1 = d.chrom and s.dist = d.dist),
o as (select chrom, min(bin_id) as f, count(weight) as k from bins group by chrom),
trans as (
  select a.chrom as chrom1, c.chrom as chrom2, -1 as dist, coalesce(v, 0) / (a.k * c.k) as expected from o a join o c on a.f < c.f
  left join (select chrom1, chrom2, sum(v) as v from w where chrom1 <> chrom2 group by all) s on s.chrom1 = a.chrom and s.chrom2 = c.chrom where a.k * c.k > 0
  union all select a.chrom, c.chrom, -1, null from o a join o c on a.f < c.f where a.k * c.k = 0),
expected as (select chrom as chrom1, chrom as chrom2, dist, expected from cis union all select * from trans)"""


@query(f"{_EXPECT} select chrom as chrom1, chrom as chrom2, dist, round(expected, 9) as expected from cis")
def expected_cis(spark, sf):
    return _rounded(expected.cis_expected(bin_table(spark, sf).df, pixels(spark, sf)), "expected")


@query(f"{_EXPECT} select chrom1, chrom2, cast(dist as bigint) as dist, round(expected, 9) as expected from trans")
def expected_trans(spark, sf):
    return _rounded(expected.trans_expected(bin_table(spark, sf).df, pixels(spark, sf)), "expected")


@query(f"""{_EXPECT} select bin1_id, bin2_id, w.chrom1, w.chrom2, round(v / expected, 6) as "count" from w join expected e
on e.chrom1 = w.chrom1 and e.chrom2 = w.chrom2 and e.dist = case when w.chrom1 = w.chrom2 then bin2_id - bin1_id else -1 end where expected is not null and v <> 0""")
def oe_pixels(spark, sf):
    own, p = bin_table(spark, sf).df, pixels(spark, sf)
    balanced = annotate_pixels(balance_pixels(p, bins_df=own), bins_df=own.select("bin_id", "chrom"))
    return expected.expected_normalized_pixels(balanced, expected.get_expected_counts(own, p, smooth=None)).withColumn("count", F.round("count", 6))


@query(f"""{_EXPECT.replace("expected as (", "plain as (")},
d as (
  select d.chrom, d.dist, coalesce(n, 0) as n, coalesce(s.v, 0) as v
  from (select chrom, bin_id - min(bin_id) over (partition by chrom) as dist from bins) d
  left join (select a.chrom, c.bin_id - a.bin_id as dist, count(*) as n from bins a join bins c on c.chrom = a.chrom and c.bin_id >= a.bin_id and a.weight is not null and c.weight is not null group by all) n on n.chrom = d.chrom and n.dist = d.dist
  left join (select chrom1, bin2_id - bin1_id as dist, sum(v) as v from w where chrom1 = chrom2 group by all) s on s.chrom1 = d.chrom and s.dist = d.dist),
k as (select a.chrom, a.dist, exp(-0.5 * power((log10(a.dist + 1) - log10(c.dist + 1)) / 0.1, 2)) as k, c.n, c.v from d a join d c on c.chrom = a.chrom and c.dist >= 2),
smooth as (select chrom, dist, case when dist >= 2 and sum(k * n) > 0 then sum(k * v) / sum(k * n) end as expected from k group by chrom, dist)
select chrom as chrom1, chrom as chrom2, cast(dist as bigint) as dist, round(expected, 9) as expected from smooth
union all select d.chrom, d.chrom, cast(d.dist as bigint), null from d where not exists (select 1 from smooth s where s.chrom = d.chrom and s.dist = d.dist)
union all select chrom1, chrom2, cast(dist as bigint), round(expected, 9) from trans""")
def expected_smoothed(spark, sf):
    return _rounded(expected.get_expected_counts(bin_table(spark, sf).df, pixels(spark, sf)), "expected")


_LINKS = f"""e as (select bin1_id, bin2_id, "count", false as genomic from pixels where "count" >= {SPARSE} and bin1_id <> bin2_id),
near as (select bin_id as bin1_id, lead(bin_id) over (partition by chrom order by bin_id) as bin2_id from bins),
links as (select bin1_id, bin2_id, 1 as "count", true as genomic from near n where bin2_id is not null and not exists (select 1 from e where e.bin1_id = n.bin1_id and e.bin2_id = n.bin2_id))"""


@query(f'{_LINKS} select bin1_id, bin2_id, "count" from e')
def graph_edges(spark, sf):
    return _sparse(spark, sf).get_graph().get_pixels()


@query(f'{_LINKS} select bin1_id, bin2_id, "count", genomic from e union all select * from links')
def graph_edges_with_links(spark, sf):
    return _sparse(spark, sf).get_graph().get_pixels(keep_genomic=True)


@query(f'{_LINKS} select bin1_id, bin2_id, "count", genomic from links')
def genomic_links(spark, sf):
    edges = _sparse(spark, sf).df.where("bin1_id <> bin2_id").withColumn("genomic", F.lit(False))
    return graph.genomic_links(bin_table(spark, sf).df, edges)


@query('x as (select 1) select bin_id, chrom, "start", "end", bin_id as node_id from bins')
def graph_bins(spark, sf):
    return pixel_table(spark, sf).get_graph().get_bins(drop_node_id=False, bare=True)


_GIVEN = """given as (
  select bin_id, 0 as level, bin_id * 5 % 14 as cluster from bins union all select bin_id, 1, bin_id % 3 + 10 from bins
  union all select bin_id, 2, bin_id % 3 + 10 from bins union all select bin_id, 3, 0 from bins),
dense as (select bin_id, level, dense_rank() over (partition by level order by cluster) as cluster from given)"""


def given(spark, sf):
    """A partition by rule: level 2 repeats level 1, level 3 is one cluster."""
    rules = ((0, "bin_id * 5 % 14"), (1, "bin_id % 3 + 10"), (2, "bin_id % 3 + 10"), (3, "cast(0 as bigint)"))
    return bin_table(spark, sf).df.select("bin_id", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.expr(e).alias("cluster")) for k, e in rules])).alias("x")).select("bin_id", "x.level", "x.cluster")


@query(f"{_GIVEN} select bin_id, level, cluster from dense")
def level_dense_rank(spark, sf):
    return levels.dense_levels(given(spark, sf))


@query(f"{_GIVEN} select bin_id, level, cluster from given where level < 2")
def level_trim(spark, sf):
    return levels.trimmed(given(spark, sf))


@query(f"""{_GIVEN} select p.bin1_id, p.bin2_id, a.level, case when a.cluster = c.cluster then a.cluster else 0 end as cluster
from pixels p join dense a on a.bin_id = bin1_id join dense c on c.bin_id = bin2_id and c.level = a.level where p.bin1_id <> p.bin2_id""")
def edge_projection(spark, sf):
    return levels.project_to_edges(pixels(spark, sf).where("bin1_id <> bin2_id"), levels.dense_levels(given(spark, sf)))


@query(f"""a as (select bin1_id, bin2_id from pixels where "count" >= {SPARSE}),
c as (select bin1_id, bin2_id, round("count" / 100.0, 9) as prob from pixels where "count" % 2 = 0)
select coalesce(a.bin1_id, c.bin1_id) as bin1_id, coalesce(a.bin2_id, c.bin2_id) as bin2_id,
case when a.bin1_id is not null and c.bin1_id is not null then 0 when c.bin1_id is not null then 1 else 2 end as pix_group, cast(coalesce(prob, 0) as double) as pix_prob
from a full outer join c on a.bin1_id = c.bin1_id and a.bin2_id = c.bin2_id""")
def pix_group(spark, sf):
    p = pixels(spark, sf)
    return levels.pixel_groups(p.where(F.col("count") >= SPARSE), p.where("count % 2 = 0").select("bin1_id", "bin2_id", F.round(F.col("count") / 100.0, 9).alias("pix_prob")))


@query("""s as (select bin1_id as bin_id, bin2_id % 4 as cluster, count(*) as n from pixels group by 1, 2)
select bin_id, round(max(n) / sum(n), 9) as bin_prob from s group by bin_id""")
def bin_prob(spark, sf):
    samples = pixels(spark, sf).groupBy(F.col("bin1_id").alias("bin_id"), (F.col("bin2_id") % 4).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return _rounded(levels.bin_probability(samples), "bin_prob")


@query("""x as (select 1) select a.chrom as chrom1, a."start" as start1, c.chrom as chrom2, c."start" as start2, "count"
from pixels join bins a on a.bin_id = bin1_id join bins c on c.bin_id = bin2_id""")
def contact_counts(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    places = F.broadcast(bins(spark, sf).select("s_suppkey", "chrom", (F.col("start") + 5).alias("pos")))
    at = lambda s: items.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("l_linenumber").alias(f"n{s}"), F.col("chrom").alias(f"chrom{s}"), F.col("pos").alias(f"pos{s}"))
    return pixel_counts(at(1).join(at(2), "l_orderkey").where("n1 < n2"), SIZE)


@query()
def clustered_region(spark, sf):
    t = pixel_table(spark, sf)
    t.normalize_counts()
    return t.get_graph(REGION).compute_clustering(on="norm_count", marginals="bins", effort=10)


@query(f"{_ASIA} select bin1_id, bin2_id, \"count\" from sub order by bin1_id, bin2_id")
def sorted_pixels(spark, sf):
    return subset_region(pixels(spark, sf), extent=bin_table(spark, sf).extent(REGION)).orderBy("bin1_id", "bin2_id")


@query('x as (select 1) select bin1_id, bin2_id, cast(sum("count") over (order by bin1_id, bin2_id) as bigint) as "count" from pixels')
def stateful_strategy(spark, sf):
    def running(frames):
        total = 0
        for frame in frames:
            frame["count"] = frame["count"].cumsum() + total
            total = frame["count"].iloc[-1] if len(frame) else total
            yield frame

    t = pixel_table(spark, sf)
    return t.apply(over_stream(running, t.df.select("bin1_id", "bin2_id", "count").schema)).df


@query(f'{_ASIA} select bin_id, chrom, "start", "end", round(weight, 9) as weight from b')
def bin_track(spark, sf):
    return _rounded(BinTrack(bin_table(spark, sf)).fetch_data(REGION), "weight")


#: Over all pixels of all chromosomes, unlike the sparse maps of one chromosome above.
_ALL_CELLS = """ext as (select min(bin1_id) as lo, max(bin2_id) + 1 as hi from pixels),
up as (select bin1_id - lo as i, bin2_id - lo as j, cast("count" as double) as value from pixels, ext)"""
_ALL_LINKS = """e as (select bin1_id, bin2_id, "count", false as genomic from pixels where bin1_id <> bin2_id),
near as (select bin_id as bin1_id, lead(bin_id) over (partition by chrom order by bin_id) as bin2_id from bins),
links as (select bin1_id, bin2_id, 1 as "count", true as genomic from near n where bin2_id is not null and not exists (select 1 from e where e.bin1_id = n.bin1_id and e.bin2_id = n.bin2_id))"""


@query(f"{_ALL_CELLS} select i, j, value from up")
def matrix_upper_whole(spark, sf):
    return pixel_table(spark, sf).get_matrix_cells(mode="upper")


@query(f"{_ALL_CELLS} select j as i, i as j, value from up")
def matrix_lower_whole(spark, sf):
    return pixel_table(spark, sf).get_matrix_cells(mode="lower")


@query(f"{_ALL_CELLS} select i, j, value from up where i <> j union all select j, i, value from up where i <> j")
def matrix_full_masked_whole(spark, sf):
    return pixel_table(spark, sf).get_matrix_cells(mode="full", mask_diagonal=True)


@query(f"""{_ALL_CELLS}, al as (select i, j, value from up union all select j, i, value from up where i <> j),
side as (select unnest(range(0, (select hi - lo from ext))) as k)
select a.k as i, c.k as j, value from side a cross join side c left join al on al.i = a.k and al.j = c.k""")
def matrix_complete_whole(spark, sf):
    return pixel_table(spark, sf).get_matrix_cells(complete=True)


@query(f"{_ALL_CELLS} select i, j, round(log10(value), 9) as value from up where i <> j union all select j, i, round(log10(value), 9) from up where i <> j")
def plot_counts_whole(spark, sf):
    from .plotdata import PixelTrack

    return PixelTrack(pixel_table(spark, sf)).cells(None).where("i <> j").withColumn("value", F.round("value", 9))


@query(f'{_ALL_LINKS} select bin1_id, bin2_id, "count" from e')
def graph_edges_whole(spark, sf):
    return pixel_table(spark, sf).get_graph().get_pixels()


@query(f'{_ALL_LINKS} select bin1_id, bin2_id, "count", genomic from e union all select * from links')
def graph_edges_with_links_whole(spark, sf):
    return pixel_table(spark, sf).get_graph().get_pixels(keep_genomic=True)


@query("""c as (select bin1_id, bin2_id, round("count" / 100.0, 9) as prob from pixels where "count" % 2 = 0)
select p.bin1_id, p.bin2_id, case when c.bin1_id is null then 2 else 0 end as pix_group, cast(coalesce(prob, 0) as double) as pix_prob
from pixels p left join c on p.bin1_id = c.bin1_id and p.bin2_id = c.bin2_id""")
def pix_group_whole(spark, sf):
    p = pixels(spark, sf)
    return levels.pixel_groups(p, p.where("count % 2 = 0").select("bin1_id", "bin2_id", F.round(F.col("count") / 100.0, 9).alias("pix_prob")))


@query('x as (select 1) select bin1_id, bin2_id, "count" from pixels')
def saved_and_loaded(spark, sf):
    path = new_path(spark, "saved")
    pixel_table(spark, sf).save(path)
    return PixelTable.load(path, spark).df.select("bin1_id", "bin2_id", "count")


@query('x as (select 1) select bin_id, chrom, "start", "end" from bins')
def saved_and_loaded_bins(spark, sf):
    path = new_path(spark, "saved")
    bin_table(spark, sf).save(path)
    return BinTable.load(path, spark).df.select("bin_id", "chrom", "start", "end")


@query(f"""{_ASIA}, up as (select bin1_id - lo as i, bin2_id - lo as j, cast("count" as double) as value from sub, ext),
al as (select i, j, value from up union all select j, i, value from up where i <> j), side as (select unnest(range(0, 9 - 2)) as k)
select a.k as i, c.k as j, value from side a cross join side c left join al on al.i = a.k and al.j = c.k""")
def matrix_of_range(spark, sf):
    """The bounds of a region with start and end: as many cells a side as bins begin in it."""
    return pixel_table(spark, sf).get_matrix_cells(REGION, complete=True)


@query(f"{_ALL_CELLS} select i, j, round(log2(value), 9) as value from up where i <> j union all select j, i, round(log2(value), 9) from up where i <> j")
def plot_log2_whole(spark, sf):
    from .plotdata import PixelTrack

    return PixelTrack(pixel_table(spark, sf), transform="log2").cells(None).where("i <> j").withColumn("value", F.round("value", 9))


@query(f"""ext as (select min(bin_id) as lo, max(bin_id) + 1 as hi from bins where chrom = '{WHOLE}')
select bin1_id - lo as i, bin2_id - lo as j, round(log10("count"), 9) as value from pixels, ext
where bin1_id >= lo and bin2_id < hi and bin2_id - bin1_id <= 0.25 * (hi - lo)""")
def plot_window(spark, sf):
    from .plotdata import table_data

    return table_data(pixel_table(spark, sf), WHOLE, modality="window", depth_ratio=0.25)["cells"].withColumn("value", F.round("value", 9))


@query("""g as (select bin1_id, bin2_id, "count", "count" % 5 as score from pixels where bin1_id <> bin2_id and "count" % 3 = 0
  union all select bin1_id, bin2_id + 100000, 1, 7 from pixels where "count" % 7 = 0)
select coalesce(p.bin1_id, g.bin1_id) as bin1_id, coalesce(p.bin2_id, g.bin2_id) as bin2_id, coalesce(p."count", g."count") as "count", score
from pixels p full outer join g on g.bin1_id = p.bin1_id and g.bin2_id = p.bin2_id""")
def written_back_edges(spark, sf):
    """Given edges, some of which are no pixels, joined to the pixels: those come in with their own count."""
    p = pixels(spark, sf)
    own = p.where("bin1_id <> bin2_id and count % 3 = 0").select("bin1_id", "bin2_id", "count", (F.col("count") % 5).alias("score"))
    more = p.where("count % 7 = 0").select("bin1_id", (F.col("bin2_id") + 100000).alias("bin2_id"), F.lit(1).cast("long").alias("count"), F.lit(7).cast("long").alias("score"))
    return written_back(p.select("bin1_id", "bin2_id", "count"), own.unionByName(more), ["score"], add=True)
