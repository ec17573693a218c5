"""Tables, annotation goldens, error contract, graphs, clustering, stores and streams on hand-made bins."""

import datetime as dt
import itertools
import re
import uuid

import numpy as np
import pandas as pd
import pytest

from tessella.functions.regions import RegionNotFound, parse_region
from tessella.operators.annotate import annotated_bins
from tessella.operators.clustering import BlockModel, _absent, cluster_graph, default_probability
from tessella.operators.expected import _smoothed, expected_normalized_pixels, get_expected_counts
from tessella.operators.graph import ContactGraph, numbered
from tessella.operators.levels import dense_levels, kept_levels
from tessella.operators.matrix import complete_matrix
from tessella.operators.strategies import over_stream
from tessella.operators.tables import BinTable, PixelTable
from tessella.plans import derived, registry
from tessella.plans.plotdata import MODALITIES, BinClusters, BinTrack, comparison_data, infer_track, style_width, table_data
from tessella.sources.dataset import replace_table
from tessella.sources.frames import as_frame, convert
from tessella.sources.store import ContactStore
from tessella.streaming.chunks import pixel_counts, rechunk

HMM = [("chrII", 0, 9000, "A"), ("chrII", 10000, 30000, "B"), ("chrII", 30000, 33000, "A"), ("chrII", 33000, 37000, "B"), ("chrII", 37000, 40000, "A"), ("chrII", 50000, 90500, "A")]


@pytest.fixture(scope="module")
def chr2(spark):
    rows = [(i, "chrII", i * 10_000, min((i + 1) * 10_000, 813_184), None if i == 5 else 0.5) for i in range(82)]
    return spark.createDataFrame(rows, "bin_id long, chrom string, start int, end int, weight double")


@pytest.fixture(scope="module")
def hmm(spark):
    return spark.createDataFrame(HMM, "chrom string, start long, end long, hmm string")


@pytest.fixture
def table(spark, chr2):
    pixels = [(i, j, 1 + (i * j) % 7) for i in range(12) for j in range(i, 12) if (i + j) % 4 != 1]
    return PixelTable(spark.createDataFrame(pixels, "bin1_id long, bin2_id long, count long"), bins=chr2)


N = None
GOLDEN = {
    ("frac_overlap", True, "auto"): "ABBANAAAAA", ("frac_overlap", True, True): "ABBANAAAAA", ("frac_overlap", True, False): "ABBANAAAAN", ("frac_overlap", False, "auto"): "ABBBNAAAAA",
    ("frac_overlap", False, True): "ABBBNAAAAA", ("frac_overlap", False, False): "ABBBNAAAAN", ("chrom_enrich", True, "auto"): "ABBBNAAAAN", ("chrom_enrich", True, False): "ABBBNAAAAN", ("chrom_enrich", True, True): "ABBBNAAAAA",
}


@pytest.mark.parametrize("case", [*itertools.product(("frac_overlap", "chrom_enrich"), (True, False), ("auto", True, False), (True, False))], ids=str)
def test_annotation_grid(chr2, hmm, case):
    metric, consolidate, ignore, save_all = case
    run = lambda: annotated_bins(chr2, hmm, metric, 10_000, consolidate, save_all, ignore)
    if not consolidate and (save_all or metric == "chrom_enrich"):
        with pytest.raises(ValueError):
            run()
        return
    got = run().where("start < 100000").orderBy("start").toPandas().astype(object)
    got = got.where(got.notna(), None)
    if save_all:
        a, b, rest = ({"frac_overlap": ([0.9, N, N, 0.6, N, 1, 1, 1, 1, 0.05], [N, 1, 1, 0.4, N, N, N, N, N, N], [0.1, N, N, N, 1, N, N, N, N, 0.95]), "chrom_enrich": ([3.83, N, N, 3.29, N, 3.97, 3.97, 3.97, 3.97, 0.79], [N, 5.12, 5.12, 3.86, N, N, N, N, N, N], [0.15, N, N, N, 1.08, N, N, N, N, 1.04])})[metric]
        for name, want in (("A", a), ("B", b), ("null", rest)):
            assert [x if x is None else round(x, 2) for x in got[f"{name}_{metric}"]] == want
    else:
        assert "".join(x or "N" for x in got["hmm"]) == GOLDEN[metric, consolidate, ignore]


def test_annotation_edges(spark, chr2, hmm):
    over = spark.createDataFrame([("chrII", 0, 10_000, "x"), ("chrII", 0, 5_000, "y"), ("chrII", 20_000, 20_000, "empty"), (None, 0, 5, "z")], "chrom string, start long, end long, v string")
    wide = annotated_bins(chr2, over, "bp_overlap", 10_000, save_all_mods=True).orderBy("start").first()
    assert (wide.x_bp_overlap, wide.y_bp_overlap, wide.null_bp_overlap) == (10_000, 5_000, -5_000)
    t = BinTable(chr2)
    t.add_annotation(hmm)
    assert t.df.where("bin_id = 4").first().hmm == "None"
    with pytest.raises(KeyError):
        t.add_annotation(hmm)
    with pytest.raises(ValueError):
        t.add_annotation(hmm.withColumn("more", hmm.start))
    with pytest.raises(ValueError):
        t.add_annotation(hmm.withColumnRenamed("hmm", "h2"), metric="other")
    many = spark.createDataFrame([("chrII", 0, 10, str(i)) for i in range(16)], "chrom string, start long, end long, v string")
    with pytest.raises(ValueError):
        annotated_bins(chr2, many, "frac_overlap", 10_000, save_all_mods=True)


def test_regions(chr2):
    t = BinTable(chr2)
    assert t.bin_size == 10_000 and t.extent("chrII") == (0, 82) and t.extent("chrII:20000-40000") == (2, 4) and t.extent("chrII:50000-150000") == (5, 15)
    assert t.extent("chrII:0-805000", strict=True) == (0, 81) and t.extent("chrII:0-805000") == (0, 82)
    for bad in ("chrII:5", "chrII:-5", "chrII:a-b", "chrII:1-2-3"):
        with pytest.raises(ValueError):
            t.get_dataframe(bad)
    for error in (RegionNotFound, AssertionError, ValueError):
        with pytest.raises(error):
            t.extent("chrX")
    assert parse_region("a:b:1-2").chrom == "a:b" and t.extended("chrII") == "chrII:0-813184"


def test_pixel_queries(table):
    assert set(table.get_dataframe().columns) == {"bin1_id", "bin2_id", "count", *(f"{c}{s}" for c in ("chrom", "start", "end", "weight") for s in (1, 2))}
    balanced = table.get_dataframe(annotate=False, balance=True).toPandas()
    assert not ((balanced.bin1_id == 5) | (balanced.bin2_id == 5)).any()
    sub = table.subset("chrII:20000-60000")
    assert sub.bins is table.bins and {r.bin1_id for r in sub.df.collect()} <= {2, 3, 4, 5}
    chunks = [len(c) for c in table.get_chunks(chunk_size=20)]
    assert sum(chunks) == table.df.count() and set(chunks[:-1]) == {20}
    options = {"region": "x", "balance": True}
    table.get_dataframe(annotate=False, selection_kwargs=options)
    assert options == {"region": "x", "balance": True}
    with pytest.raises(ValueError):
        table.apply(lambda d: d).bins.df.transform(lambda b: __import__("tessella.operators.strategies", fromlist=["x"]).balance_pixels(table.df, bins_df=b.drop("weight")))


def test_matrix(table):
    full, up, low = (table.get_matrix("chrII:0-100000", mode=m) for m in ("full", "upper", "lower"))
    assert full.shape == (10, 10) and np.array_equal(full, full.T, equal_nan=True) and np.array_equal(up.T, low, equal_nan=True)
    assert np.isnan(table.get_matrix("chrII:0-100000", mask_diagonal=True).diagonal()).all()
    assert table.get_matrix_cells("chrII:0-100000", complete=True).count() == 100
    with pytest.raises(ValueError):
        table.get_matrix(mode="other")


def test_annotations_and_normalisers(spark, table):
    extra = spark.createDataFrame([(0, 0, "x")], "bin1_id long, bin2_id long, tag string")
    left = table.copy()
    left.add_pix_annotation(extra, how="left")
    assert left.df.count() == table.df.count()
    table.add_pix_annotation(extra)
    assert table.df.count() == 1
    with pytest.raises(NotImplementedError):
        table.add_pix_annotation(extra)
    left.normalize_counts()
    assert 0 < left.df.agg({"norm_count": "max"}).first()[0] < 1
    for options in ({"norm": "arctan_mean"}, {"norm": "other", "column": "c2"}):
        with pytest.raises(ValueError):
            left.normalize_counts(**options)


def test_save_load_and_store(spark, table, hmm, tmp_path):
    path = str(tmp_path / "t")
    table.save(path)
    again = PixelTable.load(path)
    assert again.df.count() == table.df.count() and again.bins.df.count() == 82
    with pytest.raises(OSError):
        table.save(path)
    with pytest.raises(OSError):
        PixelTable.load(str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        BinTable.load(path)
    store = ContactStore(path)
    assert store.get_pixel_table("chrII:20000-40000").df.count() == table.subset("chrII:20000-40000").df.count()
    store.bin_annot_add(hmm)
    assert "hmm" in store.get_bin_table().col_names
    with pytest.raises(KeyError):
        store.bin_annot_add(hmm)
    store.bin_annot_del("hmm")
    with pytest.raises(KeyError):
        store.bin_annot_del("hmm")
    with pytest.raises(ValueError):
        store.bin_annot_del("start")
    expected = store.expected_normalized(str(tmp_path / "oe"), smooth=None)
    assert expected.count() == 82 and ContactStore(str(tmp_path / "oe")).get_pixel_table().df.count()
    assert ContactGraph.from_store(store, region="chrII:0-50000").get_bins().count() == 5


def test_expected(spark, table):
    more = table.bins.df.unionByName(spark.createDataFrame([(82 + i, f"c{i // 3}", i % 3 * 10_000, (i % 3 + 1) * 10_000, 1.0) for i in range(6)], table.bins.df.schema))
    got = get_expected_counts(more, table.df).toPandas()
    assert len(got[got.dist == -1]) == 3 and len(got[got.dist >= 0]) == 88 and got[got.dist.isin([0, 1])].expected.isna().all()
    zero = spark.createDataFrame([("a", "a", 2, 0.0), ("a", "b", -1, 2.0)], "chrom1 string, chrom2 string, dist long, expected double")
    pixels = spark.createDataFrame([(0, 2, 3.0, "a", "a"), (0, 9, 3.0, "a", "b"), (1, 9, 0.0, "a", "b"), (0, 3, 1.0, "a", "a")], "bin1_id long, bin2_id long, count double, chrom1 string, chrom2 string")
    assert {(r.bin1_id, r.bin2_id): r["count"] for r in expected_normalized_pixels(pixels, zero).collect()} == {(0, 2): float("inf"), (0, 9): 1.5}


def test_graph_and_clustering(table):
    graph = table.get_graph("chrII:0-120000")
    links = graph.get_pixels(keep_genomic=True).where("genomic").toPandas()
    assert ((links.bin2_id - links.bin1_id) == 1).all() and len(links)
    with pytest.raises(ValueError):
        graph.compute_clustering(on="count")
    table.normalize_counts()
    labels = [table.get_graph("chrII:0-120000").compute_clustering(on="norm_count", seed=3, effort=5).orderBy("level", "bin_id").collect() for _ in range(2)]
    assert labels[0] == labels[1] and {r.bin_id for r in labels[0]} == set(range(12)) and min(r.cluster for r in labels[0]) == 1
    with pytest.raises(ValueError):
        table.get_graph().compute_clustering(on="norm_count", marginals="other")
    before = table.df.count()
    table.add_clustering("chrII:0-120000", on="norm_count", marginals="pixels", effort=5)
    assert table.df.count() >= before and table.bins.df.where("`level_(0)` is not null").count() == 12
    assert table.df.agg({"pix_prob": "max"}).first()[0] <= 1 and table.bins.df.agg({"bin_prob": "min"}).first()[0] > 0
    with pytest.raises(ValueError):
        cluster_graph(table.bins.df, table.df, on="norm_count")
    with pytest.raises(KeyError):
        BinClusters(table.bins, 99)
    assert BinClusters(table.bins, 0).fetch_data("chrII:0-120000").count() == 12 and BinClusters(table.bins, 0).fetch_data("chrX") is None


def test_a_reconstruction_adds_edges(spark, chr2):
    """Two groups of bins, each with all its pairs but one: the missing ones come in as group 1, with a count and a level."""
    pairs = [(a, b, 9, 0.9) for g in (range(0, 8), range(8, 16)) for a, b in itertools.combinations(g, 2) if (a, b) not in ((0, 5), (9, 14))]
    t = PixelTable(spark.createDataFrame(pairs, "bin1_id long, bin2_id long, count long, score double"), bins=chr2.where("bin_id < 16"))
    t.add_clustering(on="score", marginals="pixels", effort=10)
    rows = t.df.collect()
    assert [(r.bin1_id, r.bin2_id) for r in rows] == sorted((r.bin1_id, r.bin2_id) for r in rows)
    groups = {(r.bin1_id, r.bin2_id): r.pix_group for r in rows}
    added = {p for p, g in groups.items() if g == 1}
    # the default score is low, so not every pair comes in; but some do, and none that is there
    assert added and not added & {p[:2] for p in pairs} and all(0 < r.pix_prob <= 1 and r["level_(0)"] is not None for r in rows if r.pix_group == 1)
    links = {(7, 8)}
    assert all(r["count"] == (9 if (r.bin1_id, r.bin2_id) in {p[:2] for p in pairs} else 1 if (r.bin1_id, r.bin2_id) in links else 0) for r in rows)


def test_absent_pairs_follow_the_default_probability():
    assert default_probability(3.0, 4) == 0.5 and default_probability(0.0, 1) == 0
    n, r = 40, np.random.default_rng(3)
    a, b = np.array(list(itertools.combinations(range(n), 2))[::3]).T
    drawn = [_absent(np.zeros(n, int), a, b, 100.0, 0.5, 0.5, r) for _ in range(200)]
    edges = set((a * n + b).tolist())
    assert not any(edges & set(d.tolist()) or len(d) != len(set(d.tolist())) for d in drawn)
    q = 100 / (n * (n - 1) / 2)
    assert abs(np.mean([len(d) for d in drawn]) / ((n * (n - 1) / 2 - len(edges)) * q) - 1) < 0.1


def test_smoothing_far_distances_in_cells():
    n, r = 6_000, np.random.default_rng(5)
    total, pairs = r.random(n) * 100, np.arange(n, 0, -1.0)
    position = np.log10(np.arange(n) + 1.0)
    kernel = np.exp(-0.5 * ((position[:, None] - position[None, :]) / 0.1) ** 2)
    kernel[:, :2] = 0
    one, two = _smoothed(total, pairs, 0.1)
    assert np.allclose(one / two, (kernel @ total) / (kernel @ pairs), rtol=1e-3)
    one, two = _smoothed(total[:1000], pairs[:1000], 0.1)
    assert np.allclose(one / two, (kernel[:1000, :1000] @ total[:1000]) / (kernel[:1000, :1000] @ pairs[:1000]), rtol=1e-12)


def test_node_ids_and_dense_levels(spark):
    bins = spark.createDataFrame([(i,) for i in (5, 900, 3, 70, 71, 2_000)], "bin_id long")
    assert {r.bin_id: r.node_id for r in numbered(bins, 64).collect()} == {3: 0, 5: 1, 70: 2, 71: 3, 900: 4, 2_000: 5}
    given = spark.createDataFrame([(1, 0, 7), (2, 0, 3), (3, 0, 7), (1, 1, 9)], "bin_id long, level int, cluster long")
    assert sorted(map(tuple, dense_levels(given).collect())) == [(1, 0, 2), (1, 1, 1), (2, 0, 1), (3, 0, 2)]


def test_a_table_is_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_sweep_visits_every_vertex():
    n = 500
    a, b = np.arange(n - 1), np.arange(1, n)
    block, _ = BlockModel(n, a, b, np.full(n - 1, 0.5)).sweep(np.arange(n), np.random.default_rng(1), 0.0, 0.0)
    assert (block != np.arange(n)).sum() > n // 2


@pytest.mark.parametrize("seed", range(4))
def test_the_change_of_a_move_is_that_of_the_whole_cost(seed):
    r = np.random.default_rng(seed)
    pairs = np.array([p for p in itertools.combinations_with_replacement(range(25), 2) if r.random() < 0.3])
    model, block = BlockModel(25, pairs[:, 0], pairs[:, 1], r.random(len(pairs))), r.integers(0, 8, 25)
    for _ in range(3):
        rows, size = model.rows(block), np.bincount(block)
        for v, t in itertools.product(range(25), np.unique(block).tolist()):
            if t != block[v]:
                moved = np.where(np.arange(25) == v, t, block)
                assert abs(model.move(block, rows, size, v, t)[0] - (model.cost(moved) - model.cost(block))) < 1e-6
        block, cost = model.sweep(block, r, 1.0, model.cost(block))
        assert abs(cost - model.cost(block)) < 1e-9


def test_missing_cells_and_links(spark, chr2):
    given = PixelTable(spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 30), (2, 3, 2)], "bin1_id long, bin2_id long, count long"), bins=chr2.where("bin_id < 5"))
    cells = {(r.i, r.j): r["value"] for r in given.get_matrix_cells(complete=True).collect()}
    assert len(cells) == 16 and {k: v for k, v in cells.items() if v is not None} == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (0, 2): 30, (2, 0): 30, (2, 3): 2, (3, 2): 2}
    edges = given.get_graph().get_pixels(keep_genomic=True).collect()
    assert sorted(tuple(e) for e in edges) == [(0, 1, 1, False), (0, 2, 30, False), (1, 2, 1, True), (2, 3, 2, False), (3, 4, 1, True)]


def test_a_strategy_may_carry_state_over_the_stream(table):
    def running(frames):
        total = 0
        for frame in frames:
            frame["count"] = frame["count"].cumsum() + total
            total = frame["count"].iloc[-1] if len(frame) else total
            yield frame

    rows = table.df.orderBy("bin1_id", "bin2_id").toPandas()
    got = table.apply(over_stream(running, "bin1_id long, bin2_id long, count long")).df.orderBy("bin1_id", "bin2_id").toPandas()
    assert got["count"].tolist() == rows["count"].cumsum().tolist()
    assert got["bin2_id"].tolist() == rows["bin2_id"].tolist()


@pytest.mark.parametrize("dtype", ["pandas", "arrow", "spark"])
def test_chunks_of_each_kind(table, dtype):
    size = lambda frame: frame.count() if dtype == "spark" else len(frame)
    kept = table.df.where("count >= 3").count()
    chunks = list(table.get_chunks(annotate=False, chunk_size=10, dtype=dtype, condition="count >= 3"))
    assert [size(c) for c in chunks] == [10] * (kept // 10) + ([kept % 10] if kept % 10 else [])
    assert [size(c) for c in table.bins.get_chunks(chunk_size=50, dtype=dtype)] == [50, 32]
    graph = table.get_graph()
    edges = graph.get_pixels().count()
    assert [size(c) for c in graph.get_pixels(chunk_size=edges - 1, dtype=dtype)] == [edges - 1, 1]
    assert [size(c) for c in graph.get_bins(bare=True, drop_node_id=False, chunk_size=80, dtype=dtype)] == [80, 2]
    if dtype == "spark":
        assert chunks[0].schema == table.df.schema
    with pytest.raises(ValueError):
        table.get_chunks(dtype="other")
    with pytest.raises(ValueError):
        table.get_chunks(chunk_size=0)


def test_strict_ranges_stay_within_their_chromosome(chr2):
    bins = BinTable(chr2)
    assert bins.extent("chrII:5000-15000", strict=True) == (0, 2)
    assert bins.extent("chrII:810000-813184", strict=True) == (81, 82)
    for bad in ("chrII:810000-813185", "chrII:20000-10000", "chrII:900000-910000"):
        with pytest.raises(ValueError):
            bins.extent(bad, strict=True)
    assert bins.extent("chrII:810000-820000") == (81, 82)
    with pytest.raises(RegionNotFound):
        bins.extent("chrIII:0-10", strict=True)


def test_bin_track(chr2):
    track = BinTrack(BinTable(chr2))
    assert [r.bin_id for r in track.fetch_data("chrII:0-20000").collect()] == [0, 1]
    assert track.fetch_data("chrII:0-20000").columns == chr2.columns
    assert track.fetch_data("chrIX") is None


def test_kept_levels():
    assert kept_levels([14, 3, 3, 1], 100) == [0, 1] and kept_levels([1], 5) == [0] and kept_levels([5, 2, 1], 5) == [1] and kept_levels([5], 5) == [0]


def test_plot_data(table):
    assert infer_track("count") == ("counts", None) and infer_track("level_(3)") == ("clusters", 3) and infer_track("pix_prob")[0] == "probs"
    for bad in (lambda: infer_track("x"), lambda: style_width("other"), lambda: style_width(), lambda: table_data(table, "chrII", modality="x"), lambda: comparison_data([table, table], "chrII", value_cols=["count", "count"])):
        with pytest.raises(ValueError):
            bad()
    assert [d["inverted"] for d in comparison_data([table, table], "chrII")] == [False, True]
    shown = {m: table_data(table, "chrII", modality=m, depth_ratio=0.25)["cells"].toPandas() for m in MODALITIES}
    whole = shown["matrix"]
    near = whole[(whole.j >= whole.i) & (whole.j - whole.i <= 0.25 * 82)]
    assert len(shown["window"]) == len(shown["triangular"]) == len(near) < len(whole)
    with pytest.raises(ValueError):
        table_data(table, "chrII", modality="window", depth_ratio=0)


def test_frames_and_streams(spark, tmp_path):
    frame = pd.DataFrame({"chrom": ["b", "a", "a"], "start": [0, 10, 0], "end": [10, 20, 10]})
    bins = BinTable([frame.iloc[:1], frame.iloc[1:]])
    assert [tuple(r) for r in bins.df.orderBy("bin_id").collect()] == [(0, "a", 0, 10), (1, "a", 10, 20), (2, "b", 0, 10)]
    assert BinTable([]).df.count() == 0
    with pytest.raises(AssertionError):
        BinTable([]).peek()
    with pytest.raises(ValueError):
        as_frame(spark, 5)
    with pytest.raises(ValueError):
        convert(bins.df, "other")
    assert [len(c) for c in rechunk([frame, frame.iloc[:0], frame], 4)] == [4, 2] and not list(rechunk([frame.iloc[:0]], 4))
    contacts = spark.createDataFrame([("a", 5, "b", 7), ("b", 3, "a", 9), ("a", 15, "a", 2)], "chrom1 string, pos1 long, chrom2 string, pos2 long")
    contacts.write.parquet(str(tmp_path / "in"))
    name = "c" + uuid.uuid4().hex[:8]
    stream = pixel_counts(spark.readStream.schema(contacts.schema).parquet(str(tmp_path / "in")), 10).writeStream.outputMode("complete").format("memory").queryName(name).start()
    stream.processAllAvailable()
    stream.stop()
    assert {tuple(r) for r in spark.table(name).collect()} == {("a", 0, "b", 0, 2), ("a", 0, "a", 10, 1)}


def executed(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_complete_matrix_deals_out_only_the_given_cells(spark):
    rows = [(0, 0, 1.0), (0, 3, 2.0), (0, 3, 3.0), (2, 4, None), (4, 1, 5.0)]  # a repeated cell; rows 1 and 3 have none
    full = complete_matrix(spark.createDataFrame(rows, "i long, j long, value double"), 5)
    missing = [(i, j, None) for i in range(5) for j in range(5) if not any(r[:2] == (i, j) for r in rows)]
    assert sorted(map(str, (tuple(r) for r in full.collect()))) == sorted(map(str, rows + missing))
    large = complete_matrix(spark.createDataFrame(rows, "i long, j long, value double"), 400)
    assert large.count() == 400 * 400 + 1
    assert "Join" not in executed(large)  # a join by cell deals out the whole grid
    assert complete_matrix(spark.createDataFrame([], "i long, j long, value double"), 0).count() == 0


def test_a_matrix_makes_its_pixels_once(spark, chr2):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    pixels = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (2, 3, 3)], "bin1_id long, bin2_id long, count long")
    cells = PixelTable(pixels.mapInArrow(counted, pixels.schema), bins=chr2).get_matrix_cells()
    assert sorted(tuple(r) for r in cells.collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (2, 3, 3), (3, 2, 3)]
    assert made.value == 3


def test_one_task_of_a_stream_sorts_blocks_not_pixels(spark):
    rows = [(k * 7919 % 500, k % 13, k, f"n{k}" if k % 3 else None, dt.datetime(2020, 1, 1) + dt.timedelta(hours=k)) for k in range(30_000)]
    rows += [(1, None, -1, "x", None), (3, 3, -2, None, None), (3, 3, -2, None, None)]
    pixels = spark.createDataFrame(rows, "bin1_id long, bin2_id long, count long, name string, at timestamp").repartition(5)

    def numbered_rows(frames):
        n = 0
        for frame in frames:
            frame["nth"] = range(n, n + len(frame))
            n += len(frame)
            yield frame

    out = over_stream(numbered_rows, "bin1_id long, bin2_id long, count long, name string, at timestamp, nth long")(pixels)
    got = sorted(out.collect(), key=lambda r: r.nth)
    assert [r.nth for r in got] == list(range(len(rows)))
    key = lambda r: tuple((x is not None, x or 0) for x in r[:2])
    assert [r[:2] for r in got] == [r[:2] for r in sorted(rows, key=key)]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, rows))
    single = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Sort [" in x and "false" in x)
    assert "__range" in single and "__nth" in single and "bin1_id" not in single
    assert "rangepartitioning(bin1_id" in executed(out)


def test_a_stream_without_pixels(spark):
    none = spark.createDataFrame([], "bin1_id long, bin2_id long, count long")
    assert over_stream(lambda frames: frames, none.schema)(none).count() == 0


def test_tasks_of_derived_pixels_grow_in_number_with_the_lines(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    few, rows = derived.pixels(spark, sf), derived.pixels(spark, sf).count()
    monkeypatch.setattr(derived, "TASK_BYTES", derived.TASK_BYTES // 256)
    many = derived.pixels(spark, sf)
    size = derived.file_count(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey"), derived.TASK_BYTES)
    assert size > 20 and many.count() == rows
    for df, n in ((few, 8), (many, size)):
        plan = executed(df)
        for key in ("l_orderkey", "bin1_id"):
            assert re.search(rf"hashpartitioning\({key}#[^)]*, {n}\), REPARTITION_BY_NUM", plan), (key, n, plan)


@pytest.mark.parametrize("name", ["pix_annotation_left", "graph_edges_with_links", "written_back_edges"])
def test_joins_by_pixel_have_as_many_tasks_as_the_lines_ask_for(spark, monkeypatch, name):
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(derived, "TASK_BYTES", derived.TASK_BYTES // 256)
    size = derived.file_count(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey"), derived.TASK_BYTES)
    found = re.findall(r"hashpartitioning\(bin1_id#[^)]*, (\d+)\)", executed(registry.QUERIES[name](spark, sf)))
    assert size > 20 and found and set(found) == {str(size)}
