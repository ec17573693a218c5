"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its runs of SHINGLE words; texts with equal word sequences are one text with copies. Candidates
share one of BANDS bands of ROWS MinHash values. A pair's MinHash values are then compared step by step; it is dropped
as soon as the posterior probability that its similarity reaches the threshold, given the matches so far, falls below
TOLERANCE. What is left is verified on the exact shingle sets.

No bucket is expanded into pairs in the plan: the members of a bucket are dealt to chunks of about CHUNK, each pair of
chunks is a unit of work, and a unit hands on members with lists of partners, then members with counts of links and
the edges of a spanning forest. A pair is counted in the unit of the first band that it shares, and there only.

Every join is dealt by key (dealt): an exploded table, as that of bands, is many times larger than the size that the
planner estimates, and a broadcast of it goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Rolling, WordHashes, discard, file_count, grouped, id_text, slices, stored, table

SHINGLE = 5
THRESHOLD = 0.8
#: At the threshold a pair shares no band with probability (1 - 0.8**4)**32, below 5e-8.
BANDS, ROWS = 32, 4
STEP = 16
#: Least posterior probability of reaching the threshold with which a pair is still compared.
TOLERANCE = 1e-6
CHUNK = 256
#: Parts of a label's members in the joins that follow labels: one group may hold a third of all texts.
SALTS = 16
_SEED = 0x51ED270B


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, total: int = BANDS * ROWS, step: int = STEP, bits: int = 8) -> list[int]:
    """For step, 2 * step, ... compared values: the least matches with which a pair stays.

    Prior: uniform similarity s. Values are compared by their last bits, so they match with probability s + (1 - s) / 2**bits.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    log_p, log_q = np.log(s + (1 - s) / 2**bits), np.log((1 - s) * (1 - 1 / 2**bits))
    out = []
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            weight = m * log_p + (n - m) * log_q
            weight = np.exp(weight - weight.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                break
        out.append(m)
    return out


def shingles(hasher: WordHashes, rolling: Rolling, text: bytes, width: int) -> np.ndarray:
    """Hashes (64 bits) of the runs of width words; a text of fewer words, but not none, is one run."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))
    return rolling.runs(rolling.prefix(hashes), min(width, len(words)))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


_SIGNED = "doc_id long, row long, key binary, bands array<int>, bits binary"


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Per row: a key of its word sequence (null without words), band values, last 8 bits of each MinHash value."""
    import xxhash

    hasher, rolling = WordHashes(), Rolling()
    times, plus = _permutations(bands * rows)
    mixers = np.random.default_rng(_SEED + 1).integers(0, 1 << 32, rows, np.uint32) | np.uint32(1)
    for batch in batches:
        for lo, hi, texts in slices(batch):
            keys, runs = [], []
            for text in texts:
                words = text.split()
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                if words:
                    hashes = np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))
                    runs.append((rolling.runs(rolling.prefix(hashes), min(width, len(words))) >> np.uint64(32)).astype(np.uint32))
            filled = [k is not None for k in keys]
            least = np.zeros((bands * rows, len(runs)), np.uint32)
            if runs:
                flat = np.concatenate(runs)
                begins = np.concatenate(([0], np.cumsum([len(r) for r in runs])[:-1]))
                for h in range(bands * rows):
                    x = flat * times[h] + plus[h]
                    x ^= x >> np.uint32(15)
                    np.minimum.reduceat(x, begins, out=least[h])
            value = np.zeros((len(runs), bands), np.uint32)
            by_band = least.T.reshape(len(runs), bands, rows)
            for r in range(rows):
                value = (value ^ by_band[:, :, r]) * mixers[r]
                value ^= value >> np.uint32(13)
            low = iter(np.ascontiguousarray((least & np.uint32(255)).astype(np.uint8).T))
            val = iter(value.view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("row").slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array([next(val) if f else None for f in filled], pa.list_(pa.int32())), pa.array([next(low).tobytes() if f else None for f in filled], pa.binary())],
                names=["doc_id", "row", "key", "bands", "bits"],
            )


_PARTNERS = "unit long, member long, partners array<long>"


def _prune(batches: Iterator[pa.RecordBatch], least: list[int], bands: int, total: int, step: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, band, value, left, right, member, bands, bits), sorted by unit -> members of the pairs that stay, each
    once, with those partners that it is to be compared with.
    """
    for rows, edges in grouped(batches, "unit"):
        n = rows.num_rows
        values = rows.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, bands)
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(n, total)
        member, band, value = (rows.column(c).to_numpy() for c in ("member", "band", "value"))
        left, right = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
        first, second, held, done = [], [], 0, 0
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def judge():
            nonlocal first, second, held
            if not held:
                return
            a, b = np.concatenate(first), np.concatenate(second)
            first, second, held = [], [], 0
            for k in range(0, len(a), 200_000):
                x, y = a[k : k + 200_000], b[k : k + 200_000]
                same = values[x] == values[y]
                mine = (np.argmax(same, axis=1) == band[x]) & same[np.arange(len(x)), band[x]] & (value[x] == value[y])
                x, y = x[mine], y[mine]
                matches = np.zeros(len(x), np.int64)
                for at, need in zip(range(0, total, step), least, strict=True):
                    matches += (bits[x, at : at + step] == bits[y, at : at + step]).sum(1)
                    stay = matches >= need
                    x, y, matches = x[stay], y[stay], matches[stay]
                out.append((x, y))

        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            # in a unit of one chunk every row is left and right; else left rows meet right rows
            l, r = np.flatnonzero(left[lo:hi]) + lo, np.flatnonzero(right[lo:hi]) + lo
            if len(l) == hi - lo and len(r) == hi - lo:
                i, j = np.triu_indices(hi - lo, 1)
                i, j = i + lo, j + lo
            else:
                i, j = np.repeat(l, len(r)), np.tile(r, len(l))
            first.append(i)
            second.append(j)
            held += len(i)
            if held >= 400_000:
                judge()
        judge()
        if not out:
            continue
        x, y = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        if not len(x):
            continue
        unit = rows.column("unit").to_numpy()[x]
        order = np.lexsort((member[x], unit))
        x, y, unit = x[order], y[order], unit[order]
        begins = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]))))
        offsets = np.concatenate((begins, [len(x)])).astype(np.int32)
        only = np.setdiff1d(y, x)  # those that are partners and ask for none
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate((offsets, np.full(len(only), offsets[-1], np.int32)))), pa.array(member[y]))
        every = np.concatenate((x[begins], only))
        yield pa.RecordBatch.from_arrays([pa.array(rows.column("unit").to_numpy()[every]), pa.array(member[every]), lists], names=["unit", "member", "partners"])


_LINKS = "member long, links long, other long"


def _verify(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (unit, member, copies, text, partners), sorted by unit -> members with their links in the unit, and an
    edge of the unit's spanning forest (other; null at a root). Similarity is compared as whole numbers: no rounding.
    """
    hasher, rolling = WordHashes(), Rolling()
    numerator, denominator = threshold.as_integer_ratio() if threshold.as_integer_ratio()[1] < 1 << 20 else (round(threshold * 1_000_000), 1_000_000)
    for rows, edges in grouped(batches, "unit"):
        members, copies, partners = (rows.column(c).to_pylist() for c in ("member", "copies", "partners"))
        texts = rows.column("text").cast(pa.binary())
        links: list[tuple[int, int, int | None]] = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sets, weight, wanted = {}, {}, {}
            for i in range(lo, hi):
                if members[i] not in sets:
                    sets[members[i]] = np.unique(shingles(hasher, rolling, texts[i].as_py() or b"", width))
                    weight[members[i]] = copies[i]
                if partners[i]:
                    wanted.setdefault(members[i], set()).update(partners[i])
            root = {m: m for m in sets}
            count = dict.fromkeys(sets, 0)

            def find(m):
                while root[m] != m:
                    root[m] = root[root[m]]
                    m = root[m]
                return m

            for a, others in wanted.items():
                one = sets[a]
                for b in others:
                    two = sets[b]
                    small, large = (one, two) if len(one) < len(two) else (two, one)
                    if len(small) * denominator < numerator * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int(np.count_nonzero(large[at] == small))
                    if both * denominator >= numerator * (len(one) + len(two) - both):
                        count[a] += weight[b]
                        count[b] += weight[a]
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
            links += [(m, n, find(m) if find(m) != m else None) for m, n in count.items() if n]
        if links:
            cols = list(zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["member", "links", "other"])


def dealt(df: DataFrame) -> DataFrame:
    """df, as a side of a join that is sorted and merged, whatever sizes are estimated: never broadcast."""
    return df.hint("merge")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(member, least): the least member reachable, for each member of an edge (a, b). Labels are pushed to neighbours
    and shortened through the label's own label, each round written to the shared folder, until nothing changes.
    """
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", files)
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "labels", files)
    salt, salts = F.pmod(F.col("a"), F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    while True:
        near = both.join(dealt(labels.select(F.col("a").alias("b"), F.col("least").alias("l"))), "b").groupBy("a").agg(F.min("l").alias("l"))
        # only labels' own labels: as many rows as there are labels in use
        far = labels.join(dealt(labels.select(F.col("least").alias("a")).distinct()), "a", "left_semi").select(F.col("a").alias("least"), F.col("least").alias("l2"), salts)
        better = labels.join(dealt(near), "a").select("a", "least", "l", salt).join(dealt(far), ["least", "salt"], "left").select("a", "salt", F.least("least", "l", "l2").alias("new"), F.col("least").alias("old"))
        better = stored(better, "better", files)
        # a label may also improve those that point to it: pass new labels on to the members of the old one
        lifted = better.groupBy("old").agg(F.min("new").alias("up")).where("up < old").select("old", "up", salts)
        new = F.least("new", F.coalesce("up", "new"))
        moved = stored(better.join(dealt(lifted), ["old", "salt"], "left").select("a", new.alias("least"), (new < F.col("old")).alias("changed")), "labels", files)
        discard(spark, labels)
        discard(spark, better)
        labels = moved.select("a", "least")
        if moved.where("changed").isEmpty():
            discard(spark, both)
            return labels.select(F.col("a").alias("member"), "least")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: the hash row tells rows of one doc_id apart."""
    return id_text(docs).withColumn("row", F.xxhash64("text"))


def classified(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, chunk: int = CHUNK, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of docs: doc_id, row, text_id, class_id, n_links as in near_duplicates, and stays: whether the row, or one equal
    to it in doc_id and text, is the one of its group that stays; null where nothing can link (no words, or a null doc_id).
    """
    total = BANDS * ROWS
    docs = keyed(docs)
    files = file_count(docs)
    signed = stored(docs.mapInArrow(partial(_sign, width=width, bands=BANDS, rows=ROWS), _SIGNED), "signed", files)
    full = signed.where("key is not null and doc_id is not null")
    # different texts get numbers, which hold from here on as they are written; first: one row that has the text
    texts = full.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    texts = stored(texts.coalesce(files).withColumn("member", F.monotonically_increasing_id()), "texts")

    placed = texts.select("member", F.posexplode("bands").alias("band", "value"))
    crowded = placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    in_crowd = placed.join(dealt(crowded), ["band", "value"]).withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")).withColumn("mine", F.expr("pmod(xxhash64(member), chunks)").cast("int"))
    met = in_crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("member", "band", "value", F.xxhash64("band", "value", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"))
    units = met.join(dealt(texts.select("member", "bands", "bits")), "member").repartition("unit").sortWithinPartitions("unit")
    pruned = stored(units.mapInArrow(partial(_prune, least=least_matches(threshold, tolerance), bands=BANDS, total=total, step=STEP), _PARTNERS), "pairs", 3 * files)

    # every member of a unit with a pair that is left, once, with its text
    sources = pruned.join(dealt(texts.select("member", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"))), "member")
    with_text = sources.join(dealt(docs), ["doc_id", "row"])
    verified = with_text.select("unit", "member", "copies", "text", "partners").repartition("unit").sortWithinPartitions("unit")
    links = stored(verified.mapInArrow(partial(_verify, width=width, threshold=threshold), _LINKS), "links", files)

    degree = links.groupBy("member").agg(F.sum("links").alias("links"))
    found = components(links.where("other is not null").select(F.col("member").alias("a"), F.col("other").alias("b")), files)
    # the first row of a group stands for it: pre-aggregated, so a large group is one row a task
    heads = found.join(dealt(texts.select("member", "first")), "member").groupBy("least").agg(F.min("first").alias("head")).select("least", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    grouped_texts = found.withColumn("salt", F.pmod(F.col("member"), F.lit(SALTS))).join(dealt(heads), ["least", "salt"]).select("member", "head")
    classes = texts.select("key", "member", "first", "copies").join(dealt(degree), "member", "left").join(dealt(grouped_texts), "member", "left")
    classes = classes.select("key", "first", F.coalesce("head", "first").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = signed.select("doc_id", "row", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    of = lambda c: F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col(c))
    return own.join(dealt(classes), "key", "left").select(
        "doc_id", "row", of("first.doc_id").alias("text_id"), of("head.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("head") == F.struct("doc_id", "row")).alias("stays")
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, chunk: int = CHUNK, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of docs: doc_id, text_id (least doc_id of those with its word sequence), class_id (least doc_id of its
    group of linked texts), n_links (other rows of similarity threshold or more, copies included).

    A row without words (null, empty or blank text) has no links and is its own class. Rows with a null doc_id take part
    in nothing and get null ids. Rows that share a doc_id are judged each by its own text: equal texts are copies of one
    another, others are linked or not as any two texts are. A very long text is taken whole. An empty table gives no
    rows. Columns other than doc_id and text, whatever their names, play no part.
    """
    found = classified(docs, threshold, width, chunk, tolerance)
    return found.drop("row", "stays").coalesce(file_count(docs))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group, that of the least doc_id; all columns.

    Rows that nothing can link (without words, or with a null doc_id) all stay. Of rows that are equal in doc_id and
    text one stays. No row goes because another text has its doc_id. An empty table gives no rows.
    """
    verdict = classified(docs, **options).where("stays is not null").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "stays").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__row"))
    told = rows.join(dealt(verdict), ["__id", "__row"], "left").where("stays is null or stays")
    # equal rows of those that stay meet where the join has brought them; the others are told apart by a number
    once = told.withColumn("__nth", F.when(F.col("stays"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())).dropDuplicates(["__id", "__row", "__nth"])
    return once.select(*[F.col(f"__all.`{c}`").alias(c) for c in docs.columns]).coalesce(file_count(docs))


def op3_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
