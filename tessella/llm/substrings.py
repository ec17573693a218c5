"""Substring dedup by seed and extend on winnowed anchors.

Seeds: of each WINDOW consecutive words the SEED-word run with the least hash (the leftmost of equals) is the anchor,
so equal windows have equal anchors at equal places. Consecutive windows with the same anchor form a block:
the anchor, extended both ways as far as it stays their anchor. Documents are joined on anchors: blocks of one anchor
that are equal are one repeat at once, whatever their number; where blocks of an anchor differ, those in the first
document of each content are extended window by window, and equal windows meet. So the work follows the distinct
contents, not the pairs of documents. Windows that also start in an earlier document are merged into maximal repeats
and their words removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Rolling, WordHashes, file_count, grouped, id_text, merged, slices, stored, table

WINDOW = 50
SEED = 20
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Hasher:
    """Word hashes of texts, kept for the life of a worker's task."""

    def __init__(self) -> None:
        self.words, self.rolling = WordHashes(), Rolling()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def blocks(self, words: np.ndarray, window: int, seed: int):
        """Of one document: first window, number of windows, anchor and content hash of each block; prefix sums."""
        prefix = self.rolling.prefix(words)
        runs = self.rolling.runs(prefix, seed)
        n = len(words) - window + 1
        low = np.uint64((1 << 24) - 1)
        keyed = (runs & ~low) | (np.arange(len(runs), dtype=np.uint64) & low)
        chosen = sliding_min(keyed, window - seed + 1)[:n]
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        count = np.diff(np.concatenate((first, [n])))
        place = first + ((chosen[first] - first.astype(np.uint64)) & low).astype(np.int64)
        content = self.rolling.spans(prefix, first, first + count + window - 1) ^ np.uint64(0x9E3779B97F4A7C15) * count.astype(np.uint64)
        return first, count, runs[place], content, prefix


_SEED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("n_words", pa.int64()), ("whole", pa.binary())])
_SEED_SQL = "doc_id long, row long, lo int, n int, anchor long, content long, n_words long, whole binary"


def _rows(**columns) -> pa.RecordBatch:
    n = len(columns["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SEED_SCHEMA], schema=_SEED_SCHEMA)


def _seeds(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row with lo null for each document (n_words, digest of all words), and a row for each block."""
    hasher = Hasher()
    for batch in batches:
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for lo, hi, texts in slices(batch):
            docs, cols = [], [[] for _ in range(6)]
            for doc_id, row, text in zip(ids[lo:hi], rows[lo:hi], texts, strict=True):
                words = text.split()
                docs.append((doc_id, row, len(words), hashlib.sha256(b" ".join(words)).digest()))
                if len(words) >= window and doc_id is not None:
                    first, count, anchor, content, _ = hasher.blocks(hasher.hashes(words), window, seed)
                    for c, v in zip(cols, (np.full(len(first), doc_id), np.full(len(first), row), first, count, anchor, content), strict=True):
                        c.append(v)
            d = list(zip(*docs, strict=True))
            yield _rows(doc_id=d[0], row=d[1], n_words=d[2], whole=d[3])
            if cols[0]:
                c = [np.concatenate(x) for x in cols]
                yield _rows(doc_id=c[0], row=c[1], lo=c[2].astype(np.int32), n=c[3].astype(np.int32), anchor=c[4].view(np.int64), content=c[5].view(np.int64))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, lo, n), sorted -> one row for each document with its windows as ranges (flat lo, n) that don't touch."""
    for rows, edges in grouped(batches, "doc_id", "row"):
        lo = rows.column("lo").to_numpy().astype(np.int64)
        of, a, b = merged(np.repeat(np.arange(len(edges) - 1), np.diff(edges)), lo, lo + rows.column("n").to_numpy())
        flat = pa.ListArray.from_arrays(pa.array((2 * np.searchsorted(of, np.arange(len(edges)))).astype(np.int32)), pa.array(np.stack((a, b - a), 1).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(rows.column("doc_id").to_numpy()[edges[:-1]]), pa.array(rows.column("row").to_numpy()[edges[:-1]]), flat], names=["doc_id", "row", "ranges"])


def ranges(windows: DataFrame) -> DataFrame:
    """(doc_id, row, ranges) from runs of windows (doc_id, row, lo, n)."""
    return windows.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "lo").mapInArrow(_ranges, "doc_id long, row long, ranges array<long>")


def _extend(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of wanted ranges: rows (doc_id, row, text, ranges) -> (doc_id, row, at, hash)."""
    hasher = Hasher()
    for batch in batches:
        ids, rows, wanted = (batch.column(c).to_pylist() for c in ("doc_id", "row", "ranges"))
        for lo, hi, texts in slices(batch):
            doc, own, at, found = [], [], [], []
            for doc_id, row, flat, text in zip(ids[lo:hi], rows[lo:hi], wanted[lo:hi], texts, strict=True):
                words = hasher.hashes(text.split())
                every = hasher.rolling.runs(hasher.rolling.prefix(words), window)
                starts, counts = np.array(flat[::2]), np.array(flat[1::2])
                where = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                doc.append(np.full(len(where), doc_id))
                own.append(np.full(len(where), row))
                at.append(where)
                found.append(every[where])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(own)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "row", "at", "hash"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, repeats as flat lo, n windows) -> what is left of the words."""
    for batch in batches:
        ids, repeats = batch.column("doc_id").to_pylist(), batch.column("repeats").to_pylist()
        for lo, hi, texts in slices(batch):
            out = []
            for doc_id, flat, text in zip(ids[lo:hi], repeats[lo:hi], texts, strict=True):
                words = text.split()
                gone = covered(len(words), flat, window)
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((doc_id, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def covered(n: int, flat: list[int], window: int) -> np.ndarray:
    """Words covered by windows; flat: first window and number of windows, again and again."""
    edge = np.zeros(n + 1, np.int32)
    starts, counts = np.array(flat[::2], np.int64), np.array(flat[1::2], np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + window - 1, -1)
    return np.cumsum(edge[:n]) > 0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row, text: the hash row tells rows of one doc_id apart; rows equal in both columns get equal results anyway."""
    return id_text(docs).withColumn("row", F.xxhash64("text"))


def repeats(docs: DataFrame, files: int, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Of keyed docs, (per row: doc_id, row, n_words, whole; per row with repeats: doc_id, row, ranges as flat lo, n of windows).

    The second holds every window that also starts in a row with a smaller doc_id.
    """
    found = stored(docs.mapInArrow(partial(_seeds, window=window, seed=seed), _SEED_SQL), "seeds", files)
    heads = found.where(F.col("lo").isNull()).select("doc_id", "row", "n_words", "whole")
    blocks = found.where(F.col("lo").isNotNull()).select("doc_id", "row", "lo", "n", "anchor", "content")

    # one row for each content, whatever the number of documents that have it
    contents = blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # anchors with contents that differ, in different documents
    split = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("a"), F.max("last").alias("b")).where("kinds > 1 and a < b").select("anchor", F.lit(True).alias("apart"))
    told = contents.join(split, "anchor", "left").select("anchor", "content", "first", F.coalesce("apart", F.lit(False)).alias("apart")).where("apart or last > first")
    # a block that an earlier document has is a repeat; of anchors that are split, those of the first document are extended
    marked = blocks.join(told, ["anchor", "content"]).where("doc_id > first or apart").select("doc_id", "row", "lo", "n", (F.col("doc_id") > F.col("first")).alias("again"))
    marked = stored(marked, "blocks", files)
    wanted = ranges(marked.where("not again").select("doc_id", "row", "lo", "n"))
    # ranges grow with the documents: both sides are dealt by key at every size, never broadcast
    windows = docs.join(wanted.hint("merge"), ["doc_id", "row"]).select("doc_id", "row", "text", "ranges").mapInArrow(partial(_extend, window=window), "doc_id long, row long, at int, hash long")
    windows = stored(windows, "windows", files)
    earliest = windows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    single = windows.join(earliest, "hash").where("doc_id > first").select("doc_id", "row", F.col("at").alias("lo"), F.lit(1).alias("n"))
    return heads, stored(ranges(marked.where("again").select("doc_id", "row", "lo", "n").unionByName(single)), "repeats", files)


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256. Words are cut at blanks and tabs to carriage returns.

    A null or empty text has no words. Texts of fewer words than a window lose nothing, and neither do rows with a null
    doc_id, from which nothing is taken for others. Rows that share a doc_id are judged one by one, and none of them is
    smaller than another. A very long text is taken whole. An empty table gives no rows. Other columns, whatever their
    names, play no part.
    """
    docs = keyed(docs)
    files = file_count(docs)
    heads, gone = repeats(docs, files, window, seed)
    gone = gone.hint("merge")
    cut = docs.join(gone, ["doc_id", "row"]).select("doc_id", "text", F.col("ranges").alias("repeats")).mapInArrow(partial(_cut, window=window), OUT)
    kept = heads.join(gone.select("doc_id", "row").hint("merge"), ["doc_id", "row"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("whole")).alias("kept_sha256"))
    return kept.unionByName(cut).coalesce(files)


def op10_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
starts as (
  select doc_id, i, md5(array_to_string(words[i:i+49], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
firsts as (select h, min(doc_id) as first from starts group by h),
gone as (
  select doc_id, list(distinct p) as places from (
    select s.doc_id, unnest(range(s.i, s.i + 50)) as p from starts s join firsts f on f.h = s.h where s.doc_id > f.first)
  group by doc_id)
select w.doc_id, len(words) as n_words, coalesce(len(places), 0) as n_removed,
  sha256(array_to_string(list_filter(words, lambda x, k: places is null or not list_contains(places, k)), ' ')) as kept_sha256
from w left join gone on gone.doc_id = w.doc_id
"""
