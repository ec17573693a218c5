"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.workdir import discard, file_count, new_path, shared_dir, stored  # noqa: F401  the operators' way to them

#: Upper bound of the per-process memo of word hashes; it is emptied when full.
WORD_MEMO = 300_000
#: Bytes of text that a Python worker takes apart at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that matter: any other column, whatever its name, is left out. A null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def grouped(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups of rows with equal values of by, and the groups' edges."""
    held: list[pa.RecordBatch] = []

    def edges(rows) -> np.ndarray:
        new = np.zeros(max(0, rows.num_rows - 1), bool)
        for name in by:
            values = rows.column(name).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(name).to_numpy()
            new |= values[1:] != values[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1, [rows.num_rows]))

    key = lambda rows, i: tuple(rows.column(name)[i].as_py() for name in by)
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(edges(batch)[-2])  # the last group may go on in the next batch
        if last or (held and key(held[-1], -1) != key(batch, 0)):
            whole = pa.Table.from_batches(held + ([batch.slice(0, last)] if last else [])).combine_chunks()
            yield whole, edges(whole)
            held = []
        held.append(batch.slice(last))
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, edges(whole)


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document become one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    wide = int(hi.max()) + 2
    top = np.maximum.accumulate(doc * wide + hi)
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (doc[1:] * wide + lo[1:] > top[:-1])))
    begins = np.flatnonzero(first)
    return doc[begins], lo[begins], top[np.concatenate((begins[1:] - 1, [len(doc) - 1]))] - doc[begins] * wide


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered up to WORD_MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def slices(batch: pa.RecordBatch, column: str = "text"):
    """Runs of rows (lo, hi, texts as bytes) of about SLICE_BYTES of text each."""
    texts = batch.column(column).cast(pa.binary() if batch.column(column).type != pa.large_string() else pa.large_binary())
    lo, held, run = 0, 0, []
    for i in range(len(texts)):
        value = texts[i].as_py() or b""
        run.append(value)
        held += len(value)
        if held >= SLICE_BYTES:
            yield lo, i + 1, run
            lo, held, run = i + 1, 0, []
    if run:
        yield lo, len(texts), run


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of runs of n words from prefix sums of a polynomial modulo 2**64 over word hashes."""

    B = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.B), ("down", pow(self.B, -1, 1 << 64))):
                powers = np.ones(n, np.uint64)
                powers[1:] = np.uint64(base)
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, words: np.ndarray) -> np.ndarray:
        self._powers(len(words) + 1)
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """The hash of words i..i+n-1 for each i."""
        if len(prefix) <= n:
            return np.zeros(0, np.uint64)
        return mixed((prefix[n:] - prefix[:-n]) * self.down[: len(prefix) - n])

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((prefix[hi] - prefix[lo]) * self.down[lo])
