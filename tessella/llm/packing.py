"""Harmonic packing of documents into token sequences.

Capacity is shared out in reciprocal classes: class k holds pieces of at most capacity/k ids, and its bins
take exactly k pieces. Each worker fills the bins of its classes on its own. What a worker can't fill (fewer
than k pieces of a class) goes on as single pieces: these are counted off by class over all workers, and the
last fewer than k pieces of every class, whose number is bounded by the classes alone, are packed best fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import file_count, id_text, stored, table
from .tokens import default_vocabulary, encoder

CAPACITY = 1024
#: Part of a class's share that a piece may leave empty before it is cut to the next class.
SLACK = 0.04
#: Finest class: pieces of at most capacity/FINEST ids aren't told apart.
FINEST = 64
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SCHEMA = COLUMNS + ", sequence_id long, offset long, class int, worker int, nth long"
_ARROW = pa.schema([(n, pa.int32() if n in ("class", "worker") else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class", "worker", "nth")])


def class_of(length: int, capacity: int = CAPACITY, finest: int = FINEST) -> int:
    """The finest class whose share (capacity // k) still holds the piece."""
    return min(finest, capacity // length)


def cut(length: int, capacity: int = CAPACITY, slack: float = SLACK, finest: int = FINEST) -> list[int]:
    """Piece lengths of a document of this many ids: whole sequences, then pieces that nearly fill a class's share."""
    pieces, rest = [capacity] * (length // capacity), length % capacity
    while rest:
        k = class_of(rest, capacity, finest)
        share = capacity // k
        if k >= finest or share - rest <= slack * share:
            pieces.append(rest)
            break
        pieces.append(capacity // (k + 1))
        rest -= pieces[-1]
    return pieces


def _fill(batches: Iterator[pa.RecordBatch], encode: Callable[[], Callable[[list[str]], list[bytes]]], capacity: int, slack: float, finest: int) -> Iterator[pa.RecordBatch]:
    ids_of = encode()
    worker = TaskContext.get().partitionId() if TaskContext.get() else 0
    waiting: dict[int, list[tuple]] = {}
    rows: list[tuple] = []
    bins, end = 0, (0).to_bytes(4, "little")
    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch.column("text").to_pylist()), strict=True):
            view = memoryview(b"".join((ids, end)))
            total, start = len(view) // 4, 0
            for length in cut(total, capacity, slack, finest):
                piece = (doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total)
                k = class_of(length, capacity, finest)
                start += length
                if k > 1:
                    group = waiting.setdefault(k, [])
                    group.append(piece)
                    if len(group) < k:
                        continue
                    del waiting[k]
                else:
                    group = [piece]
                offset = 0
                for one in group:
                    rows.append((*one, (worker << 36) + bins, offset, k, worker, None))
                    offset += one[2]
                bins += 1
        if len(rows) > 50_000:
            yield _batch(rows)
            rows = []
    for k, group in sorted(waiting.items()):
        rows += [(*one, None, None, k, worker, i) for i, one in enumerate(group)]
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _best_fit(pieces, capacity: int):
    """The last pieces of all classes, longest first, each into the fullest sequence that has room."""
    import pandas as pd

    rooms: list[tuple[int, int]] = []
    used: list[int] = []
    out = []
    for p in pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True]).itertuples(index=False):
        at = bisect_left(rooms, (p.length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(used)
            used.append(0)
        out.append((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens, (1 << 61) + b, used[b]))
        used[b] += p.length
        if room > p.length:
            insort(rooms, (room - p.length, b))
    return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]], capacity: int = CAPACITY, slack: float = SLACK, finest: int = FINEST) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their places in sequences of at most capacity ids.

    encode: gives, in a worker, a function from texts to their ids as little-endian unsigned 32-bit integers.
    Every document gets id 0 at its end, so a null or empty text is one id and no document is without pieces.
    Repeated rows are packed as often as they occur; a null doc_id stays null. A very long text is cut like any other.
    An empty table gives no rows. Other columns of docs, whatever their names, play no part.
    """
    fill = partial(_fill, encode=encode, capacity=capacity, slack=slack, finest=finest)
    pieces = stored(id_text(docs).mapInArrow(fill, _SCHEMA), "pieces", file_count(docs))
    result = [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    whole = pieces.where(F.col("sequence_id").isNotNull()).select(*result)

    # at most k-1 pieces of class k a worker: a row for each class and worker, then running sums over these
    left = pieces.where(F.col("sequence_id").isNull())
    by_class = Window.partitionBy("class")
    counts = left.groupBy("class", "worker").agg(F.count(F.lit(1)).alias("n"))
    places = counts.select("class", "worker", F.coalesce(F.sum("n").over(by_class.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by_class).alias("all"))
    ranked = (
        left.join(places, ["class", "worker"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .withColumn("full", F.floor(F.col("all") / F.col("class")) * F.col("class"))
        .withColumn("bin", F.expr("rank div class"))
    )
    in_bin = Window.partitionBy("class", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    joined = (
        ranked.where("rank < full")
        .withColumn("sequence_id", F.expr("shiftleft(1L, 60) + shiftleft(cast(class as bigint), 40) + bin"))
        .withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long"))
        .select(*result)
    )
    # fewer than k pieces of each class k <= finest: at most finest * finest / 2 rows, whatever the input
    last = (
        ranked.where("rank >= full")
        .select(*[c for c in result[:5]], F.lit(0).alias("all"))
        .groupBy("all")
        .applyInPandas(partial(_best_fit, capacity=capacity), COLUMNS + ", sequence_id long, offset long")
        .select(*result)
    )
    return whole.unionByName(joined).unionByName(last).coalesce(file_count(docs))


def _encode(path: str) -> Callable[[list[str]], list[bytes]]:
    return encoder(path).encode_many


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed by the byte-level vocabulary into sequences of 1024."""
    return pack(table(spark, sf_dir, "documents"), partial(_encode, default_vocabulary()))
