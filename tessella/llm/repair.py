"""Token-id files, compressed by Re-Pair grammars.

Documents are tokenized in ascending doc_id order and cut into shards of about SHARD_TOKENS ids. In each shard frequent
pairs of symbols are replaced by nonterminals, round after round, until none is frequent, or ROUNDS or 65,536 rules are reached. A shard's file holds the
rules, the length of each rule's expansion, the symbols that are left, and for each document the place of its first symbol
and of its first id. No rule crosses a document's end, so a document, or any range of its ids, is decoded on its own.
The files are the binary column of a Parquet table: they go where Spark can write and are committed with its tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import file_count, id_text, new_path, table
from .tokens import default_vocabulary, encoder

SHARD_TOKENS = 1 << 20
#: Pairs that are replaced in one round, and the least count of a pair that is worth a rule.
PAIRS, LEAST, ROUNDS = 4096, 8, 12
_HEAD = struct.Struct("<4sHHIIII")
_MAGIC = b"RPG1"
FILES = "part int, shard int, first_doc long, docs long, tokens long, file binary"
_FILES = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("file", pa.binary())])
_SLOTS = 19


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - _SLOTS)).astype(np.intp)


def compress(ids: np.ndarray, end: int = 0, first: int = 1 << 16, limit: int = 1 << 16, pairs: int = PAIRS, least: int = LEAST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as rows left, right, lengths of the rules' expansions). Symbol first + i is rule i.

    In a round the most frequent pairs get rules; where two of them overlap the left one is replaced. The id end is in no rule.
    """
    text = ids.astype(np.uint32)
    rules, lengths = [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64)
    # places whose pair may be frequent: a rare pair that nothing changed stays rare
    alive = np.flatnonzero((text[:-1] != end) & (text[1:] != end))
    for _ in range(rounds):
        made = sum(map(len, rules))
        if not len(alive) or made >= limit:
            break
        left, right = text[alive], text[alive + 1]
        slots = _slot(left, right)
        likely = np.flatnonzero((np.bincount(slots, minlength=1 << _SLOTS) >= least)[slots])
        alive, slots = alive[likely], slots[likely]
        keys = (left[likely].astype(np.int64) << 32) | right[likely]
        values, counts = np.unique(keys, return_counts=True)
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        chosen = good[np.lexsort((values[good], -counts[good]))][: min(pairs, limit - made)]
        chosen = values[chosen]
        # one pair a slot: the more frequent one now, the other in a later round
        own = _slot((chosen >> 32).astype(np.uint32), (chosen & 0xFFFFFFFF).astype(np.uint32))
        rank = np.full(1 << _SLOTS, -1, np.int32)
        rank[own[::-1]] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int32)
        chosen = chosen[rank[own] == np.arange(len(chosen))]
        rank[own] = -1
        rank[_slot((chosen >> 32).astype(np.uint32), (chosen & 0xFFFFFFFF).astype(np.uint32))] = np.arange(len(chosen), dtype=np.int32)
        which = rank[slots]
        near = np.flatnonzero(which >= 0)
        near = near[chosen[which[near]] == keys[near]]
        places, which = alive[near], which[near]
        run = np.concatenate(([True], np.diff(places) > 1))
        begin = places[np.flatnonzero(run)[np.cumsum(run) - 1]]
        even = (places - begin) % 2 == 0
        places, which = places[even], which[even]
        text[places] = (first + made + which).astype(np.uint32)
        stay, live = np.ones(len(text), bool), np.zeros(len(text), bool)
        stay[places + 1] = False
        live[alive] = live[places] = True
        live[np.maximum(places - 1, 0)] = True
        text, live = text[stay], live[stay]
        live[-1] = False
        alive = np.flatnonzero(live)
        alive = alive[(text[alive] != end) & (text[alive + 1] != end)]
        new = np.stack((chosen >> 32, chosen & 0xFFFFFFFF), 1)
        known = np.concatenate((lengths, np.zeros(len(new), np.int64)))
        size = lambda s: np.where(s >= first, known[np.maximum(s - first, 0)], 1)
        lengths = np.concatenate((lengths, size(new[:, 0]) + size(new[:, 1])))
        rules.append(new)
    return text.astype(np.int64), np.concatenate(rules), lengths


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, vocabulary: int = 1 << 16) -> bytes:
    """A shard's file. starts: place of each document's first id; each document ends with id 0."""
    text, rules, lengths = compress(ids, first=vocabulary)
    sizes = np.where(text >= vocabulary, lengths[np.maximum(text - vocabulary, 0)] if len(lengths) else 1, 1)
    at = np.searchsorted(np.cumsum(sizes) - sizes, starts)
    parts = [rules.astype("<u4"), lengths.astype("<u4"), text.astype("<u4"), doc_ids.astype("<i8"), at.astype("<u4"), starts.astype("<u4")]
    return _HEAD.pack(_MAGIC, 1, 0, len(rules), len(text), len(doc_ids), len(ids)) + b"".join(p.tobytes() for p in parts)


class ShardFile:
    """A shard's file, opened. document(i) and ids(lo, hi) decode what they need and no more."""

    def __init__(self, data: bytes, vocabulary: int = 1 << 16) -> None:
        magic, version, _, n_rules, n_symbols, n_docs, self.tokens = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a token file")
        at, self.vocabulary = _HEAD.size, vocabulary

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64), take("<u4", n_rules).astype(np.int64)
        self.symbols, self.doc_ids = take("<u4", n_symbols).astype(np.int64), take("<i8", n_docs)
        self.at, self.starts = take("<u4", n_docs).astype(np.int64), take("<u4", n_docs).astype(np.int64)
        self._flat = self._begin = None

    def _expansions(self) -> None:
        """All rules' expansions end to end, level by level of the grammar."""
        self._begin = np.cumsum(self.lengths) - self.lengths
        flat = np.zeros(int(self.lengths.sum()), np.int64)
        v, size = self.vocabulary, lambda s: np.where(s >= v, self.lengths[np.maximum(s - v, 0)], 1)
        depth = np.zeros(len(self.rules), np.int64)
        while True:  # a rule's depth is one more than that of the deeper of its two symbols
            below = np.where(self.rules >= v, depth[np.maximum(self.rules - v, 0)] + 1, 0).max(1)
            if (below == depth).all():
                break
            depth = below
        for d in range(int(depth.max(initial=-1)) + 1):
            rows = np.flatnonzero(depth == d)
            for side in (0, 1):
                s = self.rules[rows, side]
                into = self._begin[rows] + (size(self.rules[rows, 0]) if side else 0)
                plain = s < v
                flat[into[plain]] = s[plain]
                ref, to = s[~plain] - v, into[~plain]
                n = self.lengths[ref]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(to, n) + step] = flat[np.repeat(self._begin[ref], n) + step]
        self._flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._flat is None:
            self._expansions()
        v = self.vocabulary
        table_of = np.concatenate((np.arange(v), self._flat))
        n = np.where(symbols >= v, self.lengths[np.maximum(symbols - v, 0)], 1) if len(self.lengths) else np.ones(len(symbols), np.int64)
        begin = np.where(symbols >= v, v + self._begin[np.maximum(symbols - v, 0)], symbols) if len(self.lengths) else symbols
        return table_of[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.at[i] : self.at[i + 1] if i + 1 < len(self.at) else None])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the shard: only symbols whose expansions meet this range are expanded."""
        first = max(0, int(np.searchsorted(self.starts, lo, side="right")) - 1)
        symbols = self.symbols[self.at[first] :]
        n = np.where(symbols >= self.vocabulary, self.lengths[np.maximum(symbols - self.vocabulary, 0)], 1) if len(self.lengths) else np.ones(len(symbols), np.int64)
        ends = self.starts[first] + np.cumsum(n)
        a, b = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi, side="left")) + 1
        out, at = self.expand(symbols[a:b]), int(ends[a] - n[a]) if a < len(ends) else lo
        return out[lo - at : hi - at]


def _write(batches: Iterator[pa.RecordBatch], encode: Callable[[], Callable[[list[str]], list[bytes]]], shard_tokens: int) -> Iterator[pa.RecordBatch]:
    ids_of, end = encode(), (0).to_bytes(4, "little")
    part, shard = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    docs, parts, held = [], [], 0

    def out():
        nonlocal docs, parts, held, shard
        ids = np.frombuffer(b"".join(parts), "<u4")
        ends = np.cumsum([len(p) // 4 for p in parts])
        file = write_shard(ids, np.array([-(1 << 63) if d is None else d for d in docs], np.int64), np.concatenate(([0], ends[:-1])))
        row = pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, shard, docs[0], len(docs), len(ids), file), _FILES, strict=True)], schema=_FILES)
        docs, parts, held, shard = [], [], 0, shard + 1
        return row

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch.column("text").to_pylist()), strict=True):
            docs.append(doc_id)
            parts.append(b"".join((ids, end)))
            held += len(parts[-1]) // 4
            if held >= shard_tokens:
                yield out()
    if docs:
        yield out()


def write_files(docs: DataFrame, path: str, encode: Callable[[], Callable[[list[str]], list[bytes]]], shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of all documents to the table of files at path.

    Documents are in ascending doc_id order, null first; those of one doc_id in the order of their texts' hashes. Other columns
    of docs, whatever their names, play no part.
    """
    docs = id_text(docs).withColumn("hash", F.xxhash64("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), file_count(docs))
    ordered = docs.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    ordered.mapInArrow(partial(_write, encode=encode, shard_tokens=shard_tokens), FILES).write.parquet(path)


_DOCS = "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, data in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("file"), strict=True):
            file = ShardFile(data.as_buffer())
            ids = memoryview(file.expand(file.symbols).tobytes())
            ends = np.concatenate((file.starts[1:], [file.tokens]))
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(file.starts.tolist(), ends.tolist(), strict=True)]
            doc_ids = pa.array(file.doc_ids, mask=file.doc_ids == -(1 << 63))
            n = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), doc_ids, pa.array(file.starts), pa.array(ends - file.starts), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILES).parquet(path)
    # a row for each part, then running sums over parts and over a part's shards
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = files.select("part", "shard", inside.alias("shard_before")).join(parts, "part").select("part", "shard", (F.col("part_before") + F.col("shard_before")).alias("before"))
    # files are decoded where they are read; only the documents' rows meet the places
    return files.select("part", "shard", "file").mapInArrow(_read, _DOCS).join(places, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _encode(path: str) -> Callable[[list[str]], list[bytes]]:
    return encoder(path).encode_many


def op2_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a null text as an empty one, each with id 0 at its end: written, read back, decoded.

    Repeated doc_ids stay separate documents, one after the other; a very long text is one document of one shard; an empty
    table makes a table without files.
    """
    path = new_path(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), path, partial(_encode, default_vocabulary()))
    return read_files(spark, path)
