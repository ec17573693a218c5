"""Benchmark decontamination over an FM-index per training shard.

A phrase is PHRASE consecutive words of a benchmark item; an item of fewer words, but not none, is one phrase.
A shard is a run of documents of about SHARD_WORDS words. Its index holds every word of every different text in it (texts
that are equal are indexed once), so it answers any phrase, of a benchmark or not. It is the Burrows-Wheeler transform of the
full suffix order, with a wavelet matrix for ranks and every SAMPLE-th text position kept. All phrases are searched
backward together; occurrences are located by walking to a kept position; overlapping spans are merged per document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import file_count, id_text, merged, slices, table

PHRASE = 8
SHARD_WORDS = 1 << 20
SAMPLE = 8
#: Bytes of benchmark texts that are searched for at a time.
BLOCK_BYTES = 32 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Word bytes stay (letters in lower case), all other ASCII becomes a blank.
FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Numbers(dict):
    """bytes -> number from 1, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Phrases:
    """Distinct phrases of a block of items as rows of word numbers (from 1), by length; items by phrase."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = PHRASE) -> None:
        number = Numbers()
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [number[w] for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                of.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.words = [b"", *number]
        self.names = sorted(set().union(*of.values())) if of else []
        at = {x: i for i, x in enumerate(self.names)}
        self.by_length: dict[int, np.ndarray] = {}
        self.items: dict[int, list[np.ndarray]] = {}
        for n in sorted({len(p) for p in of}):
            group = [p for p in of if len(p) == n]
            self.by_length[n] = np.array(group, np.int64)
            self.items[n] = [np.array(sorted(at[x] for x in of[p]), np.int64) for p in group]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text that ends with its one smallest symbol, 0.

    First by as many symbols as fit in a word; then, doubling, only suffixes that still tie are put in order again.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = 63 // bits
    padded = np.concatenate((text, np.zeros(step, np.int64)))
    key = padded[:n].copy()
    for i in range(1, step):
        key <<= bits
        key |= padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_at = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
    while len(open_at):
        suffixes = order[open_at]
        key = rank[suffixes] * n + rank[suffixes + step]  # tied for step symbols: the end isn't among them
        by = np.argsort(key)
        suffixes, key = suffixes[by], key[by]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        order[open_at] = suffixes
        rank[suffixes] = np.maximum.accumulate(np.where(first, open_at, 0))
        open_at = open_at[~(first & np.concatenate((first[1:], [True])))]
        step *= 2
    return order


class Wavelet:
    """Wavelet matrix: per bit of the symbols a bit vector with its running count of ones."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        symbols = symbols.astype(np.uint16 if self.bits <= 16 else np.uint32)
        for b in range(self.bits - 1, -1, -1):
            bit = ((symbols >> b) & 1).astype(bool)
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:], dtype=np.int32)
            self.ones.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            if b:
                symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo, and before hi."""
        first = np.zeros(len(symbols), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            first, lo, hi = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (first, lo, hi))
        return lo - first, hi - first


class FMIndex:
    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE) -> None:
        """text: symbols from 1, with 0 as separator; an end symbol is put below both."""
        text = np.concatenate((text + 1, [0])).astype(np.int64)
        self.size = size + 1
        order = suffix_order(text)
        self.last = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.size))))
        self.wavelet = Wavelet(self.last, self.size)
        self.kept = order % sample == 0
        self.kept_before = np.concatenate(([0], np.cumsum(self.kept)))
        self.positions = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases of one length, all stepped backward together."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        live = np.arange(len(phrases))
        for i in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[live, i] + 1
            a, b = self.wavelet.rank(symbols, lo[live], hi[live])
            lo[live], hi[live] = self.before[symbols] + a, self.before[symbols] + b
            live = live[b > a]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-order rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            found = self.kept[rows[live]]
            at = live[found]
            out[at] = self.positions[self.kept_before[rows[at]]] + steps[at]
            live = live[~found]
            symbols = self.last[rows[live]]
            rows[live] = self.before[symbols] + self.wavelet.rank(symbols, rows[live], rows[live])[0]
            steps[live] += 1
        return out


class Shard:
    """Documents of about limit words, whose different texts are indexed whole. A text of more words is indexed in
    pieces that overlap by all but one word of the longest phrase that is asked for.
    """

    def __init__(self, limit: int = SHARD_WORDS, overlap: int = PHRASE - 1) -> None:
        self.limit, self.overlap = limit, overlap
        self.number = Numbers()
        self.text_of: dict[bytes, int] = {}
        self.rows: list[int] = []  # the text of each document
        self.n_words: list[int] = []  # of each text
        self.pieces: list[np.ndarray] = []
        self.piece_text: list[int] = []
        self.piece_at: list[int] = []
        self.held = 0

    def add(self, text: bytes) -> None:
        known = self.text_of.get(text)
        if known is None:
            known = self.text_of[text] = len(self.n_words)
            words = words_of(text)
            self.n_words.append(len(words))
            ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            at = 0
            while at < len(ids):
                self.pieces.append(ids[at : at + self.limit])
                self.piece_text.append(known)
                self.piece_at.append(at)
                self.held += len(self.pieces[-1]) + 1
                at += self.limit if at + self.limit >= len(ids) else max(1, self.limit - self.overlap)
        self.rows.append(known)

    def index(self) -> None:
        """Builds the index; add() no more."""
        sizes = np.array([len(p) + 1 for p in self.pieces], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        text = np.zeros(int(sizes.sum()), np.int64)
        for at, piece in zip(self.begins.tolist(), self.pieces, strict=True):
            text[at : at + len(piece)] = piece
        self.pieces = []
        self.fm = FMIndex(text, len(self.number) + 1)

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of one length, as rows of this shard's word numbers: text, first word and phrase of each occurrence."""
        lo, hi = self.fm.search(phrases)
        counts = hi - lo
        total = int(counts.sum())
        rows = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(total)
        where = self.fm.locate(rows)
        piece = np.searchsorted(self.begins, where, side="right") - 1
        return np.array(self.piece_text, np.int64)[piece], where - self.begins[piece] + np.array(self.piece_at, np.int64)[piece], np.repeat(np.arange(len(phrases)), counts)

    def occurrences(self, phrase: list[bytes]) -> list[tuple[int, int]]:
        """(document, first word) of each occurrence of any phrase of up to overlap + 1 words."""
        ids = [self.number.get(w, 0) for w in phrase]
        if not ids or 0 in ids or not self.n_words:
            return []
        text, at, _ = self.find(np.array([ids], np.int64))
        found = sorted(set(zip(text.tolist(), at.tolist(), strict=True)))
        return [(row, x) for row, t in enumerate(self.rows) for u, x in found if u == t]

    def matches(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans of occurrences as text, lo, hi; (text, item) pairs as text and place in the names."""
        own = np.array([self.number.get(w, 0) for w in phrases.words], np.int64)
        none = np.zeros(0, np.int64)
        spans, found = [(none,) * 3], [(none,) * 2]
        for n, group in phrases.by_length.items():
            ids = own[group]
            here = np.flatnonzero((ids > 0).all(1))
            if not len(here):
                continue
            text, at, which = self.find(ids[here])
            spans.append((text, at, at + n))
            seen = np.unique(text * len(group) + here[which])
            items = [phrases.items[n][p] for p in (seen % len(group)).tolist()]
            found += [(np.repeat(seen // len(group), [len(x) for x in items]), np.concatenate(items))] if items else []
        return *(np.concatenate(x) for x in zip(*spans, strict=True)), *(np.concatenate(x) for x in zip(*found, strict=True))


class Opened:
    """Blocks of a benchmark; the one that was used last stays open, no other."""

    def __init__(self, blocks: list) -> None:
        self.blocks, self.at, self.phrases = blocks, -1, None

    def __iter__(self) -> Iterator[Phrases]:
        # forth and back in turn, so that the open one is used first
        order = range(len(self.blocks))
        for i in reversed(order) if self.at == len(self.blocks) - 1 else order:
            if i != self.at:
                self.phrases = None
                self.at, self.phrases = i, Phrases(self.blocks[i].value if hasattr(self.blocks[i], "value") else self.blocks[i])
            yield self.phrases


def _judged(shard: Shard, opened: Opened) -> list[tuple[int, list[int], list[str]]]:
    """Of each document of the shard: number of words, spans (merged, flat), items (sorted)."""
    n = len(shard.n_words)
    spans: list[list[int]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    if shard.held:
        shard.index()
        parts = []
        for phrases in opened:
            *part, owner, item = shard.matches(phrases)
            parts.append(part)
            for t, x in zip(owner.tolist(), item.tolist(), strict=True):
                items[t].add(phrases.names[x])
        if parts:
            text, lo, hi = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True):
                spans[t] += [a, b]
    found = [(shard.n_words[t], spans[t], sorted(items[t])) for t in range(n)]
    return [found[t] for t in shard.rows]


def _judge_batch(batch: pa.RecordBatch, opened: Opened, shard_words: int) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Of each row: number of words, spans, items. A shard is a run of rows within the batch."""
    out: list[tuple] = []
    shard = Shard(shard_words)
    for _, _, texts in slices(batch):
        for text in texts:
            shard.add(text)
            if shard.held >= shard_words:
                out += _judged(shard, opened)
                shard = Shard(shard_words)
    out += _judged(shard, opened)
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def _judge(batches: Iterator[pa.RecordBatch], blocks: list, shard_words: int) -> Iterator[pa.RecordBatch]:
    opened = Opened(blocks)
    for batch in batches:
        n, spans, items = _judge_batch(batch, opened, shard_words)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Whole items of the benchmark, about block_bytes at a time."""
    held, block = 0, []
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).where("item is not null and text is not null")
    for row in rows.toLocalIterator():
        block.append((row["item"], row["text"].encode()))
        held += len(block[-1][1])
        if held >= block_bytes:
            yield block
            held, block = 0, []
    yield block


def _digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("n_words"),
                pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([len(x) >= 2 for x in items], pa.bool_()),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (flat lo, hi word bounds of what to remove), items (ids found, sorted).

    A null or empty text has no words; items without words, or with a null id or text, are never found. A very long
    text is indexed in overlapping pieces. Repeated documents are judged one by one; repeated item ids count once; an empty
    table gives no rows. Other columns of docs, whatever their names, play no part. The benchmark, which is the query set,
    is searched in blocks of about block_bytes, each broadcast on its own; a worker opens one at a time.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, block_bytes)]
    return id_text(docs).mapInArrow(partial(_judge, blocks=blocks, shard_words=shard_words), "doc_id long, n_words long, spans array<long>, items array<string>")


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without its words lo..hi-1 of each span, and what stands between them and up to the next word."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    edges = [a for a, _ in places] + [len(text)]
    out, at = [], 0
    for lo, hi in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : edges[lo]])
        at = edges[hi]
    return b"".join([*out, text[at:]])


def _clean(batches: Iterator[pa.RecordBatch], blocks: list, shard_words: int) -> Iterator[pa.RecordBatch]:
    opened = Opened(blocks)
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        texts = batch.column(names.index("text"))
        _, spans, items = _judge_batch(pa.RecordBatch.from_arrays([texts], names=["text"]), opened, shard_words)
        columns = list(batch.columns)
        if any(spans):
            new, sizes = texts.to_pylist(), batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, s in enumerate(spans):
                if s:
                    new[i] = without_spans(new[i].encode(), s).decode()
                    if sizes:
                        sizes[i] = len(new[i])
            columns[names.index("text")] = pa.array(new, texts.type)
            if sizes:
                columns[names.index("n_chars")] = pa.array(sizes, batch.column(names.index("n_chars")).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([len(x) < 2 for x in items]))


def cleaned(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns: contaminated documents (two items or more) go; of the rest the removal spans are cut out.

    n_chars, where there is one, follows the text. A null text stays null. Repeated rows are judged one by one.
    """
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(benchmark, block_bytes)]
    return docs.mapInArrow(partial(_clean, blocks=blocks, shard_words=shard_words), docs.schema).coalesce(file_count(docs))


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contamination(docs, table(spark, sf_dir, "benchmark")).mapInArrow(_digest, SCHEMA).coalesce(file_count(docs))


OP5_SQL = r"""
with bw as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from benchmark where text is not null and item_id is not null),
phrases as (
  select distinct item_id, unnest(case when len(words) < 8 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' ')) end) as phrase,
    least(8, len(words)) as n from bw where len(words) > 0),
dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from documents),
sizes as (select distinct n from phrases),
dp as (
  select doc_id, n, unnest(range(1, len(words) - n + 2)) as i, words from dw, sizes where len(words) >= n),
hits as (
  select d.doc_id, d.i, d.n, p.item_id from (select doc_id, i, n, array_to_string(words[i:i+n-1], ' ') as phrase from dp) d
  join phrases p on p.phrase = d.phrase and p.n = d.n),
covered as (
  select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(i, i + n)) as w from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select dw.doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from dw left join covered on covered.doc_id = dw.doc_id left join items on items.doc_id = dw.doc_id
"""
