"""Byte-level BPE through the tokenizers library, with a memo of words.

A pre-token of this vocabulary never spans a single blank, or a single line break, that stands between
two characters that are no white space. So a text may be cut there, and the library's ids of the pieces
joined are its ids of the whole text. The memo holds the ids that the library gave for such pieces. A piece
of Latin letters and then ASCII punctuation without an apostrophe is two pre-tokens, which go straight
to the library's model; any other piece goes through the whole library.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose distinct pieces are looked up together.
SLICE = 8 << 20
#: Entries that the memo of pieces and that of pre-tokens hold at most; a full one is emptied.
MEMO, STEMS = 150_000, 800_000
_CUT_BLANK, _CUT_LINE, _GOOD = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"(?<=\S)\n(?=\S)"), re.compile(r"(?: ?\S+|\n)\Z")
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)\Z")
_PART = re.compile(r"(?: ?[A-Za-zÀ-ÖØ-öø-ɏ]+|[!-&(-/:-@\[-`{-~]*)\Z")
#: ASCII punctuation without the apostrophe, as in the pattern above.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.library.model
        self.memo: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _pretoken(self, part: str) -> bytes:
        found = self.stems.get(part)
        if found is None:
            if len(self.stems) >= STEMS:
                self.stems.clear()
            mapped = part.replace(" ", "Ġ") if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
            self.stems[part] = found = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found

    def _learn(self, piece: str) -> bytes | None:
        """The ids of a piece, which go into the memo; None if it isn't a plain piece."""
        if m := _WORD.match(piece):
            ids = self._pretoken(m[1]) + self._pretoken(m[2]) if m[2] else self._pretoken(m[1])
        elif _GOOD.match(piece):
            ids = self._library(piece)
        else:
            return None
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "\0" in text:
            return self._library(text)
        pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        found = list(map(self.memo.get, pieces))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self.memo.get(pieces[at]) or self._learn(pieces[at])
                if found[at] is None:
                    return self._odd(text)
        except ValueError:
            return b"".join(found)

    def encode_many(self, texts: list[str]) -> list[bytes | memoryview]:
        """The ids of each text. Every distinct piece of a slice of texts is looked up once."""
        out: list = []
        lo = held = 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= SLICE or i + 1 == len(texts):
                out += self._slice(texts[lo : i + 1])
                lo, held = i + 1, 0
        return out

    def _slice(self, texts: list[str]) -> list[bytes | memoryview]:
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring(column, "\0").to_numpy(zero_copy_only=False)
        if whole.any():
            column = pc.if_else(pa.array(whole), "", column)
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(column, " ", "\0 "), "\n", "\0\n\0"), "\0")
        at = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, begins, sizes, odd = self._pieces(coded.dictionary.cast(pa.large_string()))
        begins = begins[codes]
        n = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = memoryview(flat[np.repeat(begins - ends[:-1], n) + np.arange(ends[-1])].tobytes())
        places = (4 * ends[at]).tolist()
        out = [ids[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        strange = whole
        if odd.any():
            strange = whole | (np.add.reduceat(np.append(odd[codes], False), at[:-1]) > 0) if len(codes) else whole
        for i in np.flatnonzero(strange).tolist():
            out[i] = self.encode(texts[i])
        return out

    def _pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: all ids, each piece's first place and number of ids, whether it isn't a plain piece.

        Every piece is seen as two parts, the second being its last marks; every distinct part is looked up once.
        """
        n = len(pieces)
        stem = pc.binary_length(pc.utf8_rtrim(pieces, characters=_MARKS)).to_numpy(zero_copy_only=False)
        edges = np.frombuffer(pieces.buffers()[1], np.int64, n + 1, 8 * pieces.offset) if n else np.zeros(1, np.int64)
        cuts = np.append(np.stack((edges[:-1], edges[:-1] + stem), 1).ravel(), edges[-1])
        parts = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(cuts), pieces.buffers()[2] if n else pa.py_buffer(b"")).dictionary_encode()
        which = parts.indices.to_numpy().reshape(n, 2)
        texts = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.stems.get, texts))
        strange = np.zeros(len(texts), bool)
        for i, ids in enumerate(found):
            if ids is None:
                if _PART.match(texts[i]):
                    found[i] = self._pretoken(texts[i]) if texts[i] else b""
                else:
                    found[i], strange[i] = b"", True
        # a piece of marks alone, or whose first part isn't one pre-token, is looked up as a whole
        other = np.flatnonzero(strange[which[:, 0]] | (stem == 0))
        odd = np.zeros(n, bool)
        which = which.astype(np.int64)
        for i, piece in zip(other.tolist(), pieces.take(pa.array(other)).to_pylist(), strict=True):
            ids = self.memo.get(piece) or self._learn(piece)
            odd[i] = ids is None
            which[i] = len(found)
            found += (ids or b"", b"")
            which[i, 1] += 1
        ids = np.frombuffer(b"".join(found), "<u4")
        n_ids = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        first = np.cumsum(n_ids) - n_ids
        each = n_ids[which].ravel()
        ends = np.cumsum(each)
        flat = ids[np.repeat(first[which].ravel() - (ends - each), each) + np.arange(ends[-1] if n else 0)]
        sizes = each.reshape(n, 2).sum(1)
        return flat, np.cumsum(sizes) - sizes, sizes, odd

    def _odd(self, text: str) -> bytes:
        """Odd white space somewhere: cut only where it's plain."""
        pieces = _CUT_LINE.sub("\0\n\0", _CUT_BLANK.sub("\0", text)).split("\0")
        return b"".join([self.memo.get(p) or self._learn(p) or self._library(p) for p in pieces])

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
