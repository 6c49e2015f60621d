"""Whole texts to token ids with a byte-level BPE file, through the distinct pieces of each batch.

The pre-tokenizer of such a file splits a text before each white-space run that follows something else, and between
an ASCII letter or digit and ASCII punctuation. Pieces cut there encode on their own, so every distinct piece is
encoded once per worker by the `tokenizers` library and the ids of a text are gathered from a table. A text that
holds a special token's string is encoded whole, and so is every text where the file states another pre-tokenizer.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import SpanHash, utf8_blocks

#: Distinct pieces that a worker remembers before it starts anew; bounds its memory.
MEMO_PIECES = 1_000_000


def _byte_classes():
    kind = np.zeros(256, np.uint8)  # 1: ASCII letter or digit, 2: ASCII punctuation, 3: white space that starts a piece
    for c in range(0x21, 0x7F):
        kind[c] = 1 if chr(c).isalnum() else 2
    kind[[0x20, 0x0A, 0x09, 0x0D]] = 3
    return kind


KIND = _byte_classes()


def cuts(b: np.ndarray) -> np.ndarray:
    """Flags of the bytes before which a text may be cut without changing its tokens."""
    n = len(b)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    k = KIND[b]
    before, here = k[:-1], k[1:]
    plain = (before == 1) | (before == 2)
    wide = b[:-1] >= 0x80  # the end of a wider character, unless that may be white space (U+0085, U+00A0, U+1680, U+2000...)
    if wide.any():
        two = np.zeros(n - 1, np.uint8)
        two[1:] = b[:-2]
        three = np.zeros(n - 1, np.uint8)
        three[2:] = b[:-3]
        wide &= (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3))
        plain |= wide
    out[1:] = (plain & (here == 3)) | ((before == 1) & (here == 2))
    return out


class PieceMemo:
    """Piece hash -> ids, of one worker, in an open hash table. Subclasses say where texts may be cut (flags), hash spans, and encode new pieces (add).

    A piece is known by its 64-bit hash; its bytes are not kept."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.count = self.used = 0
        self.first, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32)
        self._table(13)

    def _table(self, bits: int) -> None:
        self.bits = bits
        self.key, self.slot = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _room(self, name: str, n: int) -> None:
        """Make an array at least n long, at twice its length or more, so that growing costs little."""
        own = getattr(self, name)
        if len(own) < n:
            setattr(self, name, np.concatenate((own, np.zeros(max(n, 2 * len(own)) - len(own), own.dtype))))

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Put distinct keys into the table."""
        at, mask = (keys >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        left = np.arange(len(keys))
        while len(left):
            free = left[self.key[at[left]] == 0]
            self.key[at[free]] = keys[free]  # of several for one place the last stays
            won = free[self.key[at[free]] == keys[free]]
            self.slot[at[won]] = numbers[won]
            left = left[self.key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask

    def insert(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Remember the ids (flat, so many each) of distinct new keys."""
        n, end = self.count + len(keys), self.used + len(flat)
        for name, m in (("first", n), ("size", n), ("flat", end)):
            self._room(name, m)
        self.flat[self.used : end] = flat
        self.first[self.count : n], self.size[self.count : n] = self.used + np.cumsum(size) - size, size
        if 2 * n > len(self.key):
            old, numbers = self.key, self.slot
            self._table(max(self.bits + 1, (2 * n).bit_length()))
            self._place(old[old != 0], numbers[old != 0])
        self._place(keys, np.arange(self.count, n, dtype=np.int32))
        self.count, self.used = n, end

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for unknown ones."""
        at, mask = (keys >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        there = self.key[at]
        out = np.where(there == keys, self.slot[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            there = self.key[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.slot[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def find_all(self, hashes, data, starts, ends):
        """Where the memo has each piece; new ones are encoded first."""
        hashes = np.maximum(hashes, np.uint64(1))  # zero marks free places
        at = self._find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.count > MEMO_PIECES:
                self.clear()
                new = np.arange(len(hashes))
            keys, one = np.unique(hashes[new], return_index=True)
            self.add(keys, data, starts[new[one]], ends[new[one]])
            at[new] = self._find(hashes[new])
        return at

    def run(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one block, and where each row's ids start."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        flags = self.flags(data)
        flags[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(flags)
        ends = np.concatenate((starts[1:], [len(data)]))
        at = self.find_all(self.hash(data, starts, ends), data, starts, ends)
        first, size = self.first[at], self.size[at].astype(np.int64)
        total = np.cumsum(size)
        ids = self.flat[np.repeat(first - (total - size), size) + np.arange(total[-1])]
        total = np.concatenate(([0], total))
        return ids, total[np.searchsorted(starts, offsets)]


class Memo(PieceMemo):
    """Pieces of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        before = known.get("pre_tokenizer") or {}
        # of another pre-tokenizer, or after a normaliser, pieces need not encode on their own
        self.whole = bool(known.get("normalizer")) or before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hash = SpanHash(20_011)
        super().__init__()

    flags = staticmethod(cuts)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def add(self, keys, data, starts, ends):
        raw = data.tobytes()
        got = self._encode([raw[a:z].decode("utf-8", "replace") for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.insert(keys, np.fromiter((i for ids in got for i in ids), np.uint32, int(size.sum())), size)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one block, and where each row's ids start; rows with a special token's string go whole."""
        raw = data.tobytes() if self.whole or self.special else b""
        if self.whole or any(s in raw for s in self.special):
            parts = []
            for i in range(len(offsets) - 1):
                row = raw[offsets[i] : offsets[i + 1]]
                if self.whole or any(s in row for s in self.special):
                    parts.append(np.array(self._encode([row.decode("utf-8", "replace")])[0], np.uint32))
                else:
                    parts.append(self.run(data[offsets[i] : offsets[i + 1]], np.array([0, len(row)]))[0])
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return self.run(data, offsets)


_memos: dict[str, Memo] = {}


def token_blocks(column, path: str):
    """Yield (first row, last row + 1, ids, offsets) for an Arrow string column; null is empty."""
    memo = _memos.get(path) or _memos.setdefault(path, Memo(path))
    for lo, hi, data, at in utf8_blocks(column):
        ids, starts = memo.block(data, at)
        yield lo, hi, ids, starts
