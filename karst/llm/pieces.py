"""SentencePiece encoding and decoding of texts of any length by a max-plus parallel scan.

A text is its best segmentation into the pieces of a model file under the file's own scores (a unigram lattice; an
unknown character falls back to its bytes). A long text is split into chunks of CHUNK characters. Of each chunk a
transfer matrix is computed on its own: entry state s says that the first s characters already belong to a piece begun
before, exit state e that the last piece reaches e characters into the next chunk, and the entry is the best score
between them. Matrices multiply in (max, +), which is associative: first in blocks of FAN chunks, then over the
blocks of a document; the products fix every chunk's entry and exit state, and each chunk is then traced back alone.

The numbers are complex: the real part adds up scores, held as multiples of 2**-16 so that the order of adding does not
matter; the imaginary part adds up a tie number of each piece, fixed by its place in its word and its length. Complex
numbers compare by their real parts first, so ties are settled alike wherever a text is cut.

White space begins a piece and never lies after another character within one, so the lattice falls into words there;
each distinct word is solved once per worker, many at a time in numpy, and only the words at a chunk's ends need the
matrix. A vocabulary with pieces across words is refused.

Cases: null and empty texts give no ids; characters of no piece become byte pieces; a U+2581 in a text decodes to a
space; equal scores take the larger sum of tie numbers, so ids do not depend on CHUNK; null or repeated ids and rows
are encoded like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix
from .tokens import PieceMemo

CHUNK, FAN = 16_384, 256
SPACE = 0x2581
NONE = -1e18


class Model:
    """Pieces by the hashes of their characters, in an open table."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.array([self.bytes.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)])
        kept = [(sp.id_to_piece(i), round(sp.get_score(i) * 65536) / 65536, i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(b == chr(SPACE) and a != chr(SPACE) for p, _, _ in kept for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece of this model reaches over white space")
        self.longest = max(len(p) for p, _, _ in kept)
        self.unknown = min(s for _, s, _ in kept) - 10.0
        self.text = [b""] * n
        for p, _, i in kept:
            self.text[i] = p.replace(chr(SPACE), " ").encode()
        for p, i in self.bytes.items():
            self.text[i] = bytes([int(p[3:5], 16)])
        self.rng = np.random.default_rng(6_007)
        self.base = np.uint64(int(self.rng.integers(2**63)) | 1)
        self.powers = np.cumprod(np.full(self.longest + 1, self.base, np.uint64), dtype=np.uint64)
        self.bits = 18
        slots = 1 << self.bits
        self.key = np.zeros(slots, np.uint64)
        self.id = np.full(slots, -1, np.int32)
        self.score = np.full(slots, NONE)
        self.tries = 0
        for p, s, i in kept:
            h = self._hash(np.array([ord(c) for c in p], np.uint64))
            at, k = int(h >> np.uint64(64 - self.bits)), 1
            while self.id[at] >= 0:
                at, k = (at + 1) % slots, k + 1
            self.key[at], self.id[at], self.score[at] = h, i, s
            self.tries = max(self.tries, k)
        ends = np.cumsum([0, *map(len, self.text)])
        self.flat, self.first, self.size = np.frombuffer(b"".join(self.text), np.uint8), ends[:-1], np.diff(ends)

    def _hash(self, chars: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in mix(chars + np.uint64(977)):
            h = h * self.base + c
        return mix(h)[0]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of hashes; -1 where there is no piece."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.key[at]
        hit = key == h
        ids, scores = np.where(hit, self.id[at], np.int32(-1)), np.where(hit, self.score[at], NONE)
        left = np.flatnonzero(~hit & (key != 0))
        for k in range(1, self.tries):
            if not len(left):
                break
            slot = (at[left] + k) & ((1 << self.bits) - 1)
            hit = self.key[slot] == h[left]
            ids[left[hit]], scores[left[hit]] = self.id[slot[hit]], self.score[slot[hit]]
            left = left[~hit & (self.id[slot] >= 0)]
        return ids, scores

    def candidates(self, chars: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (ends x lengths) of the pieces of 1 to length characters that end after each character."""
        n = len(chars)
        v = mix(chars.astype(np.uint64) + np.uint64(977))
        ids, scores = np.full((n, length), -1, np.int32), np.full((n, length), NONE)
        h = np.zeros(n, np.uint64)
        for k in range(min(length, n)):
            # the hash of chars[i - k : i + 1] at i, from that of chars[i - k + 1 : i + 1]
            h[k:] = h[k:] + v[: n - k] * (self.powers[k - 1] if k else np.uint64(1))
            ids[k:, k], scores[k:, k] = self.look(mix(h[k:]))
        alone = ids[:, 0] < 0
        scores[alone, 0] = self.unknown
        return ids, scores

    def weights(self, scores: np.ndarray, start: int = 0) -> np.ndarray:
        """Scores of candidates (ends x lengths) with their tie numbers; the stretch begins at character `start` of its word."""
        n, length = scores.shape
        place = (start + np.arange(n)[:, None] - np.arange(length)).astype(np.uint64)
        return scores + 1j * self._ties(place, np.arange(length, dtype=np.uint64))

    @staticmethod
    def _ties(place: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (mix(place * np.uint64(64) + length + np.uint64(1)) >> np.uint64(44)).astype(float)

    def spell(self, chars: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids with unknown characters (-1) as byte pieces."""
        if (ids >= 0).all():
            return ids.astype(np.uint32)
        out = []
        for i, e in zip(ids.tolist(), ends.tolist(), strict=True):
            out += [i] if i >= 0 else self.byte_ids[np.frombuffer(chr(chars[e - 1]).encode("utf-8", "replace"), np.uint8)].tolist()
        return np.array(out, np.uint32)

    def forward(self, scores: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        """Best scores (positions x entries) of reaching each position of one stretch; no piece begins at or after size.

        scores: of the candidates, ends x lengths; start: entry scores of the first positions, positions x entries."""
        n, longest = len(scores), self.longest
        value = np.full((n + 1, start.shape[1]), NONE, complex)
        value[: len(start)] = start[: n + 1]
        for i in range(1, min(n, size) + 1):
            k = min(i, longest)
            value[i] = np.maximum(value[i], (value[i - k : i][::-1] + scores[i - 1, :k, None]).max(0))
        for i in range(size + 1, n + 1):
            lo = max(0, i - longest)
            if lo < size:
                value[i] = np.maximum(value[i], (value[lo:size][::-1] + scores[i - 1, i - size : i - lo, None]).max(0))
        return value

    def best(self, scores: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Like forward from position 0: scores, and back pointers as piece lengths."""
        n, longest = len(scores), self.longest
        value, back = np.full(n + 1, NONE, complex), np.zeros(n + 1, np.int64)
        value[0] = 0
        for i in range(1, n + 1):
            k, least = min(i, longest), max(0, i - size)  # at least `least` + 1 characters, to begin before size
            total = (value[i - k : i - least][::-1] + scores[i - 1, least:k])[::-1]
            if len(total):
                j = int(np.argmax(total))
                if total[j].real > NONE / 2:
                    value[i], back[i] = total[j], k - j
        return value, back

    def trace(self, chars, back, ids, end: int) -> tuple[np.ndarray, int]:
        """Ids from the back pointers, and where the first one begins."""
        own, at = [], []
        while end > 0 and back[end]:
            own.append(ids[end - 1, back[end] - 1])
            at.append(end)
            end -= back[end]
        return self.spell(chars, np.array(own[::-1], np.int64), np.array(at[::-1], np.int64)), end

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, with the space that encoding puts first."""
        first, size = self.first[ids], self.size[ids]
        total = np.cumsum(size)
        return self.flat[np.repeat(first - (total - size), size) + np.arange(total[-1])] if len(ids) else self.flat[:0]


class Words(PieceMemo):
    """Distinct words -> ids; words of one length are solved together."""

    def __init__(self, path: str):
        self.model = Model(path)
        super().__init__()
        self.up = self.down = np.zeros(0, np.uint64)

    def flags(self, chars):
        out = np.zeros(len(chars), bool)
        out[1:] = (chars[1:] == SPACE) & (chars[:-1] != SPACE)
        return out

    def hash(self, chars, starts, ends):
        n = len(chars)
        if len(self.up) <= n:
            size = max(n + 1, 1 << 20)
            base, inverse = self.model.base, np.uint64(pow(int(self.model.base), -1, 2**64))
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, b, np.uint64))), dtype=np.uint64) for b in (base, inverse))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(977)) * self.up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def solve(self, chars, starts, ends):
        """(ids, sizes) of words given by bounds; words of like length are solved together, up to 64 characters."""
        m, model = len(starts), self.model
        size = ends - starts
        sizes, firsts = np.zeros(m, np.int64), np.zeros(m, np.int64)
        flats, done = [], 0

        def put(words, flat, n):
            nonlocal done
            sizes[words], firsts[words] = n, done + np.cumsum(n) - n
            flats.append(flat)
            done += len(flat)

        low = 0
        for high in (6, 9, 13, 18, 26, 40, 64):
            group = np.flatnonzero((size > low) & (size <= high))
            low = high
            step = max(256, 300_000 // high)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                flat, n = self._solve(chars, starts[part], size[part])
                put(part, flat, n)
        for p in np.flatnonzero(size > 64).tolist():
            own = chars[starts[p] : ends[p]]
            ids, scores = model.candidates(own, model.longest)
            _, back = model.best(model.weights(scores), len(own))
            flat = model.trace(own, back, ids, len(own))[0]
            put(np.array([p]), flat, np.array([len(flat)]))
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        total = np.cumsum(sizes)
        return flat[np.repeat(firsts - (total - sizes), sizes) + np.arange(len(flat))], sizes

    def _solve(self, chars, starts, size):
        """(ids, numbers of ids) of words of like length, characters down and words across."""
        model, m, w = self.model, len(starts), int(size.max())
        longest = min(model.longest, w)
        place = np.arange(w)[:, None]
        own = np.where(place < size, chars[np.minimum(starts + place, len(chars) - 1)], 0).astype(np.uint64)
        v = mix(own + np.uint64(977))
        h = np.zeros((w, m), np.uint64)
        # of each end, pieces from the longest to the shortest
        scores, names = np.full((w, longest, m), NONE), np.full((w, longest, m), -1, np.int32)
        for k in range(longest):
            h[k:] += v[: w - k] * (model.powers[k - 1] if k else np.uint64(1))
            i, x = model.look(mix(h[k:]).ravel())
            scores[k:, longest - 1 - k], names[k:, longest - 1 - k] = x.reshape(-1, m), i.reshape(-1, m)
        scores[:, -1][names[:, -1] < 0] = model.unknown
        # the piece that ends at e and begins at s of a word has the same tie number in all words
        size_of = np.arange(longest, 0, -1)
        ties = 1j * model._ties((np.arange(1, w + 1)[:, None] - size_of).astype(np.uint64), (size_of - 1).astype(np.uint64))
        value, back, ids = np.full((w + 1, m), NONE, complex), np.zeros((w + 1, m), np.int64), np.full((w + 1, m), -1, np.int32)
        value[0] = 0
        column = np.arange(m)
        for e in range(1, w + 1):
            k = min(e, longest)
            total = value[e - k : e] + (scores[e - 1, longest - k :] + ties[e - 1, longest - k :, None])
            best = np.argmax(total, 0)
            value[e], back[e], ids[e] = total[best, column], k - best, names[e - 1, longest - k + best, column]
        at, steps, on = size.copy(), [], []
        while at.any():
            steps.append(ids[at, column])
            on.append(at > 0)
            at = at - np.where(at > 0, back[at, column], 0)
        steps, on = np.stack(steps[::-1], 1), np.stack(on[::-1], 1)
        flat, n = steps[on], on.sum(1)
        odd = np.flatnonzero(((steps < 0) & on).any(1))
        if len(odd):  # unknown characters: spell those words out
            lists = np.split(flat, np.cumsum(n)[:-1])
            for p in odd.tolist():
                lengths = []
                e = int(size[p])
                while e:
                    lengths.append(e)
                    e -= int(back[e, p])
                lists[p] = model.spell(chars[starts[p] : starts[p] + size[p]], lists[p], np.array(lengths[::-1]))
                n[p] = len(lists[p])
            flat = np.concatenate(lists)
        return flat.astype(np.uint32), n

    def add(self, keys, data, starts, ends):
        self.insert(keys, *self.solve(data, starts, ends))

    # ------------------------------------------------ chunks

    def _edges(self, chunks: list[np.ndarray], sizes: list[int]):
        """Of each chunk, the first and the last place before `size` where a word begins (both None if there is none)."""
        for chars, size in zip(chunks, sizes, strict=True):
            cuts = np.flatnonzero(self.flags(chars)[:size])
            yield (int(cuts[0]), int(cuts[-1])) if len(cuts) else (None, None)

    @staticmethod
    def _begins(chars: np.ndarray, at: int) -> bool:
        """Whether a word begins at a place after the first."""
        return at > 0 and chars[at] == SPACE and chars[at - 1] != SPACE

    def _looked_up(self, parts: list[np.ndarray], starts: list[int]):
        """(ids, weights) of the candidates of each of several stretches, looked up together; starts: where in a word each begins."""
        model = self.model
        ends = np.cumsum([0, *map(len, parts)])
        ids, scores = model.candidates(np.concatenate(parts), model.longest) if ends[-1] else (np.zeros((0, model.longest), np.int32), np.zeros((0, model.longest)))
        return [(ids[a:z], model.weights(scores[a:z], s)) for a, z, s in zip(ends[:-1].tolist(), ends[1:].tolist(), starts, strict=True)]

    def matrices(self, chunks: list[np.ndarray], sizes: list[int], behind: list[int]) -> list[np.ndarray]:
        """The transfer matrices of chunks, chars[:size] of each; what follows is the look-ahead of longest - 1 characters at most.

        behind: how many characters before each chunk the word at its start begins. Every path crosses the same whole words of a chunk, whose score is one constant of the matrix and is left out:
        which path is best does not depend on it."""
        k = self.model.longest
        edges = list(self._edges(chunks, sizes))
        texts = [x for chars, (first, last) in zip(chunks, edges, strict=True) for x in ((chars[:0], chars) if first is None else (chars[:first], chars[last:]))]
        parts = self._looked_up(texts, [x for b, (first, _) in zip(behind, edges, strict=True) for x in (b, b if first is None else 0)])
        made = []
        for i, (chars, size, (first, last)) in enumerate(zip(chunks, sizes, edges, strict=True)):
            own = np.full((k, k), NONE, complex)
            width = len(chars) - size + 1
            if first is None:
                own[:, :width] = self.model.forward(parts[2 * i + 1][1], np.where(np.eye(k) > 0, 0.0, NONE), size)[size:].T
            else:
                head = self.model.forward(parts[2 * i][1], np.where(np.eye(k) > 0, 0.0, NONE)[: first + 1], first)[first]
                tail = self.model.forward(parts[2 * i + 1][1], np.zeros((1, 1)), size - last)[size - last :, 0]
                own[:, :width] = head[:, None] + tail
            made.append(np.maximum(own, NONE))
        return made

    def chunk_ids(self, chunks: list[np.ndarray], sizes: list[int], behind: list[int], entries: list[int], leaves: list[int]) -> list[np.ndarray]:
        """The ids that begin in chars[entry:size] of each chunk, given where they must end: size + leave."""
        model, bounds = self.model, []
        for chars, size, entry in zip(chunks, sizes, entries, strict=True):
            cuts = np.flatnonzero(self.flags(chars)[:size])
            cuts = cuts[cuts >= entry]
            bounds.append((int(cuts[0]), int(cuts[-1])) if len(cuts) else (entry, entry))
        middles = [chars[first:last] for chars, (first, last) in zip(chunks, bounds, strict=True)]
        flat, at = self.run(np.concatenate(middles), np.cumsum([0, *map(len, middles)]))
        ends = [chars[: size + leave] for chars, size, leave in zip(chunks, sizes, leaves, strict=True)]
        parts = [x for chars, entry, (first, last) in zip(ends, entries, bounds, strict=True) for x in (chars[entry:first], chars[last:])]
        starts = [x for chars, b, entry, (first, last) in zip(chunks, behind, entries, bounds, strict=True) for x in (b + entry, b + entry if first == last == entry and not self._begins(chars, entry) else 0)]
        looked, made = self._looked_up(parts, starts), []
        for i, (size, (first, last)) in enumerate(zip(sizes, bounds, strict=True)):
            own = []
            for part, (ids, scores), limit in ((parts[2 * i], looked[2 * i], first), (parts[2 * i + 1], looked[2 * i + 1], size - last)):
                own.append(model.trace(part, model.best(scores, min(limit, len(part)))[1], ids, len(part))[0])
            made.append(np.concatenate((own[0], flat[at[i] : at[i + 1]], own[1])))
        return made


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    return _words.get(path) or _words.setdefault(path, Words(path))


def characters(text: str) -> np.ndarray:
    """The characters of a text as the lattice sees them: a space first, spaces as U+2581."""
    if not text:
        return np.zeros(0, np.uint32)
    return np.frombuffer((" " + text).replace(" ", chr(SPACE)).encode("utf-32-le", "replace"), np.uint32)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of transfer matrices."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NONE)


def chain(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """(entry, exit) states of each chunk of a run with known ends; of equal ones the smaller overhang."""
    k = len(matrices[0]) if matrices else 0
    reach = [np.where(np.arange(k) == entry, 0.0, NONE).astype(complex)]
    for m in matrices:
        reach.append((reach[-1][:, None] + m).max(0))
    states, out = leave, []
    for i in range(len(matrices) - 1, -1, -1):
        before = int(np.argmax(reach[i] + matrices[i][:, states]))
        out.append((before, states))
        states = before
    return out[::-1]


def _whole(docs: DataFrame, path: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        memo = words(path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                z, size = at, 0
                while z < len(texts) and (size < 1_000_000 or z == at):
                    size += len(texts[z] or "")
                    z += 1
                chars = [characters(t or "") for t in texts[at:z]]
                offsets = np.concatenate(([0], np.cumsum([len(c) for c in chars]))).astype(np.int64)
                ids, starts = memo.run(np.concatenate(chars), offsets)
                own = [ids[starts[i] : starts[i + 1]] for i in range(z - at)]
                yield _rows(names.slice(at, z - at), [0] * (z - at), [1] * (z - at), own, [(t or "").replace(chr(SPACE), " ") for t in texts[at:z]], memo.model, [True] * (z - at))
                at = z

    return docs.mapInArrow(run, "doc_id long, chunk int, n_chunks int, n_ids long, ids_crc32 long, round_trip boolean, ids binary")


def _rows(names, chunk, chunks, own, expected, model, first):
    import pyarrow as pa

    same = []
    for ids, text, begins in zip(own, expected, first, strict=True):
        got = model.decode(ids.astype(np.int64)).tobytes()
        same.append((got[1:] if begins and text else got) == text.encode("utf-8", "replace"))
    return pa.RecordBatch.from_arrays([names, pa.array(chunk, pa.int32()), pa.array(chunks, pa.int32()), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in own], pa.int64()), pa.array(same, pa.bool_()), pa.array([x.astype("<u4").tobytes() for x in own], pa.binary())], ["doc_id", "chunk", "n_chunks", "n_ids", "ids_crc32", "round_trip", "ids"])


def _split(docs: DataFrame, longest: int, chunk: int) -> DataFrame:
    """Long texts -> (key, doc_id, chunk, n_chunks, size, behind, text): chunks with the look-ahead that pieces begun in them
    need, and how many characters before each the word at its start begins."""
    begins = re.compile(f"(?<!{chr(SPACE)}){chr(SPACE)}")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = (" " + text).replace(" ", chr(SPACE))
                n = -(-len(text) // chunk)
                if n > 1 and len(text) - (n - 1) * chunk < longest:
                    n -= 1  # no chunk shorter than a piece
                word = 0
                for lo in range(0, n, 64):
                    parts = []
                    for i in range(lo, min(n, lo + 64)):
                        for m in begins.finditer(text, max(0, (i - 1) * chunk + 1), i * chunk + 1):
                            word = m.start()
                        end = (i + 1) * chunk if i < n - 1 else len(text)
                        parts.append((i, end - i * chunk, text[i * chunk : end + longest - 1], i * chunk - word))
                    m = len(parts)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * m, pa.int64()), pa.array([name] * m, pa.int64()), *(pa.array(x, t) for x, t in (([p[0] for p in parts], pa.int32()), ([n] * m, pa.int32()), ([p[1] for p in parts], pa.int32()), ([p[3] for p in parts], pa.int64()), ([p[2] for p in parts], pa.string())))], ["key", "doc_id", "chunk", "n_chunks", "size", "behind", "text"])

    return docs.mapInArrow(run, "key long, doc_id long, chunk int, n_chunks int, size int, behind long, text string")


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """documents (doc_id, text) -> one row per chunk: (doc_id, chunk, n_chunks, n_ids, ids_crc32, round_trip[, ids]).

    round_trip says that decoding the chunk's ids gives its part of the text again."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    longest = Model(path).longest
    own = docs.select(F.col("doc_id").cast("long"), "text")
    far = F.length("text") >= chunk
    short = _whole(own.where(~F.coalesce(far, F.lit(False))), path)
    chunks = scratch.save(_split(own.where(far).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), longest, chunk), "chunks")
    spread = chunks.repartition("key", "chunk")

    def matrices(batches):
        import pyarrow as pa

        memo = words(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [m.tobytes() for m in memo.matrices([_chars(t) for t in part.column(4).to_pylist()], part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], ["key", "chunk", "matrix"])

    moves = scratch.save(spread.select("key", "chunk", "size", "behind", "text").mapInArrow(matrices, "key long, chunk int, matrix binary"), "moves").withColumn("block", F.expr(f"cast(chunk div {FAN} as int)"))

    def square(raw):
        return np.frombuffer(raw, complex).reshape(longest, longest)

    def multiply(group):
        import pyarrow as pa

        group = group.sort_by("chunk")
        out = None
        for raw in group.column("matrix").to_pylist():
            out = square(raw) if out is None else product(out, square(raw))
        return pa.table({"key": group.column("key")[:1], "block": group.column("block")[:1], "matrix": pa.array([out.tobytes()], pa.binary())})

    def outer(group):
        import pyarrow as pa

        group = group.sort_by("block")
        states = chain([square(m) for m in group.column("matrix").to_pylist()], 0, 0)
        return pa.table({"key": group.column("key"), "block": group.column("block"), "entry": pa.array([s for s, _ in states], pa.int32()), "leave": pa.array([e for _, e in states], pa.int32())})

    def inner(group):
        import pyarrow as pa

        group = group.sort_by("chunk")
        states = chain([square(m) for m in group.column("matrix").to_pylist()], group.column("entry")[0].as_py(), group.column("leave")[0].as_py())
        return pa.table({"key": group.column("key"), "chunk": group.column("chunk"), "entry": pa.array([s for s, _ in states], pa.int32()), "leave": pa.array([e for _, e in states], pa.int32())})

    blocks = moves.groupBy("key", "block").applyInArrow(multiply, "key long, block int, matrix binary")
    ends = blocks.groupBy("key").applyInArrow(outer, "key long, block int, entry int, leave int")
    states = moves.join(ends, ["key", "block"]).groupBy("key", "block").applyInArrow(inner, "key long, chunk int, entry int, leave int")

    def back(batches):
        memo = words(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                c = {n: x.to_pylist() for n, x in zip(part.schema.names, part.columns, strict=True)}
                chars = [_chars(t) for t in c["text"]]
                own = memo.chunk_ids(chars, c["size"], c["behind"], c["entry"], c["leave"])
                expected = [t[s : n + e].replace(chr(SPACE), " ")[k == 0 :] for t, n, s, e, k in zip(c["text"], c["size"], c["entry"], c["leave"], c["chunk"], strict=True)]
                yield _rows(part.column("doc_id"), c["chunk"], c["n_chunks"], own, expected, memo.model, [k == 0 for k in c["chunk"]])

    long = chunks.join(states, ["key", "chunk"]).select("doc_id", "chunk", "n_chunks", "size", "behind", "text", "entry", "leave").mapInArrow(back, short.schema)
    out = short.union(long)
    return out if with_ids else out.drop("ids")


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def decode(ids: bytes, path: str) -> str:
    """The text of the ids of a whole document."""
    out = words(path).model.decode(np.frombuffer(ids, "<u4").astype(np.int64)).tobytes().decode("utf-8", "replace")
    return out[1:]
