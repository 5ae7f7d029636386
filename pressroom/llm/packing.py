"""Sequence packing by non-negative least squares.

Documents are packed in blocks of some million tokens, each block by the task that has just encoded it, so nothing is
shuffled and a lost task only packs its own blocks again. In a block, a document gives whole windows and a rest. Rests fall
into bins of equal width; the ways in which a few bins fill a window are enumerated, non-negative least squares finds how often
to repeat each way against the histogram of rests, and the repeats are rounded and laid out. What is left over fills the gaps
greedily, whole where it fits and cut where it doesn't.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Remembered, Texts, text_of

WINDOW = 4096
BINS = 32
PARTS = 4
BLOCK_TOKENS = 8_000_000
TOGETHER = 4_000_000  # characters of texts that are encoded together
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


# ---- encoding


class WordEncoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of a word-level BPE file for the tokenizers library.

    Texts of plain Latin-1 characters are cut together into the pieces that the file's pattern gives, and the library encodes each distinct
    piece once: this tokenizer drops white space and never merges across a cut. Any other text goes through the library whole. Both give the
    library's ids. Pieces that occur again among the same texts are remembered for the next ones, as many as ``Remembered`` allows.
    """

    # Latin-1 bytes that a plain text has none of: controls but tab and line feeds, the no-break blank, the soft hyphen
    ODD = bytes(b for b in range(256) if b < 32 and b not in (9, 10, 13) or 127 <= b <= 160 or b == 173)
    LOWER = bytes(chr(b).lower().encode("latin-1")[0] for b in range(256))
    SPACE, LETTER, NUMBER, SIGN = range(4)
    loaded: dict[int, WordEncoder] = {}

    def __init__(self, config: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.model = self.tokenizer.model
        kinds = regex.compile(r"(\s)|(\p{L})|(\p{N})|([^\s\p{L}\p{N}])", regex.DOTALL)
        self.kind = np.array([kinds.match(chr(b)).lastindex - 1 for b in range(256)], np.uint8)
        self.words: dict[bytes, bytes] = {}
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(printable)]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(moved)}

    @classmethod
    def of(cls, config: str) -> WordEncoder:
        key = hash(config)
        if key not in cls.loaded:
            cls.loaded[key] = cls(config)
        return cls.loaded[key]

    def _word(self, piece: bytes) -> bytes:
        word = piece.decode("latin-1")
        shown = word if word.isascii() else "".join([self.shown[b] for b in word.encode()])
        return b"".join([self.coded[t.id] for t in self.model.tokenize(shown)])

    def _plain(self, text: str) -> bytes | None:
        """The text in lower case, as Latin-1; None if it isn't plain."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return raw.translate(self.LOWER) if len(raw.translate(None, self.ODD)) == len(raw) and "<|" not in text else None

    def _heads(self, raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where the pieces ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`` begin; ``raw`` ends in three blanks."""
        head = kind == self.NUMBER
        head[1:] |= kind[1:] != kind[:-1]
        head[0] = True
        head &= kind != self.SPACE
        mark = np.flatnonzero(raw == ord("'"))
        if mark.size:
            mark = mark[head[mark]]
            after, second = raw[mark + 1], raw[mark + 2]
            short = np.isin(after, np.frombuffer(b"stmd", np.uint8))
            long = ((after == ord("r")) | (after == ord("v"))) & (second == ord("e")) | (after == ord("l")) & (second == ord("l"))
            for found, size in ((mark[short], 2), (mark[long], 3)):
                head[found + 1] = False
                head[found + size] |= kind[found + size] == self.LETTER
        return np.flatnonzero(head)

    def _codes(self, pieces: pa.DictionaryArray) -> list[bytes]:
        """Ids of each distinct piece."""
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = [self._word(p) if c is None else c for p, c in zip(distinct, map(self.words.get, distinct), strict=True)]
        often = np.bincount(pieces.indices.to_numpy(), minlength=len(distinct)).tolist()
        again = ((p, c) for p, c, n in zip(distinct, codes, often, strict=True) if n > 1 and len(p) <= Remembered.LONGEST)
        seen = dict(islice(again, Remembered.MOST))
        if len(self.words) + len(seen) > Remembered.MOST and len(self.words.keys() | seen.keys()) > Remembered.MOST:
            self.words.clear()
        self.words.update(seen)
        return codes

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b" ".join(texts) + b"   ", np.uint8)
        kind = self.kind[raw]
        heads = self._heads(raw, kind)
        shown = kind != self.SPACE
        offsets = np.zeros(len(heads) + 1, np.int32)
        np.cumsum(np.add.reduceat(shown, heads, dtype=np.int32), out=offsets[1:])
        pieces = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(raw[shown])]).dictionary_encode()
        codes = self._codes(pieces)
        ids = np.frombuffer(b"".join(codes), "<u4")
        sizes = np.fromiter(map(len, codes), np.int32, len(codes)) // 4
        which = pieces.indices.to_numpy()
        until = np.zeros_like(offsets)
        np.cumsum(sizes[which], dtype=np.int32, out=until[1:])
        places = np.arange(until[-1], dtype=np.int32)
        places += np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[which] - until[:-1], sizes[which])
        out = ids[places]
        # a text begins where the texts before it and the blanks between them end
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = until[np.searchsorted(heads, begins)].tolist()
        return [out[a:b].tobytes() for a, b in pairwise(cuts)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        done = iter(self._encode_plain([p for p in plain if p is not None]))
        return [
            next(done) if p is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, p in zip(texts, plain, strict=True)
        ]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


# ---- packing one block


@lru_cache
def combinations(bins: int, parts: int) -> np.ndarray:
    """One column per way to fill ``bins`` units with at most ``parts`` bins: how many of each bin (row i is bin i + 1)."""
    ways: list[list[int]] = []

    def extend(chosen: list[int], left: int) -> None:
        if left == 0:
            ways.append(chosen)
        elif len(chosen) < parts:
            for b in range(min(left, chosen[-1] if chosen else bins), 0, -1):
                extend([*chosen, b], left - b)

    extend([], bins)
    matrix = np.zeros((bins, len(ways)))
    for k, way in enumerate(ways):
        for b in way:
            matrix[b - 1, k] += 1
    return matrix


def nonnegative_least_squares(a: np.ndarray, h: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that brings a x near h, by accelerated projected gradients."""
    g, c = a.T @ a, a.T @ h
    rate = 1 / np.linalg.norm(g, 2)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * (g @ y - c))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def pack(lengths: list[int], window: int = WINDOW, bins: int = BINS, parts: int = PARTS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). All but the last few are full; those have a power of two of tokens."""
    width = window // bins
    out: list[list[tuple[int, int, int]]] = []
    stacks: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    for d, n in enumerate(lengths):
        whole = n - n % window
        out.extend([(d, s, window)] for s in range(0, whole, window))
        if n > whole:
            stacks[(n - whole - 1) // width].append((d, whole, n - whole))
    ways = combinations(bins, parts)
    repeats = nonnegative_least_squares(ways, np.array([len(s) for s in stacks], float))
    gaps: list[tuple[int, list[tuple[int, int, int]]]] = []
    for k in np.argsort(-repeats, kind="stable"):
        need = [(b, int(m)) for b, m in enumerate(ways[:, k]) if m]
        times = min(int(repeats[k] + 0.5), *(len(stacks[b]) // m for b, m in need))
        for _ in range(times):
            row = [stacks[b].pop() for b, m in need for _ in range(m)]
            gaps.append((window - sum(p[2] for p in row), row))
    rest = _Rest([p for s in stacks for p in s])
    gaps.sort(key=lambda g: g[0], reverse=True)
    while gaps:
        gap, row = gaps.pop()
        while gap:
            if not rest.pieces:
                if not gaps:
                    break
                rest.give(gaps.pop(0)[1])
            piece = rest.take(gap)
            row.append(piece)
            gap -= piece[2]
        out.append(row) if not gap else rest.give(row)
        if gap:
            break
    while rest.pieces and sum(rest.sizes) >= window:
        row, gap = [], window
        while gap:
            piece = rest.take(gap)
            row.append(piece)
            gap -= piece[2]
        out.append(row)
    left = sum(rest.sizes)
    for power in range(window.bit_length(), -1, -1):
        if left >> power & 1:
            row, gap = [], 1 << power
            while gap:
                piece = rest.take(gap)
                row.append(piece)
                gap -= piece[2]
            out.append(row)
    return out


class _Rest:
    """Pieces that are not placed yet, by length."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.pieces = sorted(pieces, key=lambda p: p[2])
        self.sizes = [p[2] for p in self.pieces]

    def give(self, row: list[tuple[int, int, int]]) -> None:
        for p in row:
            at = bisect.bisect_left(self.sizes, p[2])
            self.sizes.insert(at, p[2])
            self.pieces.insert(at, p)

    def take(self, gap: int) -> tuple[int, int, int]:
        """The longest piece that fits; where none does, the start of the longest one, whose rest stays."""
        at = bisect.bisect_right(self.sizes, gap) - 1
        self.sizes.pop(at)
        d, s, n = self.pieces.pop(at)
        if n > gap:
            self.give([(d, s + gap, n - gap)])
            n = gap
        return d, s, n


# ---- the operator


def _packer(config: str, end_id: int, window: int, block_tokens: int):
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def laid_out(ids: list[int | None], codes: list[bytes], first: int) -> Iterator[tuple]:
        for n, sequence in enumerate(pack([len(c) // 4 for c in codes], window)):
            offset = 0
            for d, start, length in sequence:
                yield ids[d], start, length, codes[d][4 * start : 4 * (start + length)], len(codes[d]) // 4, first + n, offset
                offset += length

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
        some, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), Texts(batch.column(1)), strict=True):
                some.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= TOGETHER:
                    yield some, texts
                    some, texts, size = [], [], 0
        yield some, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(config)
        following = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        codes: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal following, held
            rows, size = [], 0
            for row in laid_out(ids, codes, following):
                following = max(following, row[5])
                rows.append(row)
                size += 4 * row[2] + 100
                if size > 8 * 1024 * 1024:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)
            following += 1
            ids.clear()
            codes.clear()
            held = 0

        for some, texts in together(batches):
            for doc_id, code in zip(some, encoder.encode_all(texts), strict=True):
                ids.append(doc_id)
                codes.append(code + end)
                held += len(codes[-1]) // 4
                if held >= block_tokens:
                    yield from flush()
        yield from flush()

    return run


def tokenizer_config(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Input: doc_id, text; other columns are ignored. ``tokenizer`` is the path of a word-level BPE file, read on the driver.
    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers. Each document's ids, ``end_id`` last, are in exactly one
    piece each; a null or empty text is ``end_id`` alone. A sequence has ``window`` tokens, but for the last of a block, which are cut to
    powers of two, so nothing is padded. Repeated rows, and rows without doc_id, are documents of their own; which of them
    a piece is from shows in nothing but its ids. An empty table gives no sequence.

    A task holds one block of ``block_tokens`` tokens (4 bytes each) or one longer document, and ``TOGETHER`` characters of texts or one longer
    text that it encodes; block borders fall between documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_packer(tokenizer_config(tokenizer), end_id, window, block_tokens), PIECES)
