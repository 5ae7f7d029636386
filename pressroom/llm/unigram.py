"""SentencePiece unigram encoding: Viterbi over a double-array trie of pieces with log scores, byte fallback, and decoding.

Pieces and their order come from a model file; a model of another kind than unigram has ranks for scores, which are read as Zipf log
probabilities. White space is the marker U+2581. Where the pieces show that none reaches across a place in any text (before a marker, after
a run of Latin letters), the best path breaks there too, so the parts between are encoded once and remembered while they are few.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# markers, then other characters, then Latin letters, each as far as there are any
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
LETTERS = re.compile(f"{MARK}*[^{LATIN}{MARK}]*[{LATIN}]+|{MARK}+[^{LATIN}{MARK}]*|[^{LATIN}{MARK}]+")
AFTER_LETTER = re.compile(f"[{LATIN}][^{LATIN}]")
ENCODED = "doc_id long, ids binary, n_tokens long, n_bytes long, score double, decoded string"


# ---- model files


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


def read_pieces(model: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) by id, and the model type of the file (1: unigram)."""
    pieces, kind = [], 1
    for n, value in _fields(model):
        if n == 1:
            f = dict(_fields(value))
            score = float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0
            pieces.append((f[1].decode(), score, f.get(3, NORMAL)))
        elif n == 2:
            kind = dict(_fields(value)).get(3, 1)
    return pieces, kind


def zipf_scores(pieces: Sequence[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Log probability of rank r as -ln(r H), with H the harmonic number of the count of normal pieces."""
    ranked = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: -pieces[i][1])
    total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)) or 1)
    scores = {i: -math.log(r) - total for r, i in enumerate(ranked, 1)}
    return [(p, scores.get(i, s), t) for i, (p, s, t) in enumerate(pieces)]


# ---- the trie


class DoubleArray:
    """A trie over numbered characters: the child of state s by character c is base[s] + c, if check there is s. value is a key's or -1."""

    def __init__(self, keys: Sequence[Sequence[int]], values: Sequence[int]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in zip(keys, values, strict=True):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = value
        reach = max((max(c) for c in children if c), default=0) + 2
        size = len(children) + 2 * reach + 8192
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        free, wide, todo = 1, 1, [(0, 0)]
        for node, state in todo:
            self.value[state] = ends[node]
            if not children[node]:
                continue
            chars = np.array(sorted(children[node]), np.int64)
            while taken[free]:
                free += 1
            # nodes of many children look from where the last of them was placed; the gaps before are for small ones
            at, step = (free if len(chars) <= 2 else max(free, wide)), 64
            while True:
                while at + step + reach >= len(taken):
                    taken = self._grow(taken)
                bases = np.flatnonzero(~taken[at : at + step]) + at - chars[0]
                bases = bases[bases >= 0]
                fits = ~taken[bases[:, None] + chars].any(1)
                if fits.any():
                    break
                at, step = at + step, min(4096, 4 * step)
            base = int(bases[fits.argmax()])
            if len(chars) > 2:
                wide = base + int(chars[0])
            self.base[state] = base
            taken[base + chars] = True
            self.check[base + chars] = state
            todo.extend((children[node][int(c)], base + int(c)) for c in chars)
        # so that a step from any state by any character stays inside
        self._grow(taken, reach)

    def _grow(self, taken: np.ndarray, more: int = 0) -> np.ndarray:
        more = more or len(taken)
        self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])
        return np.concatenate([taken, np.zeros(more, bool)])


class Unigram:
    """Encodes and decodes by a table of (piece, log score, type)."""

    # of what is remembered: parts of this many characters at most, and about so many bytes of them in all
    KEPT_LENGTH = 64
    KEPT_BYTES = 96_000_000
    # cells of the tables that words of about one length share
    CELLS = 2_000_000

    def __init__(self, pieces: Sequence[tuple[str, float, int]]):
        plain = [i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER) and p[0]]
        self.score = np.array([p[1] for p in pieces], float)
        numbers = {c: n for n, c in enumerate(sorted({c for i in plain for c in pieces[i][0]}), 1)}
        self.number = np.zeros(0x110000, np.int16 if len(numbers) < 1 << 15 else np.int32)
        self.number[[ord(c) for c in numbers]] = list(numbers.values())
        self.trie = DoubleArray([[numbers[c] for c in pieces[i][0]] for i in plain], plain)
        self.longest = max((len(pieces[i][0]) for i in plain), default=1)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        self.is_byte = np.array([p[2] == BYTE for p in pieces])
        self.unknown_score = min((self.score[i] for i in plain), default=0.0) - UNKNOWN_PENALTY
        # a pattern of parts between which no piece reaches, as far as the pieces allow
        if any(MARK in pieces[i][0].lstrip(MARK) for i in plain):
            self.part = re.compile(r"(?s).+")
        elif any(AFTER_LETTER.search(pieces[i][0]) for i in plain):
            self.part = WORD
        else:
            self.part = LETTERS
        self.shown = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNUSED) else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, t in pieces
        ]
        self.coded = [i.to_bytes(4, "little") for i in range(len(pieces))]
        self.held = 0
        self.ids_of: dict[str, bytes] = {}
        self.score_of: dict[str, float] = {}

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        with open(path, "rb") as f:
            pieces, kind = read_pieces(f.read())
        return cls(pieces if kind == 1 else zipf_scores(pieces))

    def viterbi(self, words: Sequence[str]) -> list[tuple[bytes, float]]:
        """Per word its ids as little-endian unsigned 32-bit bytes, and the log score of its best path.

        Of equal scores the path stays whose last piece is longest. A character that is no piece costs the lowest score less a
        penalty and becomes its bytes. Words of about one length go through the trie together, one array step per character.
        """
        out: list = [(b"", 0.0)] * len(words)
        order = sorted((i for i in range(len(words)) if words[i]), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            longest = len(words[order[at]]) + 2
            end = at + 1
            while end < len(order) and len(words[order[end]]) <= longest and (end - at) * longest < self.CELLS:
                end += 1
            for i, found in zip(order[at:end], self._together([words[i] for i in order[at:end]]), strict=True):
                out[i] = found
            at = end
        return out

    def _together(self, words: list[str]) -> list[tuple[bytes, float]]:
        lengths = np.array([len(w) for w in words])
        n, width = len(words), int(lengths.max())
        codes = np.zeros((width, n), np.int32)
        inside = np.arange(width)[:, None] < lengths
        codes.T[inside.T] = self.number[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back, used = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        for s in range(width):
            live = np.flatnonzero(lengths > s)
            so_far = best[s]
            rows, state = live, np.zeros(len(live), np.int32)
            for k in range(min(self.longest, width - s)):
                code = codes[s + k, rows]
                step = base[state] + code
                good = (check[step] == state) & (code > 0)
                rows, state = rows[good], step[good]
                if not len(rows):
                    break
                piece = value[state]
                hit = piece >= 0
                r, p = rows[hit], piece[hit]
                if k == 0 and len(r) < len(live):
                    lost = np.setdiff1d(live, r, assume_unique=True)
                    self._offer(best[s + 1], back[s + 1], used[s + 1], lost, s, so_far[lost] + self.unknown_score, -1)
                if len(r):
                    self._offer(best[s + k + 1], back[s + k + 1], used[s + k + 1], r, s, so_far[r] + score[p], p)
            else:
                continue
            if k == 0:
                self._offer(best[s + 1], back[s + 1], used[s + 1], live, s, so_far[live] + self.unknown_score, -1)
        scores = best[lengths, np.arange(n)].tolist()
        return [(self._path(w, b, u), x) for w, b, u, x in zip(words, back.T.tolist(), used.T.tolist(), scores, strict=True)]

    @staticmethod
    def _offer(best: np.ndarray, back: np.ndarray, used: np.ndarray, rows: np.ndarray, start: int, score: np.ndarray, piece) -> None:
        better = score > best[rows]
        rows = rows[better]
        best[rows], back[rows], used[rows] = score[better], start, piece if np.isscalar(piece) else piece[better]

    def _path(self, word: str, back: list[int], used: list[int]) -> bytes:
        ids: list[int] = []
        at = len(word)
        while at:
            start = back[at]
            if used[at] >= 0:
                ids.append(used[at])
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(word[start:at].encode("utf-8", "replace")))
            else:
                ids.append(self.unknown)
            at = start
        return b"".join([self.coded[i] for i in reversed(ids)])

    def encode(self, texts: Sequence[str]) -> list[tuple[bytes, float]]:
        """Ids and log score of each text. A marker goes before a text that is not empty, and for each blank."""
        cut = [self.part.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        ids_of, score_of = self.ids_of, self.score_of
        if self.held > self.KEPT_BYTES:
            ids_of.clear()
            score_of.clear()
            self.held = 0
        new = list({w for c in cut for w in c if w not in ids_of})
        long = []
        for w, (ids, score) in zip(new, self.viterbi(new), strict=True):
            ids_of[w], score_of[w] = ids, score
            if len(w) > self.KEPT_LENGTH:
                long.append(w)
            else:
                # a string, its ids, a float and two places in dictionaries
                self.held += 4 * len(w) + len(ids) + 330
        found = [(b"".join([ids_of[w] for w in c]), math.fsum([score_of[w] for w in c])) for c in cut]
        for w in long:
            del ids_of[w], score_of[w]
        return found

    def decode(self, ids: bytes) -> str:
        """Byte pieces join to characters, markers become blanks, and the one that encoding put in front goes."""
        shown = self.shown
        text = b"".join([shown[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


# ---- the operator


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit), n_tokens, n_bytes (fallback), score, decoded.

    Input: doc_id, text; other columns are ignored. ``model`` is a SentencePiece model file, read on the driver; its trie goes to the
    tasks with the function, and grows with the vocabulary only. ``decoded`` is made from ``ids`` and equals the text, unless the text holds
    the marker character itself, which reads as a blank. A null or empty text has no ids. Repeated rows come out each.
    """
    unigram = Unigram.from_file(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = unigram.encode(part.column(1).to_pylist())
                numbers = [np.frombuffer(f[0], "<u4") for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([f[0] for f in found], pa.binary()),
                        pa.array([len(n) for n in numbers], pa.int64()),
                        pa.array([int(unigram.is_byte[n].sum()) for n in numbers], pa.int64()),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array([unigram.decode(f[0]) for f in found], pa.string()),
                    ],
                    ["doc_id", "ids", "n_tokens", "n_bytes", "score", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, ENCODED)
