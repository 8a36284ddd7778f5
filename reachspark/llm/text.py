"""Words of whole Arrow batches as numpy arrays, and hashes over runs of words.

Everything here works on UTF-8 bytes, a bounded chunk at a time, so that a batch of
short texts and one very long text take the same memory per byte. Hashes are
polynomials modulo 2**64 that are finished with a bit mixer; long words have BLAKE2
instead, as such polynomials can't tell some long, regular texts apart whatever their base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; the power tables have this many entries.
PIECE = 1 << 18
#: Bytes of a word from which on its hash is BLAKE2: a Thue-Morse text and its complement agree in 26 bits of a polynomial at 64 bytes, in all at 1024.
LONG = 64
#: A chunk of documents ends when it holds this many bytes.
CHUNK = 1 << 20

_U = np.uint64


def _table(separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and what each byte becomes."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    becomes = np.arange(256, dtype=np.uint8)
    if fold:
        becomes[65:91] += 32
    return inside, becomes


#: Words between ASCII white space, as they are: ``[^\x20\x09-\x0D]+``.
SPACED = _table(bytes([0x20, *range(0x09, 0x0E)]), fold=False)
#: The same with A-Z made lower-case first.
SPACED_FOLDED = _table(bytes([0x20, *range(0x09, 0x0E)]), fold=True)
#: ASCII letters, digits and everything beyond ASCII, A-Z made lower-case first:
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_FOLDED = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which each bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Rolling:
    """Hash of any slice of a sequence in two multiplications, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        with np.errstate(over="ignore"):
            sums = np.zeros(n, dtype=np.uint64)
            np.cumsum(values * self.up[: n - 1], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


_bytes_hash = _Rolling(0x7C3D9A6F1B5E8A2D)
_gram_hash = _Rolling(0xD1B54A32D192ED03)
_second_hash = _Rolling(0xA24BAED4963EE407)


@dataclass
class Words:
    """Words of some documents: byte ranges in ``buf`` and, by document, word ranges."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of document i the words first[i] .. first[i + 1]
    rows: range  # which rows of the batch

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self._hashes(self.starts, self.ends)

    def prefix_hashes(self, lengths: tuple[int, ...]) -> list[np.ndarray]:
        """Hashes of each word's first so many bytes."""
        return [self._hashes(self.starts, np.minimum(self.starts + n, self.ends)) for n in lengths]

    def suffix_hashes(self, n: int) -> np.ndarray:
        """Hashes of each word's last n bytes."""
        return self._hashes(np.maximum(self.ends - n, self.starts), self.ends)

    def _hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
            out[at:to] = _bytes_hash(self.buf[low : ends[to - 1]].astype(np.uint64), starts[at:to] - low, ends[at:to] - low)
            at = to
        for i in np.flatnonzero(ends - starts >= LONG):
            out[i] = int.from_bytes(hashlib.blake2b(self.buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        n = np.diff(self.first)
        return np.repeat(self.first[1:], n) - np.arange(self.first[-1])

    def doc(self) -> np.ndarray:
        """The document, counted within this chunk, of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, a: int, b: int) -> bytes:
        """Words a .. b joined by one space."""
        return b" ".join([self.buf[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True)])


def grams(hashes: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of each n consecutive values; those across documents are the caller's to drop."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    step = PIECE
    out = []
    for at in range(0, len(hashes) - n + 1, step):
        part = hashes[at : at + step + n - 1]
        i = np.arange(len(part) - n + 1)
        out.append((_second_hash if second else _gram_hash)(part, i, i + n))
    return np.concatenate(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values."""
    if len(x) < n:
        return x[:0]
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def chunks(column: pa.Array, table: tuple[np.ndarray, np.ndarray]) -> Iterator[Words]:
    """Words of a string column, some documents at a time."""
    data, offsets = _strings(column)
    inside, becomes = table
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        buf = data[offsets[i] : offsets[j]]
        cuts = offsets[i : j + 1] - offsets[i]
        word = inside[buf]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        seams = cuts[1:-1]
        seams = seams[(seams > 0) & (seams < len(buf))]
        opens[seams] = word[seams]
        closes[seams - 1] = word[seams - 1]
        starts = np.flatnonzero(opens)
        yield Words(becomes[buf], starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, cuts), range(i, j))
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as a Spark long."""
    return x.view(np.int64)
