"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Texts are handled as UTF-8 bytes in blocks of bounded size.  A block is one
``bytes`` object in which every text is followed by one separator byte, so a
word never crosses two texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import xxhash

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 2 << 20

#: Words longer than this are hashed one at a time.
LONG_WORD = 256

#: Separators of ``[^\x20\x09-\x0D]+``.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

_UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def separator_table(separators: bytes) -> np.ndarray:
    """A look-up table by byte: True for a separator."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = True
    return table


BLANK_TABLE = separator_table(BLANKS)

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and all bytes from 0x80.
ALNUM_TABLE = separator_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string or binary column as bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def blocks(texts: Sequence[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; never an empty range."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        if k > begin and held + len(text) > limit:
            yield begin, k
            begin, held = k, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def small_batches(batches: Iterable, limit: int = BLOCK_BYTES) -> Iterator:
    """Arrow batches cut so that each holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


class Words:
    """The words of a block of texts.

    ``start``/``end``: byte spans in ``data``; ``first[i]:first[i+1]``: the
    words of text i.
    """

    def __init__(self, texts: Sequence[bytes], separators: np.ndarray = BLANK_TABLE, lower: bool = False):
        data = b" ".join(texts) + b" "
        if lower:
            data = data.translate(LOWER)
        self.data = data
        raw = np.frombuffer(data, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        blank = separators[raw]
        blank[self.text_start[1:] - 1] = True
        word = np.concatenate([[False], ~blank])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.start, self.end)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit hash for an ordered pair of hashes."""
    return mix(left * _M1 + (right ^ (left >> _S32)))


def span_hash(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = data + bytes(8)
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    out = mix(length.astype(np.uint64) * _M1)
    long = np.flatnonzero(length > LONG_WORD)
    at, size = start, length
    live = None
    for k in range(0, LONG_WORD, 8):
        if live is None:
            lane = lanes[at]
        else:
            lane = lanes[at[live] + k]
            size = length[live] - k
        cut = np.minimum(size, 8).astype(np.uint64)
        lane = np.where(cut == 8, lane, lane & ((np.uint64(1) << (cut * np.uint64(8))) - np.uint64(1)))
        if live is None:
            out = mix((out ^ lane) * _M1)
            live = np.flatnonzero((length > 8) & (length <= LONG_WORD))
        else:
            out[live] = mix((out[live] ^ lane) * _M1)
            live = live[length[live] > k + 8]
        if not len(live):
            break
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], 7)
    return out


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` consecutive values (len - size + 1 of them)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = values[:n].copy()
    for k in range(1, size):
        out = combine(out, values[k : n + k])
    return out
