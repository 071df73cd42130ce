"""Vectorised text kernels shared by the operators that run in Arrow batches.

All kernels work on the UTF-8 buffer of a whole batch of texts at once: words
are found with byte masks, and hashed with polynomial prefix sums modulo 2**64,
so that no Python code runs for each word.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_Q = np.uint64(0xD1B54A32D192ED03)


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Letters and digits of ASCII and every byte of a longer character.
ALNUM = _byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but ASCII white space.
NON_SPACE = ~_byte_class((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Texts:
    """Some consecutive texts of a batch: their bytes, and where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a string column in chunks of bounded size; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def spans(texts: Texts, kind: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of a class; runs end at the end of a text, and before positions in cut."""
    inside = kind[texts.data]
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[texts.offsets] = True
    if cut is not None:
        first[:-1] |= cut
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("p", _P, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("inv", _P_INV, n + 1)[starts])


def words_of_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the index of its first word; and the number of words at the end."""
    return np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive hashes, also across texts: callers mask those."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        out *= _Q
        out += hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


def lower_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, and the first word of each text."""
    starts, ends = spans(texts, ALNUM)
    return LOWER[texts.data], starts, ends, words_of_text(starts, texts.offsets)


def shingles(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of word shingles of each text: sorted distinct hashes text by text, and where each text's begin.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    data, starts, ends, first = lower_words(texts)
    words = span_hashes(data, starts, ends)
    n_words = np.diff(first)
    whole = grams(words, width)
    owner = np.repeat(np.arange(len(texts)), n_words)
    ok = np.zeros(0, bool)
    if len(whole):
        ok = owner[: len(whole)] == owner[width - 1 :]
    values, owners = whole[ok], owner[: len(whole)][ok]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        extra = np.array([_short(words[first[i] : first[i + 1]]) for i in short], np.uint64)
        values, owners = np.concatenate([values, extra]), np.concatenate([owners, short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
        values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(texts) + 1))


def _short(words: np.ndarray) -> int:
    return int(grams(words, len(words))[0]) ^ len(words)
