"""Words and shingles of whole Arrow batches as numpy arrays of 64-bit hashes."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_HASH = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_HASH = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)

# Words are [a-z0-9] and everything beyond ASCII, with A-Z lower-cased; other bytes map to 0.
WORD_BYTE = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    WORD_BYTE[_b] = _b
for _b in range(0x41, 0x5B):
    WORD_BYTE[_b] = _b + 32


# Words of anything but spaces: every byte that isn't one keeps a value of its own, 0 that of the blank.
SPACED_BYTE = np.arange(256, dtype=np.uint8)
SPACED_BYTE[0x41:0x5B] += 32
SPACED_BYTE[0] = 0x20
SPACED_BYTE[[0x20, *range(0x09, 0x0E)]] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words(NamedTuple):
    hash: np.ndarray    # uint64, a value per word
    row: np.ndarray     # row of the batch that the word stands in
    counts: np.ndarray  # words per row
    start: np.ndarray   # first byte of the word in `data`
    size: np.ndarray    # bytes of the word
    data: np.ndarray    # UTF-8 bytes of all rows, one after the other
    rows: np.ndarray    # first byte of each row, and the end of the last


def slices(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[pa.Array]:
    """The batch in runs of rows of about ``most_bytes`` bytes, so that work arrays stay small; a longer text is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and the offsets of its rows."""
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[rows[0]:rows[-1]], rows - rows[0]


def split_words(texts: pa.Array, word_byte: np.ndarray = WORD_BYTE) -> Words:
    """Words of a run of rows; ``word_byte`` says what bytes they are made of. A row without a word has count 0."""
    data, rows = raw(texts)
    low = word_byte[data]
    at = np.flatnonzero(low)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, np.zeros(len(texts), np.int64), none, none, data, rows)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    row_starts = rows[:-1][rows[:-1] < rows[1:]]
    begins = np.searchsorted(at, row_starts)  # a word never reaches over the end of a row
    first[begins[begins < len(at)]] = True
    heads = np.flatnonzero(first)
    size = np.diff(np.append(heads, len(at)))
    within = np.arange(len(at)) - np.repeat(heads, size)
    powers = np.cumprod(np.full(int(size.max()), STEP, np.uint64))
    hashed = mix(np.add.reduceat(BYTE_HASH[low[at]] * powers[within], heads) + size.astype(np.uint64))
    start = at[heads]
    row = np.searchsorted(rows, start, "right") - 1
    return Words(hashed, row, np.bincount(row, minlength=len(texts)), start, size, data, rows)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and their rows; a row of fewer words, but not none, is one shingle."""
    n = len(words.hash)
    if not n:
        return words.hash, words.row
    ends = np.cumsum(words.counts)
    first = np.repeat(ends - words.counts, words.counts)
    left = ends[words.row] - np.arange(n)
    out = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        part = words.hash[j:] * SHINGLE_HASH[j]
        part[left[:n - j] <= j] = 0
        out[:n - j] += part
    keep = (left >= width) | ((np.arange(n) == first) & (words.counts[words.row] < width))
    return mix(out[keep]), words.row[keep]
