"""Whole Arrow text columns as numpy arrays: words, lines and hashes of any byte span, without Python strings.

Words are runs of bytes other than space and \\x09-\\x0D. Hashes are 64-bit polynomials modulo 2**64 that are then
mixed; equal spans always hash alike.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# letters and digits; bytes of characters beyond ASCII count as letters
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 19  # bytes of text that are handled at a time
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 ... base**n modulo 2**64, kept for later calls."""
    have = _powers.get(str(base))
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(steps)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """The bytes of some rows one after another; row r has data[starts[r]:starts[r + 1]]."""

    data: np.ndarray
    starts: np.ndarray
    first: int  # number of the first row within its batch

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def prefix(self) -> np.ndarray:
        """Running polynomial sums, for span_hash."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(len(self.data))[:-1], out=out[1:])
        return out

    def totals(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte for each row."""
        sums = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and its row."""
        return self.spans(~SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each part between line feeds (empty parts left out), and its row."""
        return self.spans(self.data != 0x0A)

    def spans(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of solid bytes within a row: start, end, row."""
        n = len(solid)
        cut = np.zeros(n + 1, bool)
        cut[self.starts] = True
        before = np.concatenate([[False], solid[:-1]]) if n else solid
        begin = np.flatnonzero(solid & (~before | cut[:-1]))
        after = np.concatenate([solid[1:], [False]]) if n else solid
        end = np.flatnonzero(solid & (~after | cut[1:])) + 1
        return begin, end, np.searchsorted(self.starts, begin, "right") - 1


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; the same bytes hash alike wherever they stand."""
    raw = (prefix[end] - prefix[begin]) * powers(len(prefix), INVERSE)[begin]
    return mix(raw ^ ((end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k words in a row that belong to one text, and the place of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BASE + words[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(out[at]), at


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Texts]:
    """The column's rows, in order, in blocks of at most limit bytes or one row. A null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at]).astype(np.int64), at)
        at = to
