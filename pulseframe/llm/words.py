"""Words, their hashes and packed arrays over Arrow text columns, vectorised with numpy.

Every function works on one slice of a batch: the UTF-8 bytes of its texts end to end and the
offsets of the texts. A null text is an empty one. Bytes of a multi-byte character are never
white space, so words found on bytes are the words found on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

#: fixed values: tab, line feed, vertical tab, form feed, carriage return, blank
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
#: for matching beyond punctuation: everything in ASCII but letters and digits separates
_IS_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


#: a random 64-bit number for every byte, so that the sums below mix well
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_WINDOW = 0x2545F4914F6CDD1D


#: powers are made from two small tables, which stay in the cache: of the low bits of an exponent
#: and of the rest
_LOW = 14


@lru_cache(maxsize=16)
def _powers(base: int, step: int, size: int) -> np.ndarray:
    """Powers of ``base ** step`` modulo 2**64."""
    p = np.full(size, pow(base, step, 1 << 64), U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, of: np.ndarray | None = None) -> np.ndarray:
    """Rabin-Karp: the polynomial hash of ``values[start:end]`` for all ranges at once, from one
    running sum; dividing by the power of the start makes it independent of the place. With
    ``of`` the values are places in that table."""
    many = 1 << max(4, (len(values) >> _LOW).bit_length())
    low, high = _powers(base, 1, 1 << _LOW), _powers(base, 1 << _LOW, many)
    total = np.zeros(len(values) + 1, U)
    for i, at in enumerate(range(0, len(values), 1 << _LOW)):
        part = values[at : at + (1 << _LOW)] if of is None else of[values[at : at + (1 << _LOW)]]
        np.multiply(part, low[: len(part)] * high[i], out=total[at + 1 : at + 1 + len(part)])
    np.cumsum(total, out=total)
    inverse = pow(base, -1, 1 << 64)
    low, high = _powers(inverse, 1, 1 << _LOW), _powers(inverse, 1 << _LOW, many)
    out = total[end]
    out -= total[start]
    out *= low[start & ((1 << _LOW) - 1)]
    out *= high[start >> _LOW]
    return out


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each take about ``size`` bytes; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.array(pc.binary_length(batch.column("text")).fill_null(0), np.int64)
        cut = np.cumsum(length) // size
        first = np.flatnonzero(np.diff(cut, prepend=-1))
        for a, b in zip(first, [*first[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more at the end)."""
    column = column.fill_null("") if column.null_count else column
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else unchanged."""
    return _LOWER[raw]


class Words:
    """Words of all texts of a slice: ``start`` and ``end`` on the bytes, ``hash``, and ``first``,
    the number of the first word of each text (one more at the end). ``breaks`` tells for each
    byte whether it separates, in place of the two usual choices."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, loose: bool = False, hashed: bool = True, breaks: np.ndarray | None = None):
        self.raw, self.offsets = raw, offsets
        gap = (breaks if breaks is not None else _IS_BREAK if loose else _IS_SPACE)[raw]
        opens, closes = ~gap, ~gap
        before = np.ones(len(raw), bool)
        after = np.ones(len(raw), bool)
        if len(raw):
            before[1:] = gap[:-1]
            after[:-1] = gap[1:]
            inner = offsets[(offsets > 0) & (offsets < len(raw))]
            before[inner] = True
            after[inner - 1] = True
        opens &= before
        closes &= after
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = mix(range_hash(raw, self.start, self.end, _BASE, of=_BYTE)) if hashed else None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of ``width`` consecutive words of one text begins, and its hash."""
    n = np.diff(first)
    begin = np.arange(len(hashes))
    begin = begin[begin + width <= np.repeat(first[1:], n)]
    return begin, mix(range_hash(hashes, begin, begin + width, _WINDOW))


def pack(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, byte planes apart so that they compress well."""
    values = np.asarray(values, U)
    step = np.diff(values, prepend=U(0))
    return narrow(step)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(widen(data), dtype=U)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers with no more bytes each than the largest needs."""
    values = np.asarray(values, U)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def widen(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(U).ravel()
