"""Words, word hashes and windows of many texts at once, as NumPy arrays over Arrow buffers.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return.  Those six are single bytes in UTF-8 and never part of a longer character, so
all work is done on bytes.  Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

import ctypes
import inspect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_LANE = _RNG.randint(0, 1 << 62, 64).astype(np.uint64) * np.uint64(4) + np.uint64(3)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        n = max(n + 1, 1 << 16)
        root, inverse = int(_ROOT), pow(int(_ROOT), -1, 1 << 64)
        tables = []
        for base in (root, inverse):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            tables.append(np.multiply.accumulate(step))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 19), "right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        power, inverse = _power_tables(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = upto
    return mix(out)


class Words:
    """The words of some texts.

    starts, ends: byte places in ``data``; hashes: one for each word; first: words of text i
    are first[i]:first[i + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        if lower:
            data = _LOWER[data]
        inside = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1] | cut[1:-1]
            stops[:-1] &= ~inside[1:] | cut[1:-1]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = _hash_words(data, self.starts, self.ends) if hashed else None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return self.first[1:][self.owner()] - np.arange(len(self.starts))

    def windows(self, size: int) -> np.ndarray:
        """Hash of ``size`` words from each word on; past the end of all texts the place is padded.
        Only places with room() >= size are windows of one text."""
        return windows(self.hashes, size)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes)
    total = np.full(n, np.uint64(size), np.uint64)
    for k in range(min(size, n)):
        total[: n - k] += hashes[k:] * _LANE[k % 64] + np.uint64(k)
    return mix(total)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, body = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on and share a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spared(run):
    """A task function that gives memory back when its task, or its group, is done."""

    def over_batches(batches):
        yield from run(batches)
        give_back()

    def over_group(*tables):
        out = run(*tables)
        give_back()
        return out

    def over_two(one, other):
        return over_group(one, other)

    def over_one(table):
        return over_group(table)

    if inspect.isgeneratorfunction(run):
        return over_batches
    return over_two if len(inspect.signature(run).parameters) == 2 else over_one


def slices(batch, text: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch or table into runs of rows with about ``limit`` bytes of text each (one row at least)."""
    tables = [batch] if isinstance(batch, pa.RecordBatch) else batch.to_batches()
    for part in tables:
        if not part.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(part.column(text)), 0).to_numpy(zero_copy_only=False)
        total, at = np.concatenate([[0], np.cumsum(lengths)]), 0
        while at < part.num_rows:
            upto = min(part.num_rows, max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1))
            yield part.slice(at, upto - at)
            at = upto


def texts(data: np.ndarray, offsets: np.ndarray):
    """Each text as bytes."""
    whole = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield whole[a:b]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value: their types and lengths, then their bytes by planes, which
    leaves runs of equal bytes for the compression of shuffle files."""
    head = [np.array([len(arrays)], np.uint32).tobytes()]
    body = []
    for a in arrays:
        head.append(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], np.uint32).tobytes())
        body.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return b"".join(head + body)


def unpack(value: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(value, np.uint32, 1)[0])
    heads, at, out = np.frombuffer(value, np.uint32, 3 * n, 4).reshape(n, 3), 4 + 12 * n, []
    for kind, width, length in heads.tolist():
        planes = np.frombuffer(value, np.uint8, width * length, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(f"{chr(kind)}{width}")))
        at += width * length
    return out


def ranges(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    return starts, np.diff(np.append(starts, len(order)))
