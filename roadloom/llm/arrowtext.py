"""Vectorised text primitives over Arrow string columns.

Operators receive Arrow batches (``mapInArrow``), cut them into blocks of at most ``BLOCK`` bytes (one document at
least) and work on the UTF-8 buffers with numpy: word bounds, 64-bit word hashes, hashes of word windows. Memory
follows the block, never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from roadloom.session import ship

BLOCK = 1 << 20
#: Documents in a block at most.
BLOCK_DOCS = 512
#: Bytes that are hashed at a time; the tables of powers are this long, for each seed and worker.
PIECE = 1 << 16
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """R**i and R**-i modulo 2**64, up to i = PIECE."""

    def __init__(self, base: int):
        self.base = base | 1
        with np.errstate(over="ignore"):
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, r, np.uint64)])) for r in (self.base, pow(self.base, -1, 1 << 64)))


_TABLES: dict[int, tuple[np.ndarray, _Powers]] = {}


def _table(seed: int) -> tuple[np.ndarray, _Powers]:
    if seed not in _TABLES:
        with np.errstate(over="ignore"):
            _TABLES[seed] = mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed * 7919)), _Powers(0xD1342543DE82EF95 + 2 * seed)
    return _TABLES[seed]


@dataclass
class Words:
    """Words of a block: byte bounds, and for document d the words ptr[d]:ptr[d + 1]."""

    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def window_ok(self, k: int) -> np.ndarray:
        """Whether the k words from each word on belong to its document; one flag for each of the len - k + 1 windows."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        return np.arange(n) + k <= np.repeat(self.ptr[1:], np.diff(self.ptr))[:n]


class Block:
    """Documents whose UTF-8 bytes are ``data[offs[i]:offs[i + 1]]``; null texts are empty."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, batch: pa.RecordBatch):
        self.data, self.offs, self.batch = data, offs, batch

    def __len__(self) -> int:
        return len(self.offs) - 1

    def lowered(self) -> Block:
        """The block in lower case, for the letters of ASCII and Latin-1 (whose UTF-8 lengths don't change)."""
        data = _LOWER[self.data]
        wide = np.flatnonzero(data[:-1] == 0xC3) + 1
        wide = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
        data[wide] += 32
        return Block(data, self.offs, self.batch)

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def sizes(self) -> np.ndarray:
        return np.diff(self.offs)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte, by document."""
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[self.offs])

    def words(self) -> Words:
        n = len(self.data)
        if not n:
            return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64))
        word = ~_SEP[self.data]
        edge = np.zeros(n + 1, bool)  # a document starts here
        edge[self.offs] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return Words(start, end, np.searchsorted(start, self.offs))

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the byte ranges (ascending, disjoint), in pieces of at most PIECE bytes. They depend on the
        bytes of a range only, so longer ranges are summed over their pieces."""
        table, powers = _table(seed)
        out = np.empty(len(start), np.uint64)
        value = lambda piece: table[_LOWER[piece] if lower else piece] * powers.up[: len(piece)]
        at = 0
        with np.errstate(over="ignore"):
            while at < len(start):
                base, size = start[at], end[at] - start[at]
                if size > PIECE:
                    sums = (int(value(self.data[base + k : min(base + k + PIECE, end[at])]).sum()) * pow(powers.base, k, 1 << 64) for k in range(0, int(size), PIECE))
                    out[at] = mix(np.array([sum(sums) & (1 << 64) - 1], np.uint64) + np.uint64(size) * _ODD)[0]
                    at += 1
                    continue
                to = int(np.searchsorted(end, base + PIECE, "right"))
                piece = self.data[base : end[to - 1]]
                total = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(value(piece), out=total[1:])
                s, e = start[at:to] - base, end[at:to] - base
                out[at:to] = mix((total[e] - total[s]) * powers.down[s] + (e - s).astype(np.uint64) * _ODD)
                at = to
        return out


def windows(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; runs that cross documents are the caller's to drop."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = word[:n].copy()
        for j in range(1, k):
            out *= _ODD
            out += word[j : j + n]
        return mix(out)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[Block]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if col.null_count:
            col = col.fill_null("")
        col = col.cast(pa.large_string())
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            to = min(to, at + BLOCK_DOCS)
            yield Block(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], batch.slice(at, to - at))
            at = to


def texts(block: Block) -> list[str]:
    raw = block.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(block.offs[:-1], block.offs[1:], strict=True)]


def trimming(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow which gives the worker's free memory back to the system after its task: workers outlive
    their tasks, and what the allocators keep counts against the executor."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return trimmed


def map_blocks(df: DataFrame, columns: list[str], fn: Callable[[Block], pa.RecordBatch | dict | None], schema: str | StructType, setup: Callable[[], object] | None = None, text: str = "text") -> DataFrame:
    """Applies fn to the blocks of the named columns; setup() runs once a task and is passed to fn."""
    ship(df.sparkSession)

    def run(batches):
        state = setup() if setup else None
        for block in blocks(batches, text):
            out = fn(block, state) if setup else fn(block)
            if out is not None:
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.select(*columns).mapInArrow(trimming(run), schema)
