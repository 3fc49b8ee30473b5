"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (hash and displace: each bucket of keys gets the first
displacement that sends its keys to free slots of a table with exactly one slot a key). It resolves all new distinct
pre-tokens of a block at once; the stored 64-bit fingerprint and the bytes confirm a hit. Tier two merges the rest:
the bytes form a linked list and a heap holds the ranks of adjacent pairs. Pre-tokens of like length are merged in step:
a row of a matrix is the heap of one of them, a complete tree of minima with a leaf for each byte, and each step merges
the pair at the top of every row. Long ones, and the last few of a matrix, have a heap each; there stale entries are
recognised by the lengths of the parts they were made for.

Ids of pre-tokens are remembered in two generations, so that frequent ones stay when rare ones go. Texts of ids and
decoded bytes are gathered from the ids of whole documents.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from roadloom.llm.arrowtext import Block, map_blocks, mix, texts

#: Pre-tokens in a generation of the memo.
MEMO = 120_000
#: Bytes of the pre-tokens that are merged in step, by matrix; rows of a matrix; rows that are left to a heap each.
WIDTHS, ROWS, FEW = (8, 16, 32, 64), 4096, 32
#: Ids whose texts are gathered at a time.
GATHER = 1 << 16
_NONE = np.int64(1 << 62)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    if not keys:
        return np.zeros(0, np.uint64)
    size = np.array([len(k) for k in keys])
    block = Block(np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum(size)]), None)
    return block.hashes(block.offs[:-1], block.offs[1:], seed=5)


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: ``slot(fingerprints)`` is in range(len(keys))."""

    def __init__(self, keys: list[bytes], load: int = 4):
        self.n = len(keys)
        prints = fingerprints(keys)
        if len(np.unique(prints)) != self.n:
            raise ValueError("keys must be distinct")
        self.buckets = max(1, self.n // load)
        self.shift = np.zeros(self.buckets, np.uint64)
        bucket = (prints % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(self.n, bool)
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            own = prints[order[bounds[b] : bounds[b + 1]]]
            if not len(own):
                break
            d = 0
            while True:
                tries = np.arange(d, d + 64, dtype=np.uint64)
                slots = self._slots(own[None, :], tries[:, None])
                good = ~taken[slots].any(1)
                if len(own) > 1:
                    ordered = np.sort(slots, 1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if good.any():
                    at = int(good.argmax())
                    self.shift[b], taken[slots[at]] = tries[at], True
                    break
                d += 64
        self.check = np.zeros(self.n, np.uint64)
        self.where = np.zeros(self.n, np.int64)  # slot: position of its key
        at = self.slot(prints)
        self.check[at], self.where[at] = prints, np.arange(self.n)

    def _slots(self, prints: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(prints + (shift + np.uint64(1)) * _GOLD) % np.uint64(self.n)).astype(np.int64)

    def slot(self, prints: np.ndarray) -> np.ndarray:
        return self._slots(prints, self.shift[(prints % np.uint64(self.buckets)).astype(np.int64)])

    def find(self, prints: np.ndarray) -> np.ndarray:
        """Positions of keys with these fingerprints, -1 where there is none."""
        at = self.slot(prints)
        return np.where(self.check[at] == prints, self.where[at], -1)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of flat from each start on, end to end."""
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)]


class Strings:
    """Byte strings end to end, by number."""

    def __init__(self, rows: list[bytes]):
        self.data, self.size = np.frombuffer(b"".join(rows), np.uint8), np.array(list(map(len, rows)), np.int64)
        self.start = np.cumsum(self.size) - self.size

    def rows(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of all ids end to end, and where the rows ids[ptr[i]:ptr[i + 1]] begin and end there."""
        size = self.size[ids]
        found = [gather(self.data, self.start[ids[k : k + GATHER]], size[k : k + GATHER]) for k in range(0, len(ids), GATHER)]
        return np.concatenate([self.data[:0], *found]), np.concatenate([[0], np.cumsum(size)])[ptr]


class Known(dict):
    """Numbers of pre-tokens, in the order in which they are asked for first; ``ids[ptr[i]:ptr[i + 1]]`` are those of number i."""

    def __init__(self):
        self.fresh: list[str] = []  # numbered, but without ids yet
        self.ids, self.ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.ids, self.ptr, self.fresh = np.concatenate([self.ids, ids]), np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(size)]), []


class Codec:
    """Encoder and decoder for a rank file of tiktoken's format."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.tokens = [t for t, _ in pairs]
        self.ids = np.array([i for _, i in pairs], np.int32)
        self.rank = dict(pairs)
        bytes_of = {i: t for t, i in pairs}
        every = range(int(self.ids.max(initial=-1)) + 1)
        self.bytes_of, self.text_of = Strings([bytes_of.get(i, b"") for i in every]), Strings([b"%d," % i for i in every])
        self.hash = PerfectHash(self.tokens)
        self.find = regex.compile(pattern).findall
        self.young, self.old = Known(), Known()
        single = [self.rank.get(bytes([b]), -1) for b in range(256)]
        self.single, self.bytewise = np.array(single, np.int64), min(single) >= 0
        halves = sorted((a << 32 | b, r) for t, r in pairs for k in range(1, len(t)) if (a := self.rank.get(t[:k])) is not None and (b := self.rank.get(t[k:])) is not None)
        self.halves, self.made = np.array([h for h, _ in halves] + [_NONE], np.int64), np.array([r for _, r in halves] + [-1], np.int64)
        self.double = self.joined(self.single[:, None], self.single[None, :])

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that two tokens make, -1 where they make none or one of them is -1."""
        pair = a << 32 | b
        at = np.searchsorted(self.halves, pair)
        return np.where(self.halves[at] == pair, self.made[at], -1)

    def merge(self, data: bytes) -> list[int]:
        """Ranks of a byte string that is no token itself: heap over linked bytes, leftmost of equal ranks first."""
        n = len(data)
        size = [1] * n  # 0: swallowed by the part before
        before = list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            r = rank.get(data[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, span = heapq.heappop(heap)
            j = i + size[i]
            if not size[i] or j >= n or size[i] + size[j] != span:
                continue
            size[i], size[j] = span, 0
            k = i + span
            if k < n:
                before[k] = i
                r = rank.get(data[i : k + size[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, span + size[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(data[h:k])
                if r is not None:
                    heapq.heappush(heap, (r, h, k - h))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : i + size[i]]])
            i += size[i]
        return out

    def merge_all(self, raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of byte strings of at most width bytes, a power of two, in step: their ids end to end, and how many each has.

        Entries of the heaps are rank * width + position, so that of equal ranks the leftmost is on top."""
        m, size = len(raw), np.array(list(map(len, raw)))
        text = np.frombuffer(b"".join([d.ljust(width, b"\0") for d in raw]), np.uint8).reshape(m, width)
        place = np.arange(width + 1)
        token = np.full((m, width + 1), -1, np.int64)  # -1: swallowed by the part before, or beyond the end
        token[:, :-1] = np.where(place[:-1] < size[:, None], self.single[text], -1)
        end, before = np.tile(place + 1, (m, 1)), np.tile(place - 1, (m, 1))
        heap = np.full((m, 2 * width), _NONE)  # below node i are 2 i and 2 i + 1; the leaves are the last width nodes
        rank = self.double[text[:, :-1], text[:, 1:]]
        heap[:, width:-1] = np.where((rank >= 0) & (place[1:-1] < size[:, None]), rank * width + place[:-2], _NONE)
        level = width // 2
        while level:
            heap[:, level : 2 * level] = heap[:, 2 * level : 4 * level].reshape(m, level, 2).min(2)
            level //= 2
        going = np.arange(m)
        while True:
            going = going[heap[going, 1] < _NONE]
            if len(going) < FEW:
                break
            rank, i = np.divmod(heap[going, 1], width)
            j = end[going, i]
            k, h = end[going, j], before[going, i]  # the parts beside; k may be the end, h -1: both hold token -1
            token[going, i], token[going, j] = rank, -1
            end[going, i], before[going, k] = k, i
            right, left = np.split(self.joined(np.concatenate([rank, token[going, h]]), np.concatenate([token[going, k], rank])), 2)
            leaf = np.concatenate([i, np.where(h < 0, j, h), j])
            row = np.tile(going * 2 * width, 3)
            entry = np.concatenate([right, left, np.full(len(j), -1)])
            flat, leaf = heap.reshape(-1), leaf + width
            flat[row + leaf] = np.where(entry < 0, _NONE, entry * width + leaf - width)
            while leaf[0] > 1:
                child, leaf = row + (leaf & ~1), leaf >> 1
                flat[row + leaf] = np.minimum(flat[child], flat[child + 1])
        for row in going.tolist():
            ids = self.merge(raw[row])
            token[row] = [*ids, *[-1] * (width + 1 - len(ids))]
        return token[token >= 0].astype(np.int32), (token >= 0).sum(1)

    def resolve(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens end to end, and how many each has."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        length, size = np.array(list(map(len, raw)), np.int64), np.ones(len(raw), np.int64)
        hits = self.hash.find(fingerprints(raw))
        hits[[i for i in np.flatnonzero(hits >= 0).tolist() if self.tokens[hits[i]] != raw[i]]] = -1
        start, found, at = np.where(hits >= 0, np.cumsum(hits >= 0) - 1, 0), [self.ids[hits[hits >= 0]]], int((hits >= 0).sum())
        for below, width in zip((-1, *WIDTHS), (*WIDTHS, None), strict=True):
            which = np.flatnonzero((hits < 0) & (length > below) & (length <= width if width else True))
            step = ROWS if width and self.bytewise else 1
            for some in np.split(which, range(step, len(which), step)) if len(which) else ():
                if step > 1 and len(some) >= FEW:
                    ids, n = self.merge_all([raw[i] for i in some.tolist()], width)
                else:
                    alone = [self.merge(raw[i]) for i in some.tolist()]
                    ids, n = np.array([*chain.from_iterable(alone)], np.int32), np.array([*map(len, alone)], np.int64)
                size[some], start[some] = n, at + np.cumsum(n) - n
                found.append(ids)
                at += len(ids)
        return gather(np.concatenate(found), start, size), size

    def learn(self) -> None:
        """Gives ids to the fresh pre-tokens of the young generation; the old one's are taken over."""
        fresh, young, old = self.young.fresh, self.young, self.old
        at = np.array([old.get(p, -1) for p in fresh], np.int64)
        ids, size = self.resolve([p for p, k in zip(fresh, at.tolist(), strict=True) if k < 0])
        sizes, start = old.ptr[at + 1] - old.ptr[at], old.ptr[at]
        sizes[at < 0], start[at < 0] = size, len(old.ids) + np.cumsum(size) - size
        young.add(gather(np.concatenate([old.ids, ids]), start, sizes), sizes)

    def encode_all(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the bounds of each text's."""
        cut = [self.find(t) for t in found]
        if len(self.young) > MEMO:
            self.old, self.young = self.young, Known()
        at = np.fromiter(map(self.young.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if self.young.fresh:
            self.learn()
        ptr = self.young.ptr
        size = ptr[at + 1] - ptr[at]
        ids = np.concatenate([self.young.ids[:0], *(gather(self.young.ids, ptr[at[k : k + GATHER]], size[k : k + GATHER]) for k in range(0, len(at), GATHER))])
        return ids, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(list(map(len, cut)), dtype=np.int64)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.bytes_of.rows(np.array(ids, np.int32), np.array([0, len(ids)]))[0].tobytes()


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids themselves.

    A null text counts as empty (0 tokens, hashes of the empty string). Repeated rows and null ids keep a row each;
    an empty table gives no rows. Narrow: one pass, no shuffle.
    """

    def rows(block: Block, c: Codec):
        ids, ptr = c.encode_all(texts(block))
        sha = lambda data, at, last: [hashlib.sha256(data[a : max(a, b - last)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        out = {"doc_id": block.column("doc_id"), "n_tokens": pa.array(np.diff(ptr), pa.int64()), "ids_sha256": sha(*c.text_of.rows(ids, ptr), 1), "decoded_sha256": sha(*c.bytes_of.rows(ids, ptr), 0)}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(ptr.astype(np.int32), ids)
        return out

    named = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_blocks(named, ["doc_id", "text"], rows, schema, lambda: codec(path, pattern))
