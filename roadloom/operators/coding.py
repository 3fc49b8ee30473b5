"""Huffman codes, bit enumerations and hash tables of small alphabets."""

from __future__ import annotations

import heapq
from functools import cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from roadloom.session import ship


def huffman_lengths(counts: list[int]) -> list[int]:
    """Code length of each symbol; a single symbol gets one bit, none none."""
    if len(counts) == 1:
        return [1]
    heap = [(n, i, (i,)) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    out, fresh = [0] * len(counts), len(counts)
    while len(heap) > 1:
        n, _, a = heapq.heappop(heap)
        m, _, b = heapq.heappop(heap)
        for i in a + b:
            out[i] += 1
        heapq.heappush(heap, (n + m, fresh, a + b))
        fresh += 1
    return out


def huffman(symbols: DataFrame, group: str) -> DataFrame:
    """group, symbol, n, length, code (canonical) for symbols (group, symbol, n); one alphabet a task."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n", "symbol"]).reset_index(drop=True)
        f["length"] = huffman_lengths(f.n.tolist())
        f = f.sort_values(["length", "symbol"]).reset_index(drop=True)
        codes, value, last = [], 0, 0
        for size in f.length.tolist():
            value <<= size - last
            codes.append(format(value, f"0{size}b"))
            value, last = value + 1, size
        return f.assign(code=codes)[[group, "symbol", "n", "length", "code"]]

    ship(symbols.sparkSession)
    return symbols.select(group, "symbol", "n").groupBy(group).applyInPandas(one, f"{group} long, symbol string, n long, length long, code string")


def weighted_word(weight: int, index: int) -> int:
    """The index-th (from 0) 64-bit number with `weight` set bits, ascending, by the combinatorial number system."""
    if not 0 <= index < comb(64, weight):
        raise ValueError("no such number")
    out = 0
    for k in range(weight, 0, -1):
        bit = k - 1
        while comb(bit + 1, k) <= index:
            bit += 1
        index -= comb(bit, k)
        out |= 1 << bit
    return out


def weighted_words(indices: DataFrame) -> DataFrame:
    """weight, idx, value (64 bits, two's complement) for rows (weight, idx)."""

    def run(frames):
        for f in frames:
            v = [weighted_word(w, i) for w, i in zip(f.weight.tolist(), f.idx.tolist(), strict=True)]
            yield f.assign(value=[x - (1 << 64) if x >> 63 else x for x in v])

    ship(indices.sparkSession)
    return indices.select("weight", "idx").mapInPandas(run, "weight long, idx long, value long")


@cache
def tabulation_tables(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of 16-bit values for the halves of a 32-bit key, made once a worker: entry i of a table is the top half of
    the 32-bit Weyl sequence from the seed, put through a multiply-and-shift mixer."""
    out = []
    for table in (0, 1):
        x = (np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B9) + np.uint64((2 * seed + table) * 0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x45D9F3B)) & np.uint64(0xFFFFFFFF)
        out.append((x ^ (x >> np.uint64(16))) >> np.uint64(16))
    return out[0].astype(np.int64), out[1].astype(np.int64)


def tabulation_hashes(keys: DataFrame, seed: int = 0) -> DataFrame:
    """key, hash: tabulation hashing of 32-bit keys to 16 bits."""

    def run(frames):
        low, high = tabulation_tables(seed)
        for f in frames:
            k = f.key.to_numpy("int64")
            yield f.assign(hash=low[k & 0xFFFF] ^ high[k >> 16 & 0xFFFF])

    ship(keys.sparkSession)
    return keys.select("key").mapInPandas(run, "key long, hash long")
