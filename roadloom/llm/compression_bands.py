"""Quality rules by compression bands.

A document passes if its zstandard ratio (raw / compressed) lies in the band for its length, over the whole text and
over its fixed chunks: a high ratio marks repetition, a low one text that does not compress like prose (symbol noise,
tables, random strings). Short texts compress less, so the limits depend on the length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from roadloom.llm.arrowtext import _SEP, Block, map_blocks, mix, windows
from roadloom.llm.line_dedup import worded_lines

#: (bytes of the document, lowest ratio, highest ratio) at LEVEL, straight lines over the logarithm of the length between.
BANDS = ((128, 1.00, 1.65), (256, 1.10, 1.76), (512, 1.20, 1.92), (1024, 1.30, 2.08), (2048, 1.45, 2.24), (4096, 1.55, 2.36), (16_384, 1.70, 2.52), (65_536, 1.75, 2.62))
#: The same for chunks, whose last one may be short; below 128 bytes only the upper limit tells anything.
CHUNK_BANDS = ((1, 0.00, 0.50), (8, 0.10, 0.90), (32, 0.30, 1.10), (64, 0.60, 1.45), *(b for b in BANDS if b[0] <= 2048))
#: Fixed chunks: bytes in a chunk, share of a document's bytes that may lie in chunks outside of their limits.
CHUNK, CHUNK_SHARE = 2048, 0.125
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether its (group, key) occurs again, and whether it occurred before (rows in order)."""
    with np.errstate(over="ignore"):
        both = mix(key + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    again, later = np.zeros(len(both), bool), np.zeros(len(both), bool)
    later[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, later


def covered(hit: np.ndarray, k: int, n: int) -> np.ndarray:
    """Positions under windows of k that start at the hits."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:n]) > 0


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    words = block.words()
    first = (block.data & 0xC0) != 0x80
    out = {"n_words": np.diff(words.ptr), "word_chars": block.per_doc(first & ~_SEP[block.data]), "n_symbols": block.per_doc(_SYMBOL[block.data])}
    keys = block.hashes(words.start, words.end)
    ok, of, hit = words.window_ok(3), words.doc, np.zeros(len(keys), bool)
    at = np.flatnonzero(ok)
    hit[at] = repeats(of[at], windows(keys, 3)[at])[0]
    total = np.concatenate([[0], np.cumsum(covered(hit, 3, len(keys)))])
    out["n_repeat_words"] = np.diff(total[words.ptr])
    start, stop, of = worded_lines(block)
    later = repeats(of, block.hashes(start, stop, seed=1))[1] if len(start) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(of[later], minlength=len(block)) if len(start) else np.zeros(len(block), np.int64)
    return out


def limits(bands: tuple, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest ratio for each size in bytes."""
    knots, lows, highs = np.array(bands).T
    at = np.log2(np.maximum(size, 1))
    return np.interp(at, np.log2(knots), lows), np.interp(at, np.log2(knots), highs)


_CHUNK_LIMITS = np.column_stack(limits(CHUNK_BANDS, np.arange(CHUNK + 1))).tolist()


def ratios(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole, and the share of its bytes in chunks (the last may be short) outside of the limits for their
    length. Empty: 1 and 0."""
    if not data:
        return 1.0, 0.0
    whole, out = len(data) / len(packer.compress(data)), 0
    for at in range(0, len(data), CHUNK):
        n = min(CHUNK, len(data) - at)
        ratio = whole if n == len(data) else n / len(packer.compress(data[at : at + n]))
        low, high = _CHUNK_LIMITS[n]
        out += 0 if low <= ratio <= high else n
    return whole, out / len(data)


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, chunk_share.

    base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows. kept: not
    base_failed, the ratio is inside its band, and chunk_share (of the bytes, in chunks outside of theirs) is at most
    CHUNK_SHARE. A null text is empty (all counts 0, base_failed). Repeated
    rows and null ids keep a row each; an empty table gives no rows. Narrow: one pass, no shuffle.
    """

    def rows(block: Block, packer: zstandard.ZstdCompressor):
        c = base_counts(block)
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        raw, size = block.data.tobytes(), block.sizes()
        both = np.array([ratios(raw[a:b], packer) for a, b in zip(block.offs[:-1], block.offs[1:], strict=True)]).reshape(-1, 2)
        low, high = limits(BANDS, size)
        kept = ~failed & (both[:, 0] >= low) & (both[:, 0] <= high) & (both[:, 1] <= CHUNK_SHARE)
        out = {"doc_id": block.column("doc_id")} | {k: pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        return out | {"base_failed": failed, "kept": kept, "ratio": both[:, 0], "chunk_share": both[:, 1]}

    named = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_share double"
    return map_blocks(named, ["doc_id", "text"], rows, schema, lambda: zstandard.ZstdCompressor(level=LEVEL))
