"""Line deduplication by overlapping windows of three lines.

Lines with a word are numbered within their document; every three consecutive ones form a window, known by 128 bits of
hash. A window's first occurrence is the one with the smallest (doc_id, line); every later occurrence covers its three
lines, and covered lines go. Lines without a word take no part and stay.

The windows shuffle as fixed-width rows, pre-aggregated to one row a window before anything meets. The repeated ones are
saved and joined back to their occurrences: the HOT most frequent are broadcast, so that no window with more than a
HOT-th of all occurrences is a key of a shuffle, and the texts move once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from roadloom.llm.arrowtext import Block, map_blocks, windows
from roadloom.session import saved

LINES = 3
#: The most frequent repeated windows, whose first occurrences are broadcast (40 bytes each).
HOT = 2000


def worded_lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the line feed) and document of the lines that hold a word."""
    words = block.words()
    feeds = np.flatnonzero(block.data == 10)
    start = np.unique(np.concatenate([block.offs[:-1], feeds + 1]))
    start = start[start < len(block.data)]
    if not len(start):
        return start, start, start
    end = np.append(start[1:], len(block.data))
    end = end - ((end > start) & (block.data[end - 1] == 10))
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[full], end[full]
    return start, end, np.searchsorted(block.offs, start, "right") - 1


def line_windows(docs: DataFrame) -> DataFrame:
    """a, b (the window's hash), doc_id, line (number of its first line) of all windows."""

    def rows(block: Block):
        start, end, of = worded_lines(block)
        if len(start) < LINES:
            return None
        line = np.arange(len(start)) - np.searchsorted(of, of)
        ok = np.flatnonzero(of[: len(of) - LINES + 1] == of[LINES - 1 :])
        a, b = (windows(block.hashes(start, end, seed=s), LINES)[ok].view(np.int64) for s in (11, 12))
        return {"a": a, "b": b, "doc_id": block.column("doc_id").take(pa.array(of[ok])), "line": line[ok].astype(np.int32)}

    return map_blocks(docs.where("doc_id is not null"), ["doc_id", "text"], rows, "a long, b long, doc_id long, line int")


def line_dedup(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of docs (doc_id, text, ...) with text deduplicated, and the numbers of lines with a word and of those
    removed. `counts` names these two; columns of docs with these names are replaced, so a caller who needs them picks
    other names.

    Null and empty texts, and rows with a null doc_id, come back unchanged with nothing removed (n_lines counted);
    they are no source of repeats either where the id is null. Rows that repeat a doc_id count as one document. An
    empty table gives no rows. Documents of fewer than three lines have no window.
    """
    names = [c for c in docs.columns if c not in counts]
    kept = [f for f in docs.schema if f.name in names]
    # All columns travel as one struct, so their names can't clash with ours.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    found = line_windows(own)
    first = found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = saved(first)
    hot = first.orderBy(F.desc("n"), "a", "b").limit(HOT).select("a", "b", F.col("first").alias("hot"))
    # Occurrences of hot windows know their first one already; they go on under keys of their own, which spread them.
    spread = lambda c: F.when(F.col("hot").isNull(), F.col(c)).otherwise(F.xxhash64("doc_id", "line", F.lit(c))).alias(c)
    known = found.join(F.broadcast(hot), ["a", "b"], "left").select(spread("a"), spread("b"), "doc_id", "line", "hot")
    later = known.join(first.select("a", "b", "first"), ["a", "b"], "left").where(F.struct("doc_id", "line") > F.coalesce("hot", "first"))
    gone = later.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("_gone")).withColumnRenamed("doc_id", "_id")
    joined = own.join(gone, own.doc_id == gone["_id"], "left").drop("_id")

    def rows(block: Block):
        start, end, of = worded_lines(block)
        first = np.searchsorted(of, np.arange(len(block) + 1))
        raw, texts, removed = block.data.tobytes(), [], np.zeros(len(block), np.int64)
        for d, gone in enumerate(block.column("_gone").to_pylist()):
            text = raw[block.offs[d] : block.offs[d + 1]]
            if gone:
                cover = np.zeros(first[d + 1] - first[d] + LINES, bool)
                for j in range(LINES):
                    cover[np.array(gone) + j] = True
                cut = set((start[first[d] : first[d + 1]][cover[: first[d + 1] - first[d]]] - block.offs[d]).tolist())
                removed[d], kept, at = len(cut), [], 0
                for line in text.split(b"\n"):
                    if at not in cut:
                        kept.append(line)
                    at += len(line) + 1
                text = b"\n".join(kept)
            texts.append(text.decode("utf-8", "replace"))
        texts = pa.array(texts, pa.string())
        null = block.column("text").is_null()
        texts = pa.compute.if_else(null, pa.scalar(None, pa.string()), texts)
        row = block.column("_row")
        return {c: texts if c == "text" else row.field(c) for c in names} | dict(zip(counts, (np.diff(first), removed), strict=True))

    schema = StructType([*kept, *(StructField(c, LongType()) for c in counts)])
    return map_blocks(joined, ["doc_id", "text", "_row", "_gone"], rows, schema)


#: The digest of the query over ``line_dedup`` in DuckDB's SQL.
SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windowed AS (
  SELECT doc_id, j, CASE WHEN lead(j, 2) OVER w IS NOT NULL THEN line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w END AS win
  FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
ranked AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY win ORDER BY doc_id, j) AS k FROM windowed WHERE win IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, j + d AS j FROM ranked, (VALUES (0), (1), (2)) o(d) WHERE k > 1),
marked AS (
  SELECT s.doc_id, s.line, s.pos, w.j IS NOT NULL AS worded, g.j IS NOT NULL AS cut
  FROM split s LEFT JOIN worded w ON s.doc_id = w.doc_id AND s.pos = w.pos LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.j = g.j)
SELECT d.doc_id, coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (cut) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut) AS kept
  FROM marked GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""
