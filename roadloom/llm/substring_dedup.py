"""Substring deduplication with suffix automata of reference shards.

A window of WINDOW consecutive words is removed (its words are) if the same words also start earlier: in a smaller
doc_id, or earlier in the same document. Equal windows choose the same anchor, the smallest hash among their ANCHOR-word
runs, so anchors say which documents have to meet:

1. Every document is cut into segments, the runs of windows with one anchor position; anchors that occur once are
   dropped (fixed-width rows only).
2. The other segments go, as text, to the shard of their anchor. A shard streams its segments in (doc_id, start)
   order through a generalised suffix automaton over words: after each word, the length at the suffix link of the
   current state is the matching statistic, the longest match that ends here and was seen before. Where it reaches
   WINDOW, the window is a repeat. Segments equal to an earlier one skip the automaton.
3. The repeated windows return to their documents, where covered words go.

Frequent anchors are split further: those of a sample (HOT_ROWS at most, so the set may be broadcast) before they are
shuffled, and all others with more than MANY segments by their exact counts. Their windows travel one by one under their
own hash, after a task has settled the repeats that it saw itself. So a passage that a third of all documents share meets
with a few rows a task and window, and a shard holds no text that it has seen before. Hashes only decide where texts
meet; the verdict comes from the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.arrowtext import Block, Words, map_blocks, mix, windows
from roadloom.session import ship

WINDOW, ANCHOR = 20, 8
#: One document in HOT_EVERY is sampled for hot anchors; an anchor is hot from HOT_LEAST occurrences in the sample, and
#: the HOT_ROWS most frequent are kept.
HOT_EVERY, HOT_LEAST, HOT_ROWS = 16, 12, 10_000
#: Segments that one anchor brings together at most; windows that a task remembers to settle repeats on the spot.
MANY, HELD = 5000, 50_000


def segments(words: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of every segment; windows are named by their first word."""
    span = WINDOW - ANCHOR + 1
    runs = windows(keys, ANCHOR)
    n = len(keys) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = runs[:n].copy()
    for j in range(1, span):
        np.minimum(least, runs[j : j + n], out=least)
    place = np.full(n, span - 1)
    for j in range(span - 2, -1, -1):
        place[runs[j : j + n] == least] = j
    ok = np.flatnonzero(words.window_ok(WINDOW))
    owner = ok + place[ok]
    first = np.ones(len(ok), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (ok[1:] != ok[:-1] + 1)
    at = np.flatnonzero(first)
    return ok[at], np.diff(np.append(at, len(ok))), least[ok[at]]


def anchor_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """anchor, doc_id, start (word in the document), n (windows) of all segments whose anchor is not hot."""

    def rows(block: Block):
        words = block.words()
        at, n, anchor = segments(words, block.hashes(words.start, words.end))
        cold = ~np.isin(anchor, hot)
        at, n, anchor = at[cold], n[cold], anchor[cold]
        if not len(at):
            return None
        doc = np.searchsorted(words.ptr, at, "right") - 1
        return {"anchor": anchor.view(np.int64), "doc_id": block.column("doc_id").take(pa.array(doc)), "start": (at - words.ptr[doc]).astype(np.int32), "n": n.astype(np.int32)}

    return map_blocks(docs, ["doc_id", "text"], rows, "anchor long, doc_id long, start int, n int")


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent anchors of sampled documents. They steer where windows meet, no more."""
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_EVERY)) == 0)
    found = anchor_rows(part, np.zeros(0, np.uint64)).groupBy("anchor").count().where(F.col("count") >= HOT_LEAST)
    return np.sort(np.array([r[0] for r in found.orderBy(F.desc("count"), "anchor").limit(HOT_ROWS).collect()], np.int64).view(np.uint64))


class Seen:
    """The smallest place of windows that a task has met, by their words; forgets all when it is full."""

    def __init__(self):
        self.places: dict[bytes, tuple[int, int]] = {}

    def repeated(self, body: bytes, here: tuple[int, int]) -> bool | None:
        """Whether an earlier place is known; None: this very place is."""
        before = self.places.get(body)
        if before is not None and before <= here:
            return None if before == here else True
        if len(self.places) >= HELD:
            self.places.clear()
        self.places[body] = here
        return False


def texts_to_shards(joined: DataFrame, hot: np.ndarray) -> DataFrame:
    """shard, doc_id, start, body: segments of listed anchors, and windows of hot ones and of those listed as many. body
    null: already known to be a repeat, since the task has met an earlier one."""

    def rows(block: Block, seen: Seen):
        words = block.words()
        if not len(words.start):
            return None
        raw, ids = block.data.tobytes(), block.column("doc_id").to_pylist()
        out = [], [], [], []
        # Texts with single spaces between words, for slicing by word.
        plain = b" ".join([raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
        size = words.end - words.start
        place = np.concatenate([[0], np.cumsum(size + 1)])
        listed = block.column("_listed")
        owner = np.repeat(np.arange(len(block)), [len(x) if x.is_valid else 0 for x in listed])
        single = [np.zeros((0, 2), np.int64)]  # (first window, windows) that go one by one
        if len(owner):
            flat = pa.concat_arrays([listed]).flatten()
            anchor, start, n, many = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            at = words.ptr[owner] + start
            single.append(np.column_stack([at, n])[many])
            anchor, owner, start, n, at = (x[~many] for x in (anchor, owner, start, n, at))
            for key, d, s, a, b in zip(anchor.tolist(), owner.tolist(), start.tolist(), place[at].tolist(), (place[at + n + WINDOW - 1] - 1).tolist(), strict=True):
                out[0].append(key)
                out[1].append(ids[d])
                out[2].append(s)
                out[3].append(plain[a:b])
        keys = block.hashes(words.start, words.end) if len(hot) or len(single[-1]) else None
        if len(hot):
            at, n, anchor = segments(words, keys)
            own = np.isin(anchor, hot)
            single.append(np.column_stack([at[own], n[own]]))
        at, n = np.concatenate(single).T
        if len(at):
            at = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc = np.searchsorted(words.ptr, at, "right") - 1
            named = np.array([i is not None for i in ids])[doc]
            at, doc = at[named], doc[named]
            key = mix(windows(keys, WINDOW)[at] + np.uint64(1)).view(np.int64).tolist()
            start = (at - words.ptr[doc]).tolist()
            for i in sorted(range(len(key)), key=lambda i: (ids[doc[i]], start[i])):
                body, here = plain[place[at[i]] : place[at[i] + WINDOW] - 1], (ids[doc[i]], start[i])
                known = seen.repeated(body, here)
                if known is None:
                    continue
                out[0].append(hash(here) if known else key[i])
                out[1].append(here[0])
                out[2].append(here[1])
                out[3].append(None if known else body)
        if not out[0]:
            return None
        return {"shard": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "start": pa.array(out[2], pa.int32()), "body": pa.array(out[3], pa.binary())}

    return map_blocks(joined, ["doc_id", "text", "_listed"], rows, "shard long, doc_id long, start int, body binary", Seen)


class Automaton:
    """A generalised suffix automaton over words that reports matching statistics while it grows."""

    def __init__(self):
        self.size, self.link, self.next = [0], [-1], [{}]

    def stream(self, words: list[bytes]) -> list[int]:
        """Adds a segment; for each of its words, the length of the longest match ending there that was seen before,
        in earlier segments or in this one."""
        size, link, nxt = self.size, self.link, self.next
        last, seen = 0, []
        for w in words:
            known = nxt[last].get(w)
            if known is not None and size[known] == size[last] + 1:
                last = known  # the whole run is in the automaton already
                seen.append(size[last])
                continue
            if known is not None:
                last = self._split(last, w, known)
                seen.append(size[last])
                continue
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            nxt.append({})
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
            last = new
            seen.append(size[link[new]])
        return seen

    def _split(self, p: int, w: bytes, q: int) -> int:
        """Gives the strings of q that are no longer than size[p] + 1 a state of their own."""
        size, link, nxt = self.size, self.link, self.next
        clone = len(size)
        size.append(size[p] + 1)
        link.append(link[q])
        nxt.append(dict(nxt[q]))
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone


class Shard:
    """One shard's segments, as they come in the order of (doc_id, start): distinct ones are held, repeats are told."""

    def __init__(self):
        self.bodies: set[bytes] = set()
        self.first, self.automaton, self.last = None, None, None

    def repeats(self, doc: int, start: int, body: bytes) -> Iterator[tuple[int, int, int]]:
        """(doc_id, first window, windows) of the segment's windows that were seen before; a place counts once."""
        if self.last == (doc, start):
            return
        self.last = doc, start
        if body in self.bodies:
            yield doc, start, body.count(b" ") + 2 - WINDOW
            return
        self.bodies.add(body)
        if self.first is None:
            self.first = body
            return
        if self.automaton is None:
            self.automaton = Automaton()
            self.automaton.stream(self.first.split(b" "))
        hit = [e - WINDOW + 1 for e, n in enumerate(self.automaton.stream(body.split(b" "))) if n >= WINDOW]
        while hit:
            n = 1
            while n < len(hit) and hit[n] == hit[0] + n:
                n += 1
            yield doc, start + hit[0], n
            hit = hit[n:]


def shard_repeats(shards: DataFrame) -> DataFrame:
    """doc_id, start, n: runs of repeated windows. One key's distinct segments are held at a time; Spark sorts (and spills)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "start", "n"])

        shard, key, found = Shard(), None, []
        for batch in batches:
            for own, doc, start, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if body is None:
                    found.append((doc, start, 1))
                    continue
                if own != key:
                    shard, key = Shard(), own
                found += shard.repeats(doc, start, body)
            if len(found) > 50_000:
                yield out(found)
                found = []
        yield out(found)

    ship(shards.sparkSession)
    return shards.repartition("shard").sortWithinPartitions("shard", "doc_id", "start").mapInArrow(run, "doc_id long, start int, n int")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (kept words joined by one space) for every row of docs (doc_id, text).

    A null text has no words. A row with a null doc_id keeps all its words and is no source of repeats. Rows that
    repeat a doc_id with its text count as one document and come back alike. An empty table gives no rows.
    """
    own = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    named = own.where("doc_id is not null and text is not null")
    hot = hot_anchors(named)
    cold = anchor_rows(named, hot).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("k > 1")
    listed = cold.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("anchor", "start", "n", (F.col("k") > MANY).alias("many"))).alias("_listed"))
    joined = own.join(listed, own.doc_id == listed["_id"], "left").drop("_id")
    found = shard_repeats(texts_to_shards(joined, hot))
    gone = found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("start", "n")).alias("_gone"))

    def rows(block: Block):
        words, raw = block.words(), block.data.tobytes()
        edge = np.zeros(len(words.start) + 1, np.int64)
        spans = block.column("_gone")
        owner = np.repeat(np.arange(len(block)), [len(x) if x.is_valid else 0 for x in spans])
        if len(owner):
            flat = pa.concat_arrays([spans]).flatten()
            at = words.ptr[owner] + flat.field(0).to_numpy(zero_copy_only=False)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + flat.field(1).to_numpy(zero_copy_only=False) + WINDOW - 1, -1)
        keep = np.cumsum(edge[:-1]) == 0
        total = np.concatenate([[0], np.cumsum(keep)])[words.ptr]
        pieces = [raw[a:b] for a, b in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)]
        kept = [b" ".join(pieces[a:b]).decode("utf-8", "replace") for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
        n = np.diff(words.ptr)
        return {"doc_id": block.column("doc_id"), "n_words": n, "n_removed": n - np.diff(total), "kept": pa.array(kept, pa.string())}

    return map_blocks(own.join(gone, own.doc_id == gone["_id"], "left").drop("_id"), ["doc_id", "text", "_gone"], rows, "doc_id long, n_words long, n_removed long, kept string")


#: The query's digest in DuckDB's SQL.
SQL = r"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM listed),
wins AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM listed WHERE len(w) >= 20)),
hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
marked AS (
  SELECT w.doc_id, w.word, w.i, coalesce(max(CASE WHEN h.i IS NOT NULL THEN 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS cut
  FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id AND w.i = h.i)
SELECT d.doc_id, coalesce(m.n_words, 0)::BIGINT AS n_words, coalesce(m.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (cut = 1) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (cut = 0) AS kept
  FROM marked GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""
