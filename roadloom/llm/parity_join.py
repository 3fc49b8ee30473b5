"""N-gram Jaccard join with parity sketches.

Sets of five-word shingles link from a Jaccard similarity of 0.75. Each shingle flips one bit of a set's sketch, so the
Hamming distance of two sketches is at most the sets' symmetric difference, and that is at most a third of the smaller
set for linked sets. By size, sets fall into bands of ratio 4/3, so partners are in the same or the next band:

* Equal sets are one node (64 bits of hash). Copies never meet again.
* In the scheme of a size band every shingle falls into one of m parts; the XOR of a part's shingle hashes is a key.
  Of m parts at most d = (largest size) / 3 differ, so a set with more than d filled parts shares a filled part with
  each partner. The rare set with fewer adds keys for its smallest quarter of shingles, by which two such sets meet.
* Nodes with a common key are candidates. Small groups give their pairs. In large groups members meet a leader first:
  each node that of the few groups which it chooses by hash (nodes of a family choose alike), then, when those links have
  been verified and merged, one from the largest component of other such groups. What is left, members of one group that
  lie in different components, meets in blocks on the sketches; a pair that chose a group in common is told there only.
  Nodes in fewer large groups than they must share with a partner are left out: that clears passages which many
  documents share.
* Candidates are verified on the shingle sets; components come from the links.

Keys travel as packed arrays by bucket, sketches only where groups are large, shingle sets only for candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.arrowtext import Block, blocks, map_blocks, mix, trimming, windows
from roadloom.plans.components import extended
from roadloom.session import saved, ship

SHINGLE, LEAST, MOST = 5, 75, 100  # links from LEAST / MOST
#: Nodes of a group that gives its pairs at once; nodes in a block of a larger group.
SMALL, CLOSE = 16, 2048
#: Large groups that a node chooses by hash, and those of them whose leaders it meets first.
CHOSEN, FIRST = 8, 3
#: Keys that a task packs before it hands them on.
FLUSH = 1 << 19
#: Bits of the filter for the nodes whose sets are needed: its size is fixed, a crowded filter only passes more.
BLOOM_BITS = 1 << 24
_LOW = np.uint64((1 << 55) - 1)
_PART = np.uint64((1 << 40) - 1)


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (55-bit hashes, ascending within a document) and the bounds of each document."""
    words = block.words()
    keys, n = block.hashes(words.start, words.end, seed=21, lower=True), np.diff(words.ptr)
    ok = words.window_ok(SHINGLE)
    doc, value = words.doc[: len(ok)][ok], windows(keys, SHINGLE)[ok]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        doc = np.concatenate([doc, short])
        value = np.concatenate([value, [windows(keys[words.ptr[d] : words.ptr[d + 1]], int(n[d]))[0] ^ np.uint64(n[d]) for d in short]]).astype(np.uint64)
    packed = np.unique((doc.astype(np.uint64) << np.uint64(55)) | (value & _LOW))  # at most 512 documents a block
    return packed & _LOW, np.searchsorted(packed >> np.uint64(55), np.arange(len(block) + 1).astype(np.uint64))


def node_ids(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The node of each document: a hash of its set; 0 for the empty set."""
    total = np.zeros((2, len(values) + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(values), out=total[0, 1:])
        np.cumsum(mix(values + np.uint64(77)), out=total[1, 1:])
        a, b = total[:, ptr[1:]] - total[:, ptr[:-1]]
        out = mix(a ^ mix(b + np.diff(ptr).astype(np.uint64)))
    out[np.diff(ptr) == 0] = 0
    return out.view(np.int64)


def _sizes(limit: int = 1 << 40) -> np.ndarray:
    """Smallest size of each size band."""
    low = [1]
    while low[-1] < limit:
        low.append(low[-1] * 4 // 3 + 1)
    return np.array(low)


LOWEST = _sizes()


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOWEST, n, "right") - 1


def differing(band: np.ndarray) -> np.ndarray:
    """d: the largest symmetric difference of linked sets whose smaller one is in the band."""
    return (LOWEST[band + 1] - 1) // 3


def parts_in(band: np.ndarray) -> np.ndarray:
    return (LOWEST[band + 1] - 1) // 2 + 2


def part_keys(values: np.ndarray, ptr: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 64-bit key) for both schemes of some documents: that of their own band and of the band below; and for
    every document of the block the least number of keys that it shares with any partner."""
    size = np.diff(ptr)
    out_doc, out_key, need = [], [], np.full(len(size), np.iinfo(np.int64).max)
    for below in (0, 1):
        own = docs[band_of(size[docs]) >= below]
        if not len(own):
            continue
        band = band_of(size[own]) - below
        m, n = parts_in(band), size[own]
        doc = np.repeat(np.arange(len(own)), n)
        h = values[np.repeat(ptr[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        base = np.cumsum(m) - m
        part = mix(h + np.repeat(band, n).astype(np.uint64)) % np.repeat(m, n).astype(np.uint64)
        slot = base[doc].astype(np.uint64) + part
        packed = np.sort((slot << np.uint64(40)) | (h & _PART))
        slot = packed >> np.uint64(40)
        cut = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        parity, slot = np.bitwise_xor.reduceat(packed & _PART, cut), slot[cut].astype(np.int64)
        of = np.searchsorted(base, slot, "right") - 1
        out_doc.append(own[of])
        out_key.append(mix(parity + mix((slot - base[of]).astype(np.uint64) * np.uint64(1 << 20) + band[of].astype(np.uint64) * np.uint64(2) + np.uint64(1))))
        spare = np.bincount(of, minlength=len(own)) - differing(band)
        need[own] = np.minimum(need[own], np.maximum(spare, 1))
        thin = np.flatnonzero(spare <= 0)
        for d in own[thin].tolist():  # few filled parts: keys for the smallest quarter of shingles as well
            first = values[ptr[d] : ptr[d] + size[d] - -(-size[d] * LEAST // MOST) + 1]
            out_doc.append(np.full(len(first), d))
            out_key.append(mix(first + np.uint64(1 << 60)))
    return (np.concatenate(out_doc), np.concatenate(out_key), need) if out_doc else (np.zeros(0, np.int64), np.zeros(0, np.uint64), need)


def sketch_bits(band: int) -> int:
    """Bits of the sketch of sets in a band: a power of two, two to four times the largest size."""
    return min(1 << 17, max(64, 1 << int(LOWEST[band + 1] * 2 - 1).bit_length()))


def sketch(values: np.ndarray) -> bytes:
    bits = sketch_bits(int(band_of(np.array([len(values)]))[0]))
    flips = np.bincount((mix(values + np.uint64(5)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def fold(raw: bytes, bits: int) -> np.ndarray:
    """A sketch at a smaller power of two: halves fold onto each other, which keeps the lower bound."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, bits // 64), 0)


def document_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text hash apart: node, n (set size), sketch of every document."""

    def rows(block: Block):
        values, ptr = shingle_sets(block)
        n = np.diff(ptr)
        return {"doc_id": block.column("doc_id"), "node": node_ids(values, ptr), "n": n, "sketch": pa.array([sketch(values[a:b]) if b > a else b"" for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())}

    return map_blocks(docs, ["doc_id", "text"], rows, "doc_id long, node long, n long, sketch binary")


def packed_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket and packed arrays: keys, and for runs of keys of one set its node, the run's length and the number of keys
    that it shares with any partner. One row a bucket and flush; a set occurs once a task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, needs, held, seen = [], [], [], 0, set()

        def flush() -> pa.RecordBatch:
            key, node, need = np.concatenate(keys), np.concatenate(nodes), np.concatenate(needs)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, node, need, bucket = key[order], node[order], need[order], bucket[order]
            at = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(key))
            out = {"bucket": bucket[at[:-1]].astype(np.int32), "keys": [], "nodes": [], "runs": [], "needs": []}
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                edge = np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]])
                edge[:: 1 << 15] = True  # run lengths fit 16 bits
                cut = np.append(np.flatnonzero(edge), b - a)
                out["keys"].append(np.ascontiguousarray((key[a:b] // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                out["nodes"].append(node[a:b][cut[:-1]].tobytes())
                out["runs"].append(np.diff(cut).astype(np.uint16).tobytes())
                out["needs"].append(need[a:b][cut[:-1]].tobytes())
            return pa.RecordBatch.from_pydict(out)

        for block in blocks(batches):
            values, ptr = shingle_sets(block)
            node = node_ids(values, ptr)
            fresh = []
            for i, k in enumerate(node.tolist()):
                if k and k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if len(seen) > 1_000_000:
                seen = set()
            if not fresh:
                continue
            doc, key, need = part_keys(values, ptr, np.array(fresh))
            keys.append(key)
            needs.append(np.minimum(need, 65_535).astype(np.uint16)[doc])
            nodes.append(node[doc])
            held += len(key)
            if held > FLUSH:
                yield flush()
                keys, nodes, needs, held = [], [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(trimming(run), "bucket int, keys binary, nodes binary, runs binary, needs binary")


def by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    """A partition for each bucket, so that a task holds one bucket's keys only, however hashes would have dealt them."""
    return packed.repartitionById(buckets, "bucket")


def group_rows(packed: DataFrame, buckets: int) -> DataFrame:
    """a, b, grp, blk, need: pairs of small groups (grp null), and memberships of large ones (b null): the group's key, the
    pair of blocks to meet in (0 for groups of one block), and how many keys the member shares with any partner."""

    def groups(parts: list[tuple[np.ndarray, ...]], bucket: int) -> pa.RecordBatch:
        key = np.zeros((sum(len(p[0]) for p in parts) // 6, 8), np.uint8)
        np.concatenate([p[0].reshape(-1, 6) for p in parts], out=key[:, :6])
        key = key.view(np.uint64)[:, 0]
        node, need = (np.concatenate([np.repeat(p[k].view(kind), p[2].view(np.uint16)) for p in parts]) for k, kind in ((1, np.int64), (3, np.uint16)))
        parts.clear()
        order = np.argsort(key, kind="stable")
        key = key[order]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        key, node, need = key[twin], node[order[twin]], need[order[twin]]
        order = np.lexsort((node, key))
        key, node, need = key[order], node[order], need[order]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
        key, node, need = key[~same], node[~same], need[~same]
        cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)) if len(key) else np.zeros(1, np.int64)
        size = np.repeat(np.diff(cut), np.diff(cut))
        left = np.repeat(cut[1:], np.diff(cut)) - np.arange(len(key)) - 1  # members after this one
        a, b = [], []
        for step in range(1, SMALL):
            at = np.flatnonzero((size <= SMALL) & (left >= step))
            if not len(at):
                break
            a.append(node[at])
            b.append(node[at + step])
        pairs = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0) if a else np.zeros((0, 2), np.int64)
        many = np.flatnonzero(size > SMALL)
        count = -(-size[many] // CLOSE)
        own = (mix(node[many].view(np.uint64)) % count.astype(np.uint64)).astype(np.int64)
        rep = np.repeat(np.arange(len(many)), count)
        other = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
        x, y = np.minimum(own[rep], other), np.maximum(own[rep], other)
        name = mix(key[many] * np.uint64(1_000_003) + np.uint64(bucket)).view(np.int64)
        n, m = len(pairs), len(rep)
        either = lambda of_pairs, of_many: pa.array(np.concatenate([np.zeros(n, np.int64) if of_pairs is None else of_pairs, np.zeros(m, np.int64) if of_many is None else of_many]), pa.int64(), mask=np.repeat([of_pairs is None, of_many is None], [n, m]))
        return pa.RecordBatch.from_pydict({
            "a": either(pairs[:, 0], node[many][rep]), "b": either(pairs[:, 1], None), "grp": either(None, name[rep]),
            "blk": either(None, x * 1_000_000 + y), "need": either(None, need[many][rep].astype(np.int64)),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at = [], None
        for batch in batches:
            at = batch.column(0)[0].as_py() if len(batch) else at
            parts += [tuple(np.frombuffer(x.as_buffer(), np.uint8) for x in part) for part in zip(*batch.columns[1:], strict=True)]
        if parts:
            yield groups(parts, at)

    return by_bucket(packed, buckets).mapInArrow(trimming(run), "a long, b long, grp long, blk long, need long")


def near(x: list, y: list) -> np.ndarray:
    """Pairs (i, j) of rows (node, n, sketch, component, ...) of two lists, of different components, whose sizes and
    sketches allow a link."""
    out, band = [], lambda n: int(band_of(np.array([n]))[0])
    by: dict[int, tuple[list[int], list[int]]] = {}
    for side, rows in enumerate((x, y)):
        for i, r in enumerate(rows):
            by.setdefault(band(r[1]), ([], []))[side].append(i)
    for p in by:
        for q in (p - 1, p, p + 1):
            if q not in by or not by[p][0] or not by[q][1]:
                continue
            bits = sketch_bits(min(p, q))
            i, j = np.array(by[p][0]), np.array(by[q][1])
            left, right = (np.array([fold(rows[k][2], bits) for k in at]) for rows, at in ((x, i), (y, j)))
            nl, nr = np.array([x[k][1] for k in i]), np.array([y[k][1] for k in j])
            cl, cr = np.array([x[k][3] for k in i]), np.array([y[k][3] for k in j])
            step = max(1, (1 << 18) // max(1, right.size))
            for a in range(0, len(i), step):
                far = np.bitwise_count(left[a : a + step, None, :] ^ right[None, :, :]).sum(2, dtype=np.int32)
                total = nl[a : a + step, None] + nr[None, :]
                ok = (far * (MOST + LEAST) <= (MOST - LEAST) * total) & (cl[a : a + step, None] != cr[None, :])
                f, s = np.nonzero(ok)
                out.append(np.column_stack([i[a + f], j[s]]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def choices(members: DataFrame) -> DataFrame:
    """node, chosen: of the groups of each node (grp, node) those with the least hashes, one for each of CHOSEN seeds."""
    least = (F.min(F.struct(F.xxhash64("grp", F.lit(i)).alias("h"), "grp"))["grp"] for i in range(CHOSEN))
    return members.groupBy("node").agg(F.array(*least).alias("chosen"))


def leader_pairs(lead: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes and the leaders of their groups; lead: grp, node, comp. The leader is a member of the group's
    largest component (of equal ones another in each group), whose members have nothing to tell it."""
    best = lead.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node")).alias("node"))
    top = saved(best.groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("comp", "grp").alias("h"), "comp", "node")).alias("top")).select("grp", F.col("top.comp").alias("_comp"), F.col("top.node").alias("_node")))
    pairs = lead.join(top, "grp").where("comp <> _comp").select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))
    return pairs.distinct()


def sketch_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): all near members (grp, blk, node, comp) of a group from different components; nodes: node, n,
    sketch, chosen. Pairs are told in one of the groups that both chose, if there is one."""

    def block_pairs(grp: int, rows: list[tuple]) -> np.ndarray:
        rows = list({r[0]: r for r in rows}.values())
        at = near(rows, rows)
        if not len(at):
            return np.zeros((0, 2), np.int64)
        node, chosen = np.array([r[0] for r in rows]), np.array([r[4] for r in rows], np.int64)
        both = chosen[at[:, 0]] == chosen[at[:, 1]]
        here = np.where(both.any(1), chosen[at[:, 0], both.argmax(1)] == grp, True)
        got = np.sort(node[at[here]], 1)
        return np.unique(got[got[:, 0] != got[:, 1]], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], None

        def out() -> pa.RecordBatch:
            got = block_pairs(at[0], rows)
            return pa.RecordBatch.from_arrays([pa.array(got[:, k], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for grp, blk, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, blk) != at and rows:
                    yield out()
                    rows = []
                at = grp, blk
                rows.append(tuple(row))
        if rows:
            yield out()

    # Groups that lie in one component have nothing to tell; sketches join the rest only.
    mixed = members.groupBy("grp", "blk").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("grp", "blk")
    placed = members.join(mixed, ["grp", "blk"]).join(nodes, "node").repartition("grp", "blk").sortWithinPartitions("grp", "blk")
    return placed.select("grp", "blk", "node", "n", "sketch", "comp", "chosen").mapInArrow(trimming(run), "a long, b long").distinct()


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    ends = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    both = pairs.join(ends("a"), "a").join(ends("b"), "b").where(f"{MOST} * least(n_a, n_b) >= {LEAST} * greatest(n_a, n_b)")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, m, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                size = 8 * min(len(x), len(y))
                far = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
                keep.append(far * (MOST + LEAST) <= (MOST - LEAST) * (n + m))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(trimming(check), "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (saved) pairs whose sets link. docs: doc_id, text; nodes: node, rep (a document with that set)."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    need = saved(nodes.join(ends, "node").select("node", F.col("rep").alias("_rep")))
    spots = need.select(F.pmod(F.xxhash64("_rep"), F.lit(BLOOM_BITS)).alias("spot")).distinct()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            held[b.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(held).tobytes()]})

    filter_bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in spots.coalesce(4).mapInArrow(trimming(bits), "bits binary").collect():  # 2 MB each, four at most
        filter_bits |= np.frombuffer(r[0], np.uint8)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((filter_bits[spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)))
            for block in blocks(iter([batch])):
                values, ptr = shingle_sets(block)
                yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "shingles": pa.array([values[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())})

    spotted = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)).alias("spot"))
    found = spotted.mapInArrow(trimming(sets), "doc_id long, shingles binary")
    full = saved(need.join(found, need["_rep"] == found.doc_id).groupBy("node").agg(F.first("shingles").alias("shingles")))
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(MOST * both >= LEAST * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return saved(both.select("a", "b", "x", "y").mapInArrow(trimming(check), "a long, b long"))


def parity_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, the document's own included. Documents with equal sets
    link; empty and null texts have no shingles and link with nothing. A row with a null doc_id stays, without a
    component. Rows that repeat a doc_id come back alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    named = own.where("doc_id is not null")
    every = saved(document_nodes(own))
    nodes = saved(every.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = saved(group_rows(packed_keys(named, buckets), buckets))
    large = groups.where("b is null").select("grp", "blk", F.col("a").alias("node"), "need")
    # Partners that meet in no small group share all their keys in large ones, so a node needs as many of those.
    able = large.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.max("need").alias("need")).where("k >= need").select("node")
    members = saved(large.drop("need").join(able, "node"))
    chosen = saved(nodes.join(choices(members), "node").select("node", "n", "sketch", "chosen"))

    def lead(part: Column) -> DataFrame:
        return chosen.select("node", F.explode(F.array_distinct(part)).alias("grp"))

    def met(pairs: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        return pairs, extended(roots, verified(pairs, named, nodes))

    small = groups.where("b is not null").select("a", "b").distinct()
    first = leader_pairs(lead(F.slice("chosen", 1, FIRST)).withColumn("comp", F.col("node")))
    told, roots = met(saved(near_pairs(small.union(first).distinct(), nodes)), None)
    for step in ("leaders", "rest"):
        merged = lambda rows, roots=roots: rows.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        if step == "leaders":
            more = near_pairs(leader_pairs(merged(lead(F.slice("chosen", FIRST + 1, CHOSEN)))), nodes)
        else:
            more = sketch_pairs(merged(members), chosen)
        more = saved(more.join(told, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            more, roots = met(more, roots)
            told = told.union(more)
    linked = nodes.join(roots, "node").select("node", "rep", "root")
    least = saved(linked.groupBy("root").agg(F.min("rep").alias("least")))
    of = linked.join(least, "root").select("node", "least")
    # Saved, so that the last join has two plain shuffles, of which a node with very many copies can be split.
    named_class = saved(nodes.select("node", "rep").join(of, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id")))
    out = every.select("doc_id", "node", "n").join(named_class, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


#: The query in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM listed),
sized AS (SELECT doc_id, coalesce(len(s), 0) AS n, s FROM shingled),
tokens AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
ranked AS (
  SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY f, t) AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY t) AS f FROM tokens)),
prefix AS (SELECT * FROM ranked WHERE k <= n - ceil(n * 3 / 4.0) + 1),
cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (
    SELECT c.a, c.b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS i
    FROM cand c JOIN sized x ON c.a = x.doc_id JOIN sized y ON c.b = y.doc_id)
  WHERE 100 * i >= 75 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON r.node = e.a WHERE r.root < e.b)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, r.root AS component_id
FROM sized s JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON s.doc_id = r.node
"""
