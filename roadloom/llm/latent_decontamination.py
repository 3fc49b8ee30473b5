"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most PASSAGE words, weighted by TF-IDF (document frequencies counted over
the whole corpus, in one pass), and a randomised singular value decomposition of the passage matrix, its products
summed over the partitions, gives a latent space. Every document is read as overlapping windows of PASSAGE words; a
window whose latent vector is near a passage's by cosine, and holds enough of its weight, is a candidate, and so is every
place that shares a run of LEAST_WORDS words with a passage: of each passage all runs that few others have, and its
rarest run however many have it, so no verbatim copy depends on the rank of the latent space. A candidate is confirmed
by the longest common subsequence of words around the window: as a copy from COPY of the passage's words in order, or
as a paraphrase from PARAPHRASE of them if most of the passage's answer words (its rarest) are there too. Passages of
fewer than LEAST_WORDS words are found verbatim only.

Documents are only mapped, never shuffled; hits, without their texts, meet the items of their passage. Distinct
passages go out in blocks of at most ITEMS, so what is broadcast has a bound; SCAN of them share a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.arrowtext import Block, blocks, map_blocks, windows
from roadloom.session import saved, ship
from roadloom.llm.toxicity_gru import bare_words, block_of

PASSAGE, STRIDE, LEAST_WORDS = 64, 32, 5
RANK, EXTRA, POWER = 96, 16, 2
COSINE, MASS, COPY, PARAPHRASE, ANSWER, ANSWER_WORDS = 0.35, 0.25, 0.8, 0.5, 0.5, 6
ITEMS = 2000
SCAN = 4  # blocks of passages that one scan of the documents looks for
FILTER_BITS = 1 << 24  # of the filter that keeps other words out of the counts
HELD_WORDS = 1 << 20  # words that a task counts before it hands them on
LOTS = 16  # tasks for the items of one passage
SHARED = 8  # passages of a block that may have a run of words that is looked up for all of them
_MAP = 20  # bits of the quick filter for words


def item_passages(benchmark: DataFrame) -> DataFrame:
    """item_id, body: lower-cased words of every passage, joined by spaces. Items without a word have none."""

    def rows(block: Block):
        block = block.lowered()
        words, raw = bare_words(block), block.data.tobytes()
        ids, out = block.column("item_id").to_pylist(), ([], [])
        for d in range(len(block)):
            own = [raw[a:b] for a, b in zip(words.start[words.ptr[d] : words.ptr[d + 1]].tolist(), words.end[words.ptr[d] : words.ptr[d + 1]].tolist(), strict=True)]
            n = max(1, round(len(own) / PASSAGE + 0.25)) if len(own) > PASSAGE else 1
            for part in range(n):
                piece = own[len(own) * part // n : len(own) * (part + 1) // n]
                if piece:
                    out[0].append(ids[d])
                    out[1].append(b" ".join(piece))
        return {"item_id": pa.array(out[0], pa.int64()), "body": pa.array(out[1], pa.binary())}

    named = benchmark.where("text is not null and item_id is not null").selectExpr("cast(item_id as bigint) as item_id", "text")
    return map_blocks(named, ["item_id", "text"], rows, "item_id long, body binary").distinct()


class Vocabulary:
    """Sorted 64-bit hashes of the passages' words, with a bit map that turns other words away quickly."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.map = np.zeros(1 << _MAP, bool)
        self.map[(self.hashes & np.uint64((1 << _MAP) - 1)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known words, their numbers)."""
        at = np.flatnonzero(self.map[(keys & np.uint64((1 << _MAP) - 1)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, keys[at]), len(self.hashes) - 1)
        ok = self.hashes[number] == keys[at]
        return at[ok], number[ok]


def hash_words(block: Block, words) -> np.ndarray:
    return block.hashes(words.start, words.end, seed=31)


def body_words(bodies: DataFrame) -> DataFrame:
    """word: the hashes of the words of bodies, each once."""
    ship(bodies.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_of([b.as_py() for b in batch.column(0)])
            yield pa.RecordBatch.from_pydict({"word": np.unique(hash_words(block, block.words())).view(np.int64)})

    return bodies.select("body").mapInArrow(run, "word long").distinct()


def document_frequencies(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """(word, n) for the words that are known (word) and occur, n documents each, and the number of documents: one pass
    over docs (text). A filter of fixed size keeps most other words from being counted, the join takes out the rest."""
    ship(docs.sparkSession)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS, bool)
        for b in batches:
            held[b.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(held, bitorder="little").tobytes()]})

    spots = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in known.coalesce(4).mapInArrow(bits, "bits binary").collect():  # 2 MB each, four at most
        spots |= np.frombuffer(r[0], np.uint8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_read, found = [], 0, 0
        out = lambda word, n: pa.RecordBatch.from_pydict({"word": pa.array(word, pa.int64()), "n": pa.array(n, pa.int64())})
        for block in map(Block.lowered, blocks(batches)):
            words, docs_read = bare_words(block), docs_read + len(block)
            keys = hash_words(block, words)
            spot = keys % np.uint64(FILTER_BITS)
            ok = np.flatnonzero(spots[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1)
            word, number = np.unique(keys[ok], return_inverse=True)
            pair = np.unique(words.doc[ok] * max(1, len(word)) + number)  # a document counts once
            held.append((word, np.bincount(pair % max(1, len(word)), minlength=len(word))))
            found += len(word)
            if found > HELD_WORDS:
                word, number = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
                held, found = [(word, np.bincount(number, np.concatenate([n for _, n in held])).astype(np.int64))], len(word)
                if found > HELD_WORDS // 2:
                    yield out(held[0][0].view(np.int64), held[0][1])
                    held, found = [], 0
        for word, n in held:
            yield out(word.view(np.int64), n)
        yield out([None], [docs_read])

    got = saved(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = got.where("word is null").agg(F.sum("n")).first()[0] or 0
    return got.join(known, "word"), int(total)


def passage_matrix(bodies: list[bytes], vocabulary: Vocabulary, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word, weight) of unit-length TF-IDF vectors."""
    block = block_of(bodies)
    words = block.words()
    at, number = vocabulary.find(hash_words(block, words))
    row = np.searchsorted(words.ptr, at, "right") - 1
    pair, tf = np.unique(row * len(idf) + number, return_counts=True)
    row, number = pair // len(idf), pair % len(idf)
    weight = tf * idf[number]
    norm = np.sqrt(np.bincount(row, weight * weight, len(bodies)))
    return row, number, weight / np.maximum(norm[row], 1e-12)


def randomised_svd(passages: DataFrame, vocabulary: Vocabulary, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix of passages (body).

    A Gaussian sketch of the row space, sharpened by POWER passes of A'A; every product is summed over partitions,
    whose parts have a fixed size, and only those sums reach the driver.
    """
    ship(passages.sparkSession)
    width = min(rank + EXTRA, len(idf))

    def summed(task, rows: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rows, width))
            for batch in batches:
                bodies = [b.as_py() for b in batch.column(0)]
                if bodies:
                    total += task(len(bodies), *passage_matrix(bodies, vocabulary, idf))
            yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

        parts = passages.select("body").mapInArrow(run, "part binary")
        out = np.zeros((rows, width))
        for part in parts.toLocalIterator():  # one partition's sum at a time
            out += np.frombuffer(part[0]).reshape(rows, width)
        return out

    def times(n: int, row: np.ndarray, word: np.ndarray, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros((n, q.shape[1]))
        np.add.at(out, row, weight[:, None] * q[word])
        return out

    q = np.random.default_rng(0).standard_normal((len(idf), width))
    for _ in range(POWER + 1):

        def gram(n, row, word, weight, q=q):
            out = np.zeros((len(idf), width))
            np.add.at(out, word, weight[:, None] * times(n, row, word, weight, q)[row])
            return out

        q = np.linalg.qr(summed(gram, len(idf)))[0]

    def small(n, row, word, weight):
        b = times(n, row, word, weight, q)
        return b.T @ b

    value, vector = np.linalg.eigh(summed(small, width))
    own = np.argsort(-value)[: min(rank, width)]
    return (q @ vector[:, own[value[own] > 1e-9]]).astype(np.float32)


def positions(item: list[int]) -> dict[int, int]:
    """For each word of an item, the bits of its places."""
    out: dict[int, int] = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(size: int, hits: list[int]) -> int:
    """Length of the longest common subsequence of an item of `size` words and a text, bit-parallel over the item; hits
    are the places in the item of those words of the text that it has."""
    full = v = (1 << size) - 1
    for m in hits:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Index:
    """Latent vectors of passages and what confirms a candidate."""

    def __init__(self, bodies: list[bytes], vocabulary: Vocabulary, idf: np.ndarray, space: np.ndarray):
        self.keys, self.vocabulary = [md5(b).hexdigest() for b in bodies], vocabulary
        self.space = space * idf[:, None].astype(np.float32)
        block = block_of(bodies)
        words = block.words()
        at, number = vocabulary.find(hash_words(block, words))
        # Words that most documents hold say little and are left out of windows, but not those of passages that have few others.
        self.useful, passage = idf > 0.5, np.searchsorted(words.ptr, at, "right") - 1
        rare = np.bincount(passage, self.useful[number], len(bodies)) < 0.5 * np.diff(words.ptr)
        self.useful[number[rare[passage]]] = True
        own = [number[a:b].tolist() for a, b in zip(*(np.searchsorted(at, p) for p in (words.ptr[:-1], words.ptr[1:])), strict=True)]
        self.size, self.places = [len(x) for x in own], [positions(x) for x in own]
        latent = np.zeros((len(bodies), space.shape[1]), np.float32)
        np.add.at(latent, np.searchsorted(words.ptr, at, "right") - 1, self.space[number])
        self.norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
        self.latent = latent / self.norm[:, None]
        self.least = np.where(np.diff(words.ptr) < LEAST_WORDS, np.inf, MASS * self.norm)  # short passages have no windows
        self._runs(hash_words(block, words), words, idf, np.concatenate(own) if own else np.zeros(0, np.int64))
        # Rarest words by steps of idf (a word that occurs twice is as rare as one that occurs once), the later first.
        step = np.floor(idf / 2).tolist()
        self.answer = [set(sorted({w: i for i, w in enumerate(x)}, key=lambda w, x=x: (-step[w], -len(x) + 1 + x[::-1].index(w)))[:ANSWER_WORDS]) for x in own]

    def _runs(self, keys: np.ndarray, words, idf: np.ndarray, number: np.ndarray) -> None:
        """The runs of words that are looked up, by length: (hashes of runs, bounds, passages, places); run i of a length is
        in the passages and at the places from bounds[i] to bounds[i + 1]."""
        size = np.diff(words.ptr)
        at = np.flatnonzero(words.window_ok(LEAST_WORDS))
        run, of = windows(keys, LEAST_WORDS)[at], words.doc[at]
        weight = np.convolve(idf[number], np.ones(LEAST_WORDS), "valid")[at] if len(at) else np.zeros(0)
        _, run_id = np.unique(run, return_inverse=True)
        pair, first = np.unique(np.column_stack([run_id, of]), axis=0, return_index=True)
        common = np.bincount(pair[:, 0], minlength=run_id.max(initial=-1) + 1)[run_id]
        order = np.lexsort((at, run_id, -weight, common, of))
        keep = common <= SHARED
        keep[order[np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))] if len(of) else []] = True
        keep &= np.isin(np.arange(len(run)), first)  # a run that a passage repeats counts from its first place
        self.runs = {LEAST_WORDS: self._listed(run[keep], of[keep], (at - words.ptr[of])[keep])}
        for n in range(1, LEAST_WORDS):  # short passages are runs themselves
            own = np.flatnonzero(size == n)
            if len(own):
                self.runs[n] = self._listed(windows(keys, n)[words.ptr[own]], own, np.zeros(len(own), np.int64))

    @staticmethod
    def _listed(run: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
        known = Vocabulary(run)
        number = np.searchsorted(known.hashes, run)
        order = np.argsort(number, kind="stable")
        return known, np.searchsorted(number[order], np.arange(len(known.hashes) + 1)), of[order], at[order]

    def shared_runs(self, words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, word of the block where the passage would start, passage, words of slack on either side) of places
        that share a run with a passage."""
        found = [np.zeros((0, 4), np.int64)]
        for n, (known, bounds, passages, places) in self.runs.items():
            ok = np.flatnonzero(words.window_ok(n))
            at, number = known.find(windows(keys, n)[ok])
            at, slack = ok[at], STRIDE if n == LEAST_WORDS else 0
            for cut in range(0, len(at), 4096):
                own, of = at[cut : cut + 4096], number[cut : cut + 4096]
                k = bounds[of + 1] - bounds[of]
                row = np.arange(k.sum()) + np.repeat(bounds[of] - (np.cumsum(k) - k), k)
                start = np.repeat(own, k) - places[row]
                doc = np.searchsorted(words.ptr, np.repeat(own, k), "right") - 1
                place = np.column_stack([doc, start, passages[row], np.full(len(row), slack)])
                found.append(place[np.unique(np.column_stack([place[:, [0, 2]], start // (STRIDE // 2) if slack else start]), axis=0, return_index=True)[1]])
        return tuple(np.concatenate(found).T)

    def cosine(self, number: list[int], p: int) -> float:
        """Of known words and a passage."""
        number = np.array(number, np.int64)
        vector = self.space[number[self.useful[number]]].sum(0)
        return float(vector @ self.latent[p] / max(np.linalg.norm(vector), 1e-9))

    def candidates(self, words, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, passage, cosine) of near windows; at, number: the known words."""
        n = np.diff(words.ptr)
        chunks = -(-n // STRIDE)
        base = np.cumsum(chunks) - chunks
        own = self.useful[number]
        at, number = at[own], number[own]
        if not len(at):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        doc = np.searchsorted(words.ptr, at, "right") - 1
        chunk = base[doc] + (at - words.ptr[doc]) // STRIDE
        first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        latent = np.zeros((chunks.sum() + 1, self.space.shape[1]), np.float32)
        latent[chunk[first]] = np.add.reduceat(self.space[number], first, 0)
        of = np.repeat(np.arange(len(n)), chunks)
        window = latent[:-1].copy()
        inner = np.flatnonzero(of[:-1] == of[1:])
        window[inner] += latent[inner + 1]
        size = np.linalg.norm(window, axis=1)
        strong = np.flatnonzero(size > self.least.min())
        found = []
        for cut in range(0, len(strong), 4096):
            own = strong[cut : cut + 4096]
            dot = window[own] @ self.latent.T
            w, p = np.nonzero((dot >= COSINE * size[own, None]) & (dot >= self.least[None, :]))
            found.append((own[w], p, dot[w, p] / size[own[w]]))
        w, p, cosine = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return of[w], (w - base[of[w]]) * STRIDE, p, cosine

    def confirmed(self, block: Block) -> list[tuple[int, int, float, float, float]]:
        """(document, passage, cosine, share in common order, share of answer words), the best window of each pair."""
        block = block.lowered()
        words, best = bare_words(block), {}
        keys = hash_words(block, words)
        known, number = self.vocabulary.find(keys)
        doc, start, passage, cosines = self.candidates(words, known, number)
        low = np.maximum(words.ptr[doc], words.ptr[doc] + start - STRIDE)
        high = np.minimum(words.ptr[doc + 1], words.ptr[doc] + start + PASSAGE + STRIDE)
        d, at, p, slack = self.shared_runs(words, keys)
        size = np.array(self.size, np.int64)[p]
        low = np.concatenate([low, np.maximum(words.ptr[d], at - slack)])
        high = np.concatenate([high, np.minimum(words.ptr[d + 1], at + size + slack)])
        # Where the latent vector is not taken yet, it is that of the words under the passage.
        inner = np.searchsorted(known, np.concatenate([np.zeros((len(doc), 2), np.int64), np.column_stack([np.maximum(words.ptr[d], at), np.minimum(words.ptr[d + 1], at + size)])]))
        doc, passage, cosines = np.concatenate([doc, d]), np.concatenate([passage, p]), np.concatenate([cosines, np.full(len(d), np.nan)])
        low, high = np.searchsorted(known, low), np.searchsorted(known, high)
        number = number.tolist()
        for d, a, b, p, cosine, (i, j) in zip(*(x.tolist() for x in (doc, low, high, passage, cosines, inner)), strict=True):
            hits = [m for m in map(self.places[p].get, number[a:b]) if m]
            if len(hits) < PARAPHRASE * self.size[p]:  # no order can make up for missing words
                continue
            share = common_subsequence(self.size[p], hits) / self.size[p]
            if share < PARAPHRASE:
                continue
            answer = len(self.answer[p].intersection(number[a:b])) / max(1, len(self.answer[p]))
            if share >= COPY or answer >= ANSWER:
                cosine = self.cosine(number[i:j], p) if cosine != cosine else cosine
                best[d, p] = max(best.get((d, p), (0.0, 0.0, 0.0)), (share, answer, cosine))
        return [(d, p, c, share, answer) for (d, p), (share, answer, c) in best.items()]


def fit_index(bodies: DataFrame, frequencies: DataFrame, total: int) -> Index | None:
    """The index over one block of distinct passages (body), with document frequencies (word, n) of `total` documents; None
    if there is nothing to find."""
    got = sorted(bytes(r[0]) for r in bodies.limit(ITEMS + 1).collect())
    if not got:
        return None
    if len(got) > ITEMS:
        raise ValueError(f"more than {ITEMS} passages in a block")
    block = block_of(got)
    vocabulary = Vocabulary(hash_words(block, block.words()))
    df = np.zeros(len(vocabulary.hashes), np.int64)
    rows = body_words(bodies).join(frequencies, "word").collect()  # a row a word of the block at most
    df[np.searchsorted(vocabulary.hashes, np.array([r[0] for r in rows], np.int64).view(np.uint64))] = [r[1] for r in rows]
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    return Index(got, vocabulary, idf, randomised_svd(bodies, vocabulary, idf))


def parted(bodies: DataFrame, n: int, salt: int = 0) -> Iterator[DataFrame]:
    """The n distinct bodies in parts of at most ITEMS, by hash; a part that comes out larger is split again."""
    if not n:
        return
    parts = -(-n // max(1, ITEMS // 2))
    part = F.pmod(F.xxhash64("body", F.lit(salt)), F.lit(parts))
    for k, size in sorted(tuple(r) for r in bodies.groupBy(part.alias("k")).count().collect()):  # a row for ITEMS / 2 passages
        own = bodies.where(part == k)
        if size > ITEMS:
            yield from parted(own, size, salt + 1)
        else:
            yield own


def indexes(docs: DataFrame, passages: DataFrame) -> Iterator[Index]:
    """One index for each block of distinct passages (item_id, body), however many items hold one."""
    bodies = saved(passages.select("body").distinct())
    if not (n := bodies.count()):
        return
    frequencies, total = document_frequencies(docs, saved(body_words(bodies)))
    frequencies = saved(frequencies)
    for part in parted(bodies, n):
        if (index := fit_index(part.coalesce(4), frequencies, total)) is not None:
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common, answer: documents of docs (doc_id, text) that hold passages of benchmark
    (item_id, text), a row for each document and passage of an item, from the best window.

    Null and empty texts hold nothing; rows with a null doc_id are reported with that null; null items and items without
    a word are no queries. Repeated rows are reported each. An empty table on either side gives no rows.
    """
    own = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").where("text is not null")
    passages, found = saved(item_passages(benchmark)), []
    for group in batched(indexes(own, passages), SCAN):

        def rows(block: Block, group=group):
            hits = [(d, index.keys[p], *x) for index in group for d, p, *x in index.confirmed(block)]
            if not hits:
                return None
            d, body, cosine, share, answer = zip(*hits, strict=True)
            return {"doc_id": block.column("doc_id").take(pa.array(d)), "body": pa.array(body), "cosine": pa.array(cosine, pa.float64()), "common": pa.array(share, pa.float64()), "answer": pa.array(answer, pa.float64())}

        found.append(map_blocks(own, ["doc_id", "text"], rows, "doc_id long, body string, cosine double, common double, answer double"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, common double, answer double")
    # Items come back by their passages; documents of one passage, and their items, go to LOTS tasks.
    items = passages.select(F.md5("body").alias("body"), "item_id", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))).alias("lot"))
    hits = reduce(DataFrame.union, found).withColumn("lot", F.pmod(F.xxhash64("doc_id", "cosine"), F.lit(LOTS)).cast("int"))
    pairs = hits.join(items, ["body", "lot"])
    return pairs.select("doc_id", "item_id", "cosine", "common", "answer")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and whatever else) that hold no passage of the benchmark; nothing is shuffled."""
    own = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").where("text is not null")
    out = docs
    for index in indexes(own, saved(item_passages(benchmark))):

        def keep(block: Block, index=index):
            mask = np.ones(len(block), bool)
            mask[[d for d, *_ in index.confirmed(block)]] = False
            return block.batch.filter(pa.array(mask))

        out = map_blocks(out, [f"`{c}`" for c in docs.columns], keep, docs.schema)
    return out
