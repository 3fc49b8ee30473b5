"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own (hashed) embedding beside the mean embedding of its character n-grams and of its openings,
so unseen compounds of known parts still say something. Very long words (texts without spaces are one) enter as
overlapping pieces, each as a word, so every byte is read. The network reads windows of WINDOW words that overlap by half,
attention pools the states of a window to one logit, and the document takes its highest window, in training as in
scoring. Two numbers turn that logit into a probability; they are fitted on documents that the network which scored them
had not seen, so they don't trust a network that knows its training set by heart.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.arrowtext import _LOWER, Block, Words, map_blocks, mix
from roadloom.llm.samples import pick

WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, OPENING_ROWS, WIDTH, HIDDEN = 1 << 15, 1 << 14, 1 << 16, 6, 8
#: Bytes of the n-grams anywhere in a framed word, and of its openings (the frame byte included).
GRAMS, OPENINGS = (3, 4), (4, 5, 6, 7)
#: Longest word in bytes, and bytes that neighbouring pieces of a longer one share.
PIECE, OVERLAP = 48, max(OPENINGS)
#: The most labelled documents in training (whole texts), and the parts whose scores the rest predicts for calibration.
SAMPLE, FOLDS = 4000, 3
EPOCHS, BATCH, RATE = 5, 48, 0.06
#: Windows, and documents, that are worked on at once.
CHUNK, CHUNK_DOCS = 4096, 256
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def bare_words(block: Block) -> Words:
    """Words without the punctuation at their ends (one byte stays)."""
    w = block.words()
    start, end = w.start.copy(), w.end.copy()
    left = np.arange(len(start))  # words that may have more
    while len(left):
        start[left] += (end[left] - start[left] > 1) & _PUNCT[block.data[start[left]]]
        end[left] -= (end[left] - start[left] > 1) & _PUNCT[block.data[end[left] - 1]]
        left = left[(end[left] - start[left] > 1) & (_PUNCT[block.data[start[left]]] | _PUNCT[block.data[end[left] - 1]])]
    return Words(start, end, w.ptr)


def pieces(words: Words) -> Words:
    """The words, those over PIECE bytes as overlapping pieces that cover all of their bytes."""
    step = PIECE - OVERLAP
    count = np.maximum(1, 1 - (PIECE - (words.end - words.start)) // step)
    of = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    start = words.start[of] + (np.arange(len(of)) - before[of]) * step
    return Words(start, np.minimum(start + PIECE, words.end[of]), np.concatenate([before, [len(of)]])[words.ptr])


def rows_of(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct words of a block: for each word its number; for each number its embedding row, the rows of its n-grams
    (all in one array, with bounds) and the rows of its openings. A word (a piece at most) is taken lower-cased between
    frame bytes."""
    keys = block.hashes(words.start, words.end, seed=3, lower=True)
    uniq, first, number = np.unique(keys, return_index=True, return_inverse=True)
    start, end = words.start[first], words.end[first]
    size = end - start + 2
    offs = np.concatenate([[0], np.cumsum(size)])
    buf = np.full(offs[-1] + max(OPENINGS), 2, np.uint64)
    inner = np.repeat(start - offs[:-1] - 1, size) + np.arange(offs[-1])
    own = np.ones(offs[-1], bool)
    own[offs[:-1]] = own[offs[1:] - 1] = False
    if own.any():
        buf[: offs[-1]][own] = _LOWER[block.data[inner[own]]]
    grams, owner, openings = [], [], []
    of = np.repeat(np.arange(len(uniq)), size)
    h = np.full(offs[-1], 7, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, max(GRAMS) + 1):
            h = h * np.uint64(1_000_003) + buf[k - 1 : k - 1 + offs[-1]]
            if k in GRAMS:
                ok = np.flatnonzero(of[: offs[-1] - k + 1] == of[k - 1 :])
                grams.append((mix(h[ok]) % np.uint64(GRAM_ROWS)).astype(np.int64))
                owner.append(of[ok])
        h = np.full(len(uniq), 11, np.uint64)
        for k in range(1, max(OPENINGS) + 1):
            h = h * np.uint64(1_000_003) + np.where(k <= size, buf[offs[:-1] + k - 1], np.uint64(2))
            if k in OPENINGS:
                openings.append((mix(h) % np.uint64(OPENING_ROWS)).astype(np.int64))
    flat, owner = np.concatenate(grams), np.concatenate(owner)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(uniq)))])
    return number, (uniq % np.uint64(WORD_ROWS)).astype(np.int64), (flat[np.argsort(owner, kind="stable")], bounds), np.column_stack(openings)


def window_starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word inside it) of all overlapping windows; a document without words has none."""
    count = np.where(n > 0, np.maximum(1, -(-(n - STRIDE) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in float32; ``embed`` gives inputs of distinct words, ``logits`` runs windows of their numbers. Not
    recurrent: every step starts from nothing, so a window is a bag of words (to compare with)."""

    def __init__(self, seed: int = 0, recurrent: bool = True):
        self.recurrent = recurrent
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d, h = 3 * WIDTH, HIDDEN
        self.p = {"word": small(WORD_ROWS, WIDTH) * 10, "gram": small(GRAM_ROWS, WIDTH) * 10, "open": small(OPENING_ROWS, WIDTH) * 10}
        for side in "fb":
            self.p |= {f"x{side}": small(d, 3 * h), f"u{side}": small(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": small(2 * h, h), "att_b": np.zeros(h, np.float32), "att_v": small(h), "out": small(2 * h), "out_b": np.array([-1.0], np.float32)}
        self.seen = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        self.scale, self.shift, self.prior = 1.0, 0.0, 0.1

    def embed(self, row: np.ndarray, grams: tuple[np.ndarray, np.ndarray], openings: np.ndarray) -> np.ndarray:
        """Word embedding beside the means of n-gram and of opening embeddings."""
        flat, bounds = grams
        mean = np.add.reduceat(self.p["gram"][flat], bounds[:-1], 0) / np.diff(bounds)[:, None] if len(flat) else np.zeros((len(row), WIDTH))
        return np.hstack([self.p["word"][row], mean, self.p["open"][openings].mean(1)]).astype(np.float32)

    def scan(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States (steps, windows, HIDDEN) of one direction; x: inputs of distinct words; keep: what backward needs."""
        u, h_n = self.p[f"u{side}"], HIDDEN
        gx = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        h = np.zeros((at.shape[0], h_n), np.float32)
        out = np.empty((at.shape[1], at.shape[0], h_n), np.float32)
        for t in range(at.shape[1]) if side == "f" else range(at.shape[1] - 1, -1, -1):
            h = h if self.recurrent else np.zeros_like(h)
            g, gh, m = gx[at[:, t]], h @ u, mask[:, t, None]
            zr = sigmoid(g[:, : 2 * h_n] + gh[:, : 2 * h_n])
            z, r = zr[:, :h_n], zr[:, h_n:]
            n = np.tanh(g[:, 2 * h_n :] + r * gh[:, 2 * h_n :])
            new = h + m * ((1 - z) * (n - h))
            if keep is not None:
                keep.append((t, h, z, r, n, gh[:, 2 * h_n :], m))
            out[t] = h = new
        return out

    def logits(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kf, kb = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self.scan(x, at, mask, "f", kf), self.scan(x, at, mask, "b", kb)], 2)
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = np.where(mask.T > 0, a @ self.p["att_v"], -30.0)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "states": states, "a": a, "w": w, "pooled": pooled, "x": x, "at": at}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def backward(self, keep: dict, d: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the word inputs, for gradients d of the logits."""
        p, h_n, g = self.p, HIDDEN, {}
        states, w, a = keep["states"], keep["w"], keep["a"]
        g["out"], g["out_b"] = keep["pooled"].T @ d, np.array([d.sum()])
        dpool = d[:, None] * p["out"]
        dw = (states * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att_v"] = np.einsum("tbh,tb->h", a, de)
        g["att"], g["att_b"] = np.einsum("tbi,tbj->ij", states, da), da.sum((0, 1))
        ds = w[:, :, None] * dpool + da @ p["att"].T
        dx = np.zeros_like(keep["x"])
        for side, cut in (("f", slice(0, h_n)), ("b", slice(h_n, 2 * h_n))):
            u, wx = p[f"u{side}"], p[f"x{side}"]
            gu, gw, gc = np.zeros_like(u), np.zeros_like(wx), np.zeros(3 * h_n, np.float32)
            carry = np.zeros((len(d), h_n), np.float32)
            for t, h, z, r, n, ghn, m in reversed(keep[side]):
                up = carry + ds[t][:, cut]
                own = up * m
                dn = own * (1 - z) * (1 - n * n)
                dz = own * (h - n) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                gates = np.hstack([dz, dr, dn])
                inner = np.hstack([dz, dr, dn * r])
                gu += h.T @ inner
                carry = up * (1 - m) + own * z + inner @ u.T if self.recurrent else np.zeros_like(carry)
                xt = keep["x"][keep["at"][:, t]]
                gw += xt.T @ gates
                gc += gates.sum(0)
                np.add.at(dx, keep["at"][:, t], gates @ wx.T)
            g |= {f"u{side}": gu, f"x{side}": gw, f"c{side}": gc}
        return g, dx

    def step(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Adagrad, for embeddings on the rows that were touched."""
        at = slice(None) if rows is None else rows
        self.seen[name][at] += grad * grad
        self.p[name][at] -= (RATE * grad / np.sqrt(self.seen[name][at] + 1e-8)).astype(np.float32)

    def window_logits(self, block: Block, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, logit) of all windows of the block."""
        words = words or pieces(bare_words(block))
        if not len(words.start):
            return np.zeros(0, np.int64), np.zeros(0)
        number, *inputs = rows_of(block, words)
        doc, start = window_starts(np.diff(words.ptr))
        pos = (words.ptr[doc] + start)[:, None] + np.arange(WINDOW)
        mask = (pos < words.ptr[doc + 1][:, None]).astype(np.float32)
        x, at = self.embed(*inputs), number[np.minimum(pos, len(number) - 1)]
        return doc, np.concatenate([self.logits(x, at[i : i + CHUNK], mask[i : i + CHUNK]) for i in range(0, len(at), CHUNK)])

    def scores(self, block: Block) -> np.ndarray:
        """Probability for each document; one without words gets the share of toxic documents in training."""
        doc, z = self.window_logits(block)
        best = np.full(len(block), -np.inf)
        np.maximum.at(best, doc, z)
        known = np.isfinite(best)
        return np.where(known, sigmoid(self.scale * np.where(known, best, 0.0) + self.shift), min(self.prior, 0.29))


def block_of(texts: list[bytes]) -> Block:
    return Block(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), None)


class Sample:
    """Training texts (their words or pieces, bare, with single spaces between) as numbers of distinct words."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        self.y = np.array(labels, float)
        block = block_of(texts)
        words = block.words()
        self.number, self.row, self.grams, self.openings = rows_of(block, words)
        self.number, self.ptr = self.number.astype(np.int32), words.ptr
        self.of, start = window_starts(np.diff(words.ptr))
        self.start = words.ptr[self.of] + start
        self.first = np.searchsorted(self.of, np.arange(len(texts) + 1))

    def windows(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, mask) of some windows."""
        pos = self.start[own, None] + np.arange(WINDOW)
        return self.number[np.minimum(pos, len(self.number) - 1)], (pos < self.ptr[self.of[own] + 1, None]).astype(np.float32)

    def logits(self, net: Network, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best window, its logit) of documents."""
        wins = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in docs])
        owner = np.repeat(np.arange(len(docs)), [self.first[i + 1] - self.first[i] for i in docs])
        z = np.empty(len(wins))
        for i in range(0, len(wins), CHUNK):
            at, mask = self.windows(wins[i : i + CHUNK])
            x, local, _ = _part(net, at, self.row, self.grams, self.openings)
            z[i : i + CHUNK] = net.logits(x, local, mask)
        best = np.lexsort((-z, owner))[np.searchsorted(owner, np.arange(len(docs)))]
        return wins[best], z[best]

    def log_odds(self, docs: np.ndarray) -> dict[str, np.ndarray]:
        """For each embedding row how much more often label-1 documents hold its word or part; 0 below three documents."""
        y, sizes = self.y[docs], {"word": WORD_ROWS, "gram": GRAM_ROWS, "open": OPENING_ROWS}
        hit = {k: np.zeros((2, n)) for k, n in sizes.items()}
        for cut in range(0, len(docs), CHUNK_DOCS):
            own = docs[cut : cut + CHUNK_DOCS]
            held = [np.unique(self.number[self.ptr[i] : self.ptr[i + 1]]) for i in own]
            word, doc = np.concatenate(held), np.repeat(np.arange(len(own)), [*map(len, held)])
            for name, key, owner in (("word", self.row[word], doc), ("gram", *_spread(self.grams, word, doc)), ("open", self.openings[word].ravel(), np.repeat(doc, len(OPENINGS)))):
                pair = np.unique(owner * sizes[name] + key)
                for v in (0, 1):
                    hit[name][v] += np.bincount(pair[self.y[own][pair // sizes[name]] == v] % sizes[name], minlength=sizes[name])
        odds = lambda h: np.log((h[1] + 0.5) / (y.sum() + 1)) - np.log((h[0] + 0.5) / ((1 - y).sum() + 1))
        return {k: np.clip(odds(h), -4, 4) * (h.sum(0) > 2) for k, h in hit.items()}

    def trained(self, docs: np.ndarray, seed: int, recurrent: bool) -> Network:
        net, rng = Network(seed, recurrent), np.random.default_rng(seed)
        for name, odds in self.log_odds(docs).items():
            net.p[name] *= 0.1
            net.p[name][:, 0] = odds
        for _ in range(EPOCHS):
            order = docs[rng.permutation(len(docs))]
            for cut in range(0, len(order), BATCH):
                own = order[cut : cut + BATCH]
                at, mask = self.windows(self.logits(net, own)[0])
                x, local, (w_row, (w_gram, w_bounds), w_open) = _part(net, at, self.row, self.grams, self.openings)
                keep: dict = {}
                z = net.logits(x, local, mask, keep)
                g, dx = net.backward(keep, ((sigmoid(z) - self.y[own]) / len(own)).astype(np.float32))
                for name, grad in g.items():
                    net.step(name, grad)
                dw, dg, do = dx[:, :WIDTH], dx[:, WIDTH : 2 * WIDTH], dx[:, 2 * WIDTH :]
                n = np.diff(w_bounds)
                for name, index, grad in (("word", w_row, dw), ("gram", w_gram, np.repeat(dg / n[:, None], n, 0)), ("open", w_open.ravel(), np.repeat(do / len(OPENINGS), len(OPENINGS), 0))):
                    rows, back = np.unique(index, return_inverse=True)
                    total = np.zeros((len(rows), WIDTH), np.float32)
                    np.add.at(total, back, grad)
                    net.step(name, total, rows)
        net.seen = {}  # Adagrad's sums are not needed any more
        return net


def part_of_training(docs: list[tuple[bytes, int]], k: int, seed: int = 0, recurrent: bool = True) -> Network | np.ndarray:
    """k = FOLDS: the network trained on all documents; else the logits of fold k (every FOLDS-th document from k) by a
    network trained on the others, zeros if those have one label only."""
    sample, every = Sample([t for t, _ in docs], [label for _, label in docs]), np.arange(len(docs))
    if k == FOLDS:
        return sample.trained(every, seed, recurrent)
    own, rest = every[every % FOLDS == k], every[every % FOLDS != k]
    if not len(own) or len(set(sample.y[rest].tolist())) < 2:
        return np.zeros(len(own))
    return sample.logits(sample.trained(rest, seed, recurrent), own)[1]


def calibrated(net: Network, folds: list[np.ndarray], y: np.ndarray, share: float) -> Network:
    """The network with scale and shift by logistic regression on the folds' logits, weighted to the true share of label 1."""
    best = np.zeros(len(y))
    for k, z in enumerate(folds):
        best[k::FOLDS] = z
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(300):
        err = weight * (sigmoid(a * best + b) - y)
        a -= 0.05 * (err * best).mean() / max((best * best).mean(), 1e-6) * 10
        b -= 0.5 * err.mean()
    net.scale, net.shift, net.prior = max(float(a), 0.05), float(b), share
    return net


def train(docs: list[tuple[bytes, int]], share: float, seed: int = 0, recurrent: bool = True) -> Network:
    """docs: (a text's words or pieces, bare, with single spaces between; label). share: of label 1 among all labelled rows."""
    folds = [part_of_training(docs, k, seed, recurrent) for k in range(FOLDS)]
    return calibrated(part_of_training(docs, FOLDS, seed, recurrent), folds, np.array([y for _, y in docs], float), share)


def _spread(grams: tuple[np.ndarray, np.ndarray], word: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram rows of some words, one after the other, and for each the word's tag."""
    flat, bounds = grams
    n = np.diff(bounds)[word]
    base = np.repeat(bounds[word] - (np.cumsum(n) - n), n)
    return flat[base + np.arange(len(base))], np.repeat(tag, n)


def _part(net: Network, at: np.ndarray, row: np.ndarray, grams: tuple[np.ndarray, np.ndarray], openings: np.ndarray):
    """Inputs of the words in some windows, the windows in their numbering, and the rows behind them."""
    used, local = np.unique(at, return_inverse=True)
    flat, tag = _spread(grams, used, np.arange(len(used)))
    own = row[used], (flat, np.concatenate([[0], np.cumsum(np.bincount(tag, minlength=len(used)))])), openings[used]
    return net.embed(*own), local.reshape(at.shape), own


def bare_texts(block: Block) -> list[bytes]:
    """The words (or pieces) of each document that the network reads, with single spaces between."""
    words, raw = pieces(bare_words(block)), block.data.tobytes()
    at = [raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    return [b" ".join(at[a:b]) for a, b in zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """docs: doc_id, text. labels: doc_id, label of the rows that may be learnt from. None without both labels. Of rows that
    repeat an id the least text counts."""
    labelled = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = labelled.agg(F.avg("label")).first()[0]
    chosen = pick(labelled, "label", sample)
    rows = docs.join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    encode = lambda block: {"doc_id": block.column("doc_id"), "label": block.column("label"), "x": pa.array(bare_texts(block), pa.binary())}
    found = map_blocks(rows, ["doc_id", "text", "label"], encode, "doc_id long, label int, x binary")
    got = sorted(found.groupBy("doc_id", "label").agg(F.min("x")).collect())  # at most `sample` rows
    pairs = [(bytes(r[2]), r[1]) for r in got if r[2]]
    if len({y for _, y in pairs}) < 2:
        return None
    # The network and those of the folds are trained side by side in tasks, not on the driver.
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(pairs)

    def run(frames):
        for f in frames:
            yield f.assign(part=[pickle.dumps(part_of_training(held.value, k)) for k in f["id"].tolist()])

    parts = dict(spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(run, "id long, part binary").collect())  # a network of 3 MB, and logits
    *folds, net = (pickle.loads(parts[k]) for k in range(FOLDS + 1))
    held.destroy()
    return calibrated(net, folds, np.array([y for _, y in pairs], float), float(share))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text).

    labels holds doc_id and label (0 or 1) of the rows to learn from; null ids or labels are passed over, of several
    labels the largest counts. A text without words, or null, gets the share of label 1 (0.29 at most). Without both
    labels every score is 0. Repeated rows and null ids keep a row each; an empty table gives no rows. Scoring is
    narrow; the network (3 MB) goes out with the task.
    """
    named = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    net = fit(named, labels.selectExpr("cast(doc_id as bigint) as doc_id", "cast(label as int) as label"), sample)

    def rows(block: Block):
        score = net.scores(block).astype(float) if net else np.zeros(len(block))
        return {"doc_id": block.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_blocks(named, ["doc_id", "text"], rows, "doc_id long, score double, predicted int")
