"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a few numeric features, each feature a bin. Cyclic boosting visits the features in turn and
adds a shallow tree over one feature's bins to that feature's lookup table; then it does the same with trees of one
cut on either axis for the pairs of features that explain most of what is left. A score is a sum of table entries, so
scoring is a handful of vectorised lookups.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.arrowtext import Block, map_blocks
from roadloom.llm.compression_bands import base_counts
from roadloom.llm.samples import pick

FEATURES = ("log_words", "word_length", "symbols", "marks", "upper", "dup_lines", "repeat_words", "distinct", "digits", "sentence_ends", "line_words", "exclamations", "bars", "wide", "short_words", "top_word")
#: The most labelled documents that the tables are fitted on.
SAMPLE = 8000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 150, 60, 0.15


def _class(of: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in of]] = True
    return out


_MARK = _class("!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")
_UPPER, _LOWER, _DIGIT = (_class("".join(map(chr, range(ord(a), ord(b) + 1)))) for a, b in ("AZ", "az", "09"))
_END = _class(".!?")


def features(block: Block) -> np.ndarray:
    """One row of FEATURES a document; an empty text has zeros."""
    c, words = base_counts(block), block.words()
    n = np.maximum(c["n_words"], 1).astype(float)
    data = block.data
    chars = np.maximum(c["word_chars"], 1)
    upper, lower = block.per_doc(_UPPER[data]), block.per_doc(_LOWER[data])
    lines = block.per_doc(data == 10) + 1
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[words.ptr]) / n
    ends = share(_END[data[words.end - 1]]) if len(words.end) else np.zeros(len(block))
    short = share(words.end - words.start <= 3)
    distinct, top = np.zeros(len(block)), np.zeros(len(block))
    if len(words.start):
        key, of = block.hashes(words.start, words.end), words.doc
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]))
        distinct = np.bincount(of[cut], minlength=len(block)) / n
        np.maximum.at(top, of[cut], np.diff(np.append(cut, len(key))))
        top /= n
    cols = (np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, block.per_doc(_MARK[data]) / chars, upper / np.maximum(upper + lower, 1), c["n_dup_lines"] / lines, c["n_repeat_words"] / n, distinct, block.per_doc(_DIGIT[data]) / chars, ends, n / lines, block.per_doc(data == 33) / n, block.per_doc(data == 124) / n, block.per_doc(data >= 128) / chars, short, top)
    return np.column_stack(cols)


def shallow(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps of a tree with at most 2**depth leaves over ordered bins with gradient and hessian sums."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > 1.0) & (hr > 1.0), gl * gl / (hl + 1.0) + gr * gr / (hr + 1.0), -np.inf)
    at = int(gain.argmax())
    if gain[at] <= g.sum() ** 2 / (h.sum() + 1.0):
        return out
    return np.concatenate([shallow(g[: at + 1], h[: at + 1], depth - 1), shallow(g[at + 1 :], h[at + 1 :], depth - 1)])


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each axis over a grid of sums: its gain and its steps."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, steps = 0.0, np.zeros_like(g)
    base = cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
    for i, j in itertools.product(range(1, g.shape[0]), range(1, g.shape[1])):
        parts = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
        gain = sum(a * a / (b + 1.0) for a, b in zip(*parts, strict=True)) - base
        if gain > best:
            best, v = gain, [a / (b + 1.0) for a, b in zip(*parts, strict=True)]
            steps = np.block([[np.full((i, j), v[0]), np.full((i, g.shape[1] - j), v[1])], [np.full((g.shape[0] - i, j), v[2]), np.full((g.shape[0] - i, g.shape[1] - j), v[3])]])
    return best, steps


@dataclass
class Additive:
    """Bin edges, lookup tables and interaction tables; 0.5 for every document before it is fitted."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return tuple([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)] for edges in (self.edges, self.coarse))

    def margin(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x)
        out = np.full(len(x), self.start)
        for b, t in zip(fine, self.tables, strict=True):
            out += t[b]
        for i, j, t in self.pairs:
            out += t[coarse[i], coarse[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        cuts = lambda col, k: np.unique(np.quantile(col, np.arange(1, k) / k))
        self.edges = [cuts(c, BINS) for c in x.T]
        self.coarse = [cuts(c, PAIR_BINS) for c in x.T]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        fine, coarse = self.bins(x)
        f = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            for b, t in zip(fine, self.tables, strict=True):
                p = 1 / (1 + np.exp(-f))
                step = RATE * shallow(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), 2)
                t += step
                f += step[b]
        p = 1 / (1 + np.exp(-f))
        grid = lambda i, j, v: np.bincount(coarse[i] * (len(self.coarse[j]) + 1) + coarse[j], v, (len(self.coarse[i]) + 1) * (len(self.coarse[j]) + 1)).reshape(len(self.coarse[i]) + 1, -1)
        ranked = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda ij: -quadrants(grid(*ij, y - p), grid(*ij, p * (1 - p)))[0])
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for i, j in ranked[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-f))
                step = RATE * quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
                t += step
                f += step[coarse[i], coarse[j]]
        return self


def fit(docs: DataFrame, train: DataFrame, sample: int = SAMPLE) -> Additive | None:
    """docs: doc_id, text. train: doc_id, label of the rows that may be learnt from. None without both labels. Of rows that
    repeat an id the least features count, so every run learns the same."""
    labelled = train.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = pick(labelled.withColumn("all", F.lit(1)), "all", sample).join(labelled, "doc_id").select("doc_id", "label")
    rows = docs.join(F.broadcast(chosen.limit(sample)), "doc_id")  # at most `sample` rows
    encode = lambda block: {"doc_id": block.column("doc_id"), "label": block.column("label"), "x": pa.array(features(block).tolist(), pa.list_(pa.float64()))}
    found = map_blocks(rows, ["doc_id", "text", "label"], encode, "doc_id long, label int, x array<double>")
    got = sorted(found.groupBy("doc_id", "label").agg(F.min("x")).collect())  # at most `sample` rows
    y = np.array([r[1] for r in got], float)
    if len(set(y.tolist())) < 2:
        return None
    return Additive().fit(np.array([r[2] for r in got]), y)


def quality_scores(docs: DataFrame, train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, predicted (1 from a score of 0.5) for every row of docs (doc_id, text).

    train holds doc_id and label (0 or 1) of the rows to learn from; null ids or labels are passed over, of several
    labels the largest counts. Empty and null texts are scored from zero features. Without both labels every score is
    0.5. Repeated rows and null ids keep a row each; an empty table gives no rows. Scoring is narrow.
    """
    named = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    model = fit(named, train.selectExpr("cast(doc_id as bigint) as doc_id", "cast(label as int) as label"), sample)

    def rows(block: Block):
        score = model.scores(features(block)) if model else np.full(len(block), 0.5)
        return {"doc_id": block.column("doc_id"), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return map_blocks(named, ["doc_id", "text"], rows, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text and whatever else) that quality_scores predicts 1 for; nothing is shuffled."""
    model = fit(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), train.selectExpr("cast(doc_id as bigint) as doc_id", "cast(label as int) as label"), sample)
    if model is None:
        return docs
    keep = lambda block: block.batch.filter(pa.array(model.scores(features(block)) >= 0.5))
    return map_blocks(docs, [f"`{c}`" for c in docs.columns], keep, docs.schema)
