"""Language identification: family first, then one against one inside the family.

Features are hashed byte trigrams of the lower-cased text (any run of white space, digits or ASCII punctuation is one
space), as shares of the text. A linear support vector machine tells families apart, one for each pair of families;
inside a family one for each pair of its languages. The pair machines vote, margins break ties.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.arrowtext import Block, map_blocks
from roadloom.llm.samples import pick

#: Languages by family (ISO 639-1). A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "hu", "et"),
    "turkic": ("tr", "az", "kk"),
}
DIMS = 4096
#: The most labelled documents that the machines are fitted on (more only if there are over 120 languages).
SAMPLE = 2400
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_FOLD[65:91] += 32
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every trigram of the block, runs of spaces taken as one and each text framed by spaces."""
    n = len(block)
    data = np.full(len(block.data) + 2 * n, 32, np.int64)
    offs = block.offs + 2 * np.arange(n + 1)
    of = np.repeat(np.arange(n), block.sizes())
    data[np.arange(len(block.data)) + 2 * of + 1] = _FOLD[block.data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offs[:-1]] = True
    doc = np.repeat(np.arange(n), np.diff(offs))[keep]
    data = data[keep]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:-2] * 65_536 + data[1:-1] * 256 + data[2:]
    ok = (doc[:-2] == doc[2:]) & ((data[1:-1] != 32) | (data[:-2] != 32) & (data[2:] != 32))
    return doc[:-2][ok], ((code[ok] * 2_654_435_761) >> 15) % DIMS


def vectors(block: Block) -> np.ndarray:
    """Trigram shares, square-rooted and so of length one; a document a row."""
    doc, gram = grams(block)
    x = np.bincount(doc * DIMS + gram, minlength=len(block) * DIMS).reshape(len(block), DIMS).astype(np.float32)
    return np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """A linear SVM (hinge loss, L2) by dual coordinate descent; y is +1 or -1, the last weight is the bias."""
    rng = np.random.default_rng(0)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    norm, alpha, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / norm[i], 0.0), c)
            step = new - alpha[i]
            if step:
                w += np.float32(step * y[i]) * x[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


class Hierarchy:
    """Family machines and, inside each family, language machines."""

    def __init__(self, x: np.ndarray, lang: list[str]):
        self.langs = sorted(set(lang))
        lang_of = np.array([self.langs.index(v) for v in lang])
        fams = sorted({family(v) for v in self.langs})
        self.family_of = np.array([fams.index(family(v)) for v in self.langs])
        self.n_fam = len(fams)
        fam = self.family_of[lang_of]
        self.machines: list[tuple[int, int, int]] = []  # level (-1: families, else the family), first, second
        weights = []
        for a, b in itertools.combinations(range(self.n_fam), 2):
            weights.append(self._fit(x, fam, a, b))
            self.machines.append((-1, a, b))
        for a, b in itertools.combinations(range(len(self.langs)), 2):
            if self.family_of[a] == self.family_of[b]:
                weights.append(self._fit(x, lang_of, a, b))
                self.machines.append((int(self.family_of[a]), a, b))
        self.w = np.array(weights, np.float32).reshape(-1, DIMS + 1).T

    @staticmethod
    def _fit(x: np.ndarray, of: np.ndarray, a: int, b: int) -> np.ndarray:
        own = (of == a) | (of == b)
        return svm(x[own], np.where(of[own] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and a score in 0 to 1 from the smallest margin on its way."""
        n = len(x)
        margin = x @ self.w[:-1] + self.w[-1]
        votes_f, votes_l = np.zeros((n, self.n_fam)), np.zeros((n, len(self.langs)))
        for m, (level, a, b) in zip(margin.T, self.machines, strict=True):
            votes = votes_f if level < 0 else votes_l
            soft = np.tanh(m) / 4
            votes[:, a] += (m > 0) + soft
            votes[:, b] += (m <= 0) - soft
        fam = votes_f.argmax(1)
        votes_l[self.family_of[None, :] != fam[:, None]] = -np.inf
        lang = votes_l.argmax(1)
        least = np.full(n, 4.0)
        for m, (level, a, b) in zip(margin.T, self.machines, strict=True):
            mine = fam if level < 0 else lang
            least = np.where(mine == a, np.minimum(least, m), np.where(mine == b, np.minimum(least, -m), least))
        return lang, 1 / (1 + np.exp(-2 * least))


def fit(docs: DataFrame, train: DataFrame, sample: int = SAMPLE) -> Hierarchy | None:
    """docs: doc_id, text. train: doc_id, lang of the rows that may be learnt from. None without any label. Of rows that
    repeat an id the least language and the least vector count, so every run learns the same."""
    labelled = train.where("doc_id is not null and lang is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = pick(labelled, "lang", sample)
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def encode(block: Block):
        x = vectors(block)
        return {"doc_id": block.column("doc_id"), "lang": block.column("lang"), "x": pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())}

    found = map_blocks(rows, ["doc_id", "text", "lang"], encode, "doc_id long, lang string, x binary")
    got = found.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).select("lang", "x").collect()  # a row a chosen document
    if not got:
        return None
    got.sort(key=lambda r: (r[0], r[1]))
    return Hierarchy(np.array([np.frombuffer(r[1], np.float16) for r in got], np.float32), [r[0] for r in got])


def language_id(docs: DataFrame, train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    `und` with score 0 if the text is null or has no letter, or if there is nothing to learn from. Repeated rows and
    null ids keep a row each; an empty table gives no rows. Scoring is narrow; the model (a few weight vectors) goes
    out with the task.
    """
    named = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    model = fit(named, train.selectExpr("cast(doc_id as bigint) as doc_id", "lang"), sample)
    names = np.array([*model.langs] if model else [], object)

    def rows(block: Block):
        ascii_letter = block.per_doc(_FOLD[block.data] != 32) > 0  # an ASCII letter or any byte of a longer character
        pred, score = np.full(len(block), "und", object), np.zeros(len(block))
        if model:
            lang, sure = model.predict(vectors(block))
            pred[ascii_letter], score[ascii_letter] = names[lang[ascii_letter]], sure[ascii_letter]
        plain = block.per_doc((_FOLD[block.data] >= 97) & (_FOLD[block.data] <= 122)) > 0
        raw = block.data.tobytes()
        for i in np.flatnonzero(ascii_letter & ~plain):
            if not _LETTER.search(raw[block.offs[i] : block.offs[i + 1]].decode("utf-8", "replace")):
                pred[i], score[i] = "und", 0.0
        return {"doc_id": block.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}

    return map_blocks(named, ["doc_id", "text"], rows, "doc_id long, lang_pred string, score double")
