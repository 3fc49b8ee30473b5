"""Token counts by prefix dynamic programming.

The last token of a byte-pair encoding is fixed by the prefix that it ends: an encoding of ``p + t`` is the encoding
of ``p`` followed by ``t`` exactly if the last token of ``p`` and ``t`` form a stable pair. So one pass over a
pre-token gives, for every prefix, its last token and its exact token count, and truncation or budget questions are
answered from the stored counts without encoding again. Pre-tokens recur, so their prefix tables are kept in a bounded
cache; a text's count is the sum of its tables' last entries, and its cut at a budget lies in the table where the sum
passes the budget.
"""

from __future__ import annotations

import json
from array import array
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from roadloom.llm.arrowtext import Block, map_blocks, texts

#: Pre-tokens, and prefixes of them, in a generation of the cache.
CACHE, ENTRIES = 300_000, 4_000_000
Table = bytes | array
NEVER = 1 << 60
LIMIT = 1024


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand = byte_alphabet()
        raw = lambda s: bytes(stand[c] for c in s)
        self.vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.longest = max(map(len, self.vocab))
        self.rank = {tuple(map(raw, m.split(" ") if isinstance(m, str) else m)): i for i, m in enumerate(spec["model"]["merges"])}
        self.split = {}  # token: rank and halves of the merge that makes it; the lowest rank counts
        for pair, i in self.rank.items():
            self.split.setdefault(pair[0] + pair[1], (i, pair))
        self.spines: tuple[dict, dict] = ({}, {})
        self.find = regex.compile(pattern).findall
        special = [t["content"] for t in spec.get("added_tokens", []) if not t.get("normalized", False)]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}

        class Tables(dict):
            """Prefix counts by pre-token in two generations: when the young one is full it becomes the old one."""

            old: dict[str, Table] = {}
            entries = 0

            def __missing__(tables, piece: str) -> Table:
                if len(tables) >= CACHE or tables.entries >= ENTRIES:
                    tables.old, tables.entries = dict(tables), 0
                    tables.clear()
                table = tables.old.get(piece)
                if table is None:
                    table = self.prefixes(piece.encode("utf-8", "surrogatepass"))
                    table = bytes(table) if len(table) <= 256 else array("i", table)  # a count is at most the length
                tables.entries += len(table)
                tables[piece] = table
                return table

        self.tables = Tables()

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging by rank, for single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The parts of a token that touch its right (left) end, from its byte up, each with the rank of the merge
        that takes it in; the token itself has none."""
        at = self.spines[right]
        known = at.get(token)
        if known is None:
            if len(token) == 1:
                known = [(token, NEVER)]
            else:
                rank, halves = self.split[token]
                below = self.spine(halves[right], right)
                known = [*below[:-1], (below[-1][0], rank), (token, NEVER)]
            at[token] = known
        return known

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether merging a + b leaves the pair (a, b): no merge across the border comes before the merges that take
        in the parts beside it. Of equal ranks the leftmost merge comes first."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        xs, ys, i, j, known, rank = self.spine(a, True), self.spine(b, False), 0, 0, True, self.rank.get
        while True:
            (x, up_x), (y, up_y) = xs[i], ys[j]
            over = rank((x, y), NEVER)
            if over < up_x and over <= up_y and over < NEVER:
                known = False
                break
            if up_x == up_y == NEVER:
                break
            if up_x <= up_y:
                i += 1
            else:
                j += 1
        self.pairs[a, b] = known
        return known

    def reached(self, t: bytes) -> bool:
        """Whether merging a token's own bytes gives the token."""
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = t in self.vocab and self.merged(t) == [t]
        return known

    def prefixes(self, data: bytes) -> list[int]:
        """Token counts of all prefixes of a pre-token, the empty one first."""
        n = len(data)
        last: list[bytes] = [b""] * (n + 1)
        count = [0] * (n + 1)
        vocab, longest, pairs = self.vocab, self.longest, self.pairs
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = data[j:i]
                if t not in vocab:
                    continue
                fits = pairs.get((last[j], t)) if j else self.reached(t)
                if fits or fits is None and self.stable(last[j], t):
                    last[i], count[i] = t, count[j] + 1
                    break
        return count

    def parts(self, text: str):
        """(piece, is special) in order."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            yield text, False
            return
        at = 0
        for m in found:
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def read(self, text: str) -> list[Table]:
        """The prefix tables of the text's pre-tokens, in order; of a special token only the whole counts."""
        out, get = [], self.tables.__getitem__
        for piece, special in self.parts(text):
            out += [bytes([0, *[1] * len(piece.encode("utf-8", "surrogatepass"))])] if special else map(get, self.find(piece))
        return out

    def count(self, text: str) -> int:
        return sum([t[-1] for t in self.read(text)])

    def table(self, text: str) -> list[int]:
        """For every UTF-8 prefix length of the text, the tokens of the pre-tokens before it and the exact count of the part
        of its own pre-token."""
        out = [0]
        for t in self.read(text):
            base = out[-1]
            out += [base + c for c in t[1:]]
        return out

    @staticmethod
    def fit(tables: list[Table], budget: int) -> int:
        """The longest prefix length, in bytes, whose count stays within the budget: the pre-tokens before the one where the
        sum passes it, and of that one the longest part that fits."""
        at = used = 0
        for t in tables:
            if used + t[-1] > budget:
                return at + max(i for i, c in enumerate(t) if used + c <= budget)
            used += t[-1]
            at += len(t) - 1
        return at

    def fits(self, text: str, budget: int) -> int:
        return self.fit(self.read(text), budget)


@cache
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_fit (bytes of the longest prefix whose stored count is within the limit; it
    may end inside a character, whose tokens are bytes then).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids keep a row each. An empty table gives
    no rows. Narrow: one pass, no shuffle.
    """

    def rows(block: Block, c: PrefixCounter):
        n, fit, size = [], [], block.sizes()
        for text, b in zip(texts(block), size.tolist(), strict=True):
            tables = c.read(text)
            n.append(sum([t[-1] for t in tables]))
            fit.append(b if n[-1] <= limit else c.fit(tables, limit))
        return {"doc_id": block.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([k > limit for k in n], pa.bool_()), "n_fit": pa.array(fit, pa.int64())}

    named = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return map_blocks(named, ["doc_id", "text"], rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_fit long", lambda: counter(path, pattern))
