"""Bounded, repeatable training samples.

A classifier may be fitted on a bounded sample of labelled rows. The bound is a parameter; the choice depends on
nothing but a hash of the id, so it is the same on every run and every cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels that a classifier may tell apart.
MOST_LABELS = 2000


def remainder(id_col: str, parts: int):
    """crc32 of the id as text, modulo the number of folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(0))


def pick(rows: DataFrame, label: str, n: int, least: int = 20) -> DataFrame:
    """At most n rows (doc_id, label), every label with about the same number where it has enough; where n does not give
    `least` rows to each label, n grows until it does.

    One small aggregate counts the rows of each label (labels are languages or classes, MOST_LABELS at most); a threshold
    on the id's hash then thins the large labels, and an ordered limit holds the bound.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(MOST_LABELS + 2).collect() if r[0] is not None}
    if not counts:
        return rows.select("doc_id", label).limit(0)
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    n = max(n, least * len(counts))
    share = n / len(counts)
    u = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    part = F.lit(0.0)
    for value, c in counts.items():
        part = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, 1.05 * share / c))).otherwise(part)
    return rows.where(u < part).select("doc_id", label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
