"""The labelled rows that classifiers learn from, and a bounded sample of their texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_texts

#: Rows of the held-out fold: crc32 of doc_id as text, modulo FOLDS, is 0.
FOLDS = 5
#: Longest text of a sampled row, in characters: bounds the sample's memory, and rows with a longer text are no candidates. Scoring has no such bound.
SAMPLE_CHARS = 20_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def labelled_rows(labels: DataFrame, label: Column) -> DataFrame:
    """doc_id and its greatest label y, without the held-out fold and without nulls."""
    return labels.select("doc_id", label.cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: Column, per_class: int, classes: int, *more: str) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """Texts (doc_id, text and the columns of more), labels and weights of at most per_class rows of each class, in the order of a keyed hash of doc_id.

    The held-out fold takes no part; rows with a null label or doc_id neither; of several labels of one doc_id the greatest counts, and of its
    texts one. The weights give each class its share of all labelled rows.
    """
    rows = labelled_rows(labels, label)
    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect() if 0 <= r["y"] < classes}  # a row for each class
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    texts = with_texts(documents, *more).filter(F.length("text") <= SAMPLE_CHARS)
    there = rows.join(texts.select("doc_id"), "doc_id", "left_semi")
    parts = []
    for y in sorted(total):
        ids = there.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        # At most per_class ids: small enough to broadcast, whatever the corpus.
        parts.append(texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", *more, "y"))
    if not parts:
        return pa.array([], pa.struct([])), np.zeros(0, int), np.zeros(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    one = F.min(F.struct("text", *more)).alias("own")
    table = found.groupBy("doc_id", "y").agg(one).select("doc_id", "own.*", "y").toArrow().sort_by([("y", "ascending"), ("doc_id", "ascending")])
    y = table.column("y").to_numpy().astype(int)
    have = np.bincount(y, minlength=classes)
    weight = np.array([total.get(k, 0) / max(1, have[k]) for k in range(classes)])
    weight = weight[y] if len(y) else np.zeros(0)
    return table.to_struct_array().combine_chunks(), y, weight / weight.mean() if len(y) else weight
