"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold and give -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, columns: list[str], most_bytes: int, held_fold: int = 0) -> DataFrame:
    """At most ``per_class`` labelled documents of each class, in the order of a hash of the id: doc_id, text, columns, _label.

    Rows of the held-out fold, rows without a label and texts of over
    ``most_bytes`` bytes are left out before documents are chosen; an id labelled
    both ways counts as 1; of several rows with an id one is taken by hash.
    """
    small = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    known = known.where(fold() != held_fold).join(small.select("doc_id"), "doc_id", "left_semi")
    parts = [known.where(F.col("_label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # The right side has 2 * per_class rows at most, whatever the tables' sizes.
    few = small.select(F.col("doc_id"), F.struct(*dict.fromkeys(["text", *columns])).alias("_row")).join(F.broadcast(chosen), "doc_id")
    few = few.groupBy("doc_id", "_label").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return few.select("doc_id", "_row.*", "_label")
