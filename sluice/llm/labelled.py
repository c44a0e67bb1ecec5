"""Bounded samples of labelled documents, and folds of documents by id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import whole_text


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: dict[int, int]) -> tuple[pd.DataFrame, dict[int, int]]:
    """A sample of labelled texts (text, y), and how many learnable documents have each label.

    most: the bound on documents of each label; within it the documents of least
    hashed id are taken, so that a label of fewer documents is taken whole.
    Documents with null or contradicting labels are not learned from.  Only ids
    below the bound are broadcast and only their texts come to the driver.
    """
    agreed = labels.where(F.col(label).isin(list(most)) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2"))
    usable = agreed.where((F.col("y") == F.col("y2")) & learn).select("doc_id", "y")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    chosen = parts[0]
    for x in parts[1:]:
        chosen = chosen.unionByName(x)
    texts = docs.select("doc_id", whole_text("text").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y").toPandas()
    return found.sort_values("doc_id", ignore_index=True), counts
