"""Fan-out: lines cut into blocks, blocks dealt to workers, partial counts merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import lines
from sluice.operators.text import char_counts
from sluice.sources.tables import cut

#: Keys in a stretch: the running sum within one is one task's work.
STRETCH = 4096


def offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Rows (key, first): the sum of n over all smaller keys, for whole-number keys, each once.

    In levels, stretches of keys, then stretches of stretches, so no task ever
    sees more rows than a stretch has.
    """
    staged = counts.select(key, n).withColumn("_at", F.floor(F.col(key) / STRETCH))
    sums = cut(staged.groupBy("_at").agg(F.sum(n).alias("_n")))
    if sums.count() > STRETCH:
        bases = offsets(sums.withColumnsRenamed({"_at": key, "_n": n}), key, n).withColumnsRenamed({key: "_at", "first": "_base"})
    else:
        before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_at").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    running = staged.withColumn("_own", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return running.join(bases, "_at").select(key, (F.col("_base") + F.col("_own")).cast("long").alias("first"))


def fragment(docs: DataFrame, blocks: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line_no, line, block): all lines in the order of keys, in blocks of ceil(lines / blocks); keys are unique whole numbers."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counts = cut(docs.select(key, F.size(lines(whole)).cast("long").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    per_block = max(1, -(-total // blocks))
    placed = docs.select(key, whole.alias("_text")).join(offsets(counts, key, "n"), key)
    each = placed.select(key, "first", F.posexplode(lines(F.col("_text"))).alias("line_no", "line"))
    return each.select(key, F.col("line_no").cast("long").alias("line_no"), "line", F.floor((F.col("first") + F.col("line_no")) / per_block).cast("long").alias("block"))


def dispatch(rows: DataFrame, workers: int, block: str = "block") -> DataFrame:
    """rows with the worker of each block: its number modulo the number of workers."""
    return rows.withColumn("worker", F.pmod(F.col(block), F.lit(workers)))


def partial_counts(dealt: DataFrame) -> DataFrame:
    """Rows (worker, block, ch, n): each worker's counts of each of its blocks."""
    return char_counts(dealt, "line", "worker", "block")


def merge_counts(partial: DataFrame) -> DataFrame:
    """Rows (ch, n, n_blocks): the sums of partial counts, and in how many blocks the character occurs."""
    return partial.groupBy("ch").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("n_blocks"))
