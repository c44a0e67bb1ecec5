"""Text operators: decompose, recompose, character and word counts, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import characters, greedy_fill, lines, words


def decompose(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, pos, word): the words of each text with their place, from 0."""
    return docs.select(key, F.posexplode(words(F.col(text))).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


def recompose(docs: DataFrame, limit: int, extra_blank: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, filled): the words of each text laid out in lines of at most `limit` characters."""
    return docs.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("w")).select(key, greedy_fill(F.col("w"), limit, extra_blank).alias("filled"))


def char_counts(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """Rows (keys, ch, n): how often each character occurs; newlines are not counted.

    Each text gives a row for each of its different characters, whatever its length.
    """
    each = docs.select(*keys, F.col(text).alias("_text"), F.explode(F.array_distinct(characters(F.col(text)))).alias("ch"))
    own = F.length("_text") - F.length(F.replace("_text", F.col("ch"), F.lit("")))
    return each.select(*keys, "ch", own.cast("long").alias("n")).groupBy(*keys, "ch").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_lines, branch): totals of each text, and the branch that a text without words takes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.size(words(whole)).cast("long")
    return docs.select(key, n.alias("n_words"), (F.size(lines(whole)) - 1).cast("long").alias("n_lines"), F.when(n == 0, "empty").otherwise("text").alias("branch"))


def log_lines(docs: DataFrame, marks: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line_no, kind, line): the lines that hold a mark, once for each kind of mark."""
    each = docs.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    kinds = F.filter(F.array(*[F.when(F.contains("line", F.lit(m)), F.lit(kind)) for kind, m in marks.items()]), lambda x: x.isNotNull())
    return each.select(key, F.col("line_no").cast("long").alias("line_no"), F.explode(kinds).alias("kind"), "line")
