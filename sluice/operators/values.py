"""Values passed between processes, conditional skips, cycles, and streams up to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def passed(values: DataFrame, value: str, skip: Column, step: Column) -> DataFrame:
    """values with the consumer's status and result: a skipped consumer has not finished and has no result."""
    return values.withColumns({"status": F.when(skip, "UNFINISHED").otherwise("FINISHED"), "result": F.when(~skip, step)})


def state_cycle(spark: SparkSession, limit: int, threshold: int, most: int = 100_000) -> DataFrame:
    """Rows (step, v, total): a value sent round two processes while it is at most `limit`.

    The second adds 1 while the sum of what it has seen is at most the
    threshold, and 2 after that.
    """
    return spark.sql(cycle_sql(limit, threshold, f" MAX RECURSION LEVEL {most}"))


def cycle_sql(limit: int, threshold: int, bound: str = "") -> str:
    return f"""
    WITH RECURSIVE t(step, v, total){bound} AS (
      SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
      UNION ALL
      SELECT step + 1, CASE WHEN total <= {threshold} THEN v + 1 ELSE v + 2 END, total + v
      FROM t WHERE (CASE WHEN total <= {threshold} THEN v + 1 ELSE v + 2 END) <= {limit})
    SELECT step, v, total FROM t"""


def until_token(messages: DataFrame, pos: str, is_token: Column) -> DataFrame:
    """The messages before the first end token; all of them if there is none."""
    first = messages.where(is_token).agg(F.min(pos).alias("m")).scalar()
    return messages.where(F.coalesce(F.col(pos) < first, F.lit(True)))


def with_place(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place, from 1, in a sorted result that is a bounded number of rows, such as counts by character."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
