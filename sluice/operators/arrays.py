"""Task arrays: indices, element-wise joins, what is still to do, blocks and throttles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def task_array(rows: DataFrame, process: str, *order: str) -> DataFrame:
    """rows with task_idx, from 0 in each process by the given order."""
    return rows.withColumn("task_idx", (F.row_number().over(Window.partitionBy(process).orderBy(*order)) - 1).cast("long"))


def task_zip(writers: DataFrame, readers: DataFrame, *keys: str) -> DataFrame:
    """Each writer's task with the reader's task of the same keys."""
    return writers.join(readers, list(keys))


def pending(tasks: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """The tasks without a marker among done."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def in_blocks(tasks: DataFrame, size: int, index: str = "task_idx") -> DataFrame:
    """tasks with the block of options that has their row, and its place there."""
    return tasks.withColumns({"block": F.floor(F.col(index) / size).cast("long"), "place": F.pmod(F.col(index), F.lit(size)).cast("long")})


def throttled(tasks: DataFrame, process: str, most: int, waiting: Column, index: str = "task_idx") -> DataFrame:
    """The first `most` waiting tasks of each process."""
    order = Window.partitionBy(process).orderBy(index)
    return tasks.where(waiting).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")


def finished_processes(events: DataFrame) -> DataFrame:
    """Rows (process, completed, total, finished) of task events (process, task_idx, kind, total)."""
    done = F.countDistinct(F.when(F.col("kind") == "finished", F.col("task_idx")))
    return events.groupBy("process").agg(done.alias("completed"), F.max("total").alias("total")).withColumn("finished", F.col("completed") == F.col("total"))


def executable(tasks: DataFrame, ready: DataFrame, unthrottled: int = 0) -> DataFrame:
    """The tasks (process, task_idx) that may be launched now, of tasks (process, task_idx, state, throttle) of ready processes (process).

    Waiting tasks, those to do or failed, by index, as many as the throttle
    leaves beside the running ones; all of them where it is `unthrottled`.
    """
    live = tasks.groupBy("process").agg(F.count(F.when(F.col("state") == "IN-PROGRESS", True)).alias("_live"))
    waiting = tasks.where(F.col("state").isin("TO-DO", "FAILED")).join(ready.select("process").distinct(), "process", "left_semi")
    order = Window.partitionBy("process").orderBy("task_idx")
    ranked = waiting.join(live, "process").withColumn("_rn", F.row_number().over(order))
    return ranked.where((F.col("throttle") == unthrottled) | (F.col("_rn") <= F.col("throttle") - F.col("_live"))).select("process", "task_idx")


def from_ranges(rows: DataFrame, elements: str, *keys: str) -> DataFrame:
    """Rows (keys, task_idx) of comma-separated indices and ranges, such as 1,4-6; each index once."""
    from sluice.functions.scalars import task_range

    each = rows.select(*keys, F.explode(F.split(elements, ",", -1)).alias("_e"))
    return each.select(*keys, F.explode(task_range(F.trim("_e"))).alias("task_idx")).distinct()
