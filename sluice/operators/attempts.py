"""Attempts of processes with growing resources, as dependencies between the runs of each attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attempt_runs(processes: DataFrame, n: Column, process: str = "process") -> DataFrame:
    """Rows (process, run, deptype, needs): attempt k waits for the failure of all before it; of several, `all_failed` runs if all have failed, and `some_passed` unless it has run.

    A row for each dependency, and one without for a run that waits for nothing.
    """
    name = lambda k: F.concat(F.lit("attempt"), k.cast("string"))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    attempts = processes.select(process, n.cast("int").alias("n")).where("n > 0")
    own = attempts.select(process, F.explode(upto(F.col("n"))).alias("k")).select(process, name(F.col("k")).alias("run"), F.explode_outer(upto(F.col("k") - 1)).alias("before"))
    checks = attempts.where("n > 1").select(process, F.lit("all_failed").alias("run"), F.explode(upto(F.col("n"))).alias("before"))
    waits = own.unionByName(checks).select(process, "run", F.when(F.col("before").isNotNull(), "afternotok").alias("deptype"), name(F.col("before")).alias("needs"))
    last = attempts.where("n > 1").select(process, F.lit("some_passed").alias("run"), F.lit("afternotok").alias("deptype"), F.lit("all_failed").alias("needs"))
    return waits.unionByName(last)


def task_attempts(runs: DataFrame, tasks: DataFrame, process: str = "process") -> DataFrame:
    """The runs of a process's tasks (process, task_idx), each waiting for the runs of its own index."""
    return runs.join(tasks.select(process, "task_idx"), process).select(process, "task_idx", "run", "deptype", "needs")
