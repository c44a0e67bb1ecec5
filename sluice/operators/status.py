"""Status, elapsed times and dependency checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.units import elapsed_text, fixed_width

STATUSES = ("FINISHED", "IN-PROGRESS", "UNFINISHED_BUT_RUNNABLE", "UNFINISHED", "TO-DO")
#: What a program's status is told by.
ALL_FINISHED, SOME_IN_PROGRESS, SOME_UNFINISHED = 0, 2, 3


def elapsed(events: DataFrame, process: str, ts: str = "ts") -> DataFrame:
    """Rows (process, elapsed_us, elapsed): from the first to the last event of each process."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = events.groupBy(process).agg((F.max(micros) - F.min(micros)).alias("elapsed_us"))
    return span.withColumn("elapsed", elapsed_text(F.col("elapsed_us")))


def elapsed_tasks(events: DataFrame, process: str, task: str, ts: str = "ts") -> DataFrame:
    """Rows (process, elapsed, total_us): for each array the times of its tasks, as index->seconds, and their sum."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    each = events.groupBy(process, task).agg((F.max(micros) - F.min(micros)).alias("us"))
    listed = each.groupBy(process).agg(F.array_sort(F.collect_list(F.struct(task, "us"))).alias("all"), F.sum("us").alias("total_us"))
    one = lambda x: F.concat(x[task].cast("string"), F.lit("->"), elapsed_text(x["us"]), F.lit(" ;"))
    return listed.select(process, F.array_join(F.transform("all", one), " ").alias("elapsed"), "total_us")


def statistics(statuses: DataFrame, times: DataFrame, process: str = "process") -> DataFrame:
    """statuses with the elapsed time of each process; UNKNOWN where it has none or has finished nothing."""
    return statuses.join(times.select(process, "elapsed"), process, "left").withColumn("elapsed", F.coalesce("elapsed", F.lit("UNKNOWN")))


def counts(statuses: DataFrame, streams: DataFrame, marked: DataFrame, launchable: DataFrame) -> DataFrame:
    """One row: how many processes and streams a program has, how many processes run again, and how many can be launched."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(statuses, "n_processes"), n(streams, "n_streams"), n(marked, "n_rerun"), launchable.agg(F.countDistinct("process").alias("n_launchable"))]
    return reduce(lambda a, b: a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one"), parts)


def status_rows(statuses: DataFrame, width: int, excluded: tuple[str, ...] = (), process: str = "process") -> DataFrame:
    """One row (header, row): names and statuses in fixed width, by name, without the excluded processes.

    One program's processes are a bounded number of rows.
    """
    kept = statuses.where(~F.col(process).cast("string").isin(*excluded)) if excluded else statuses
    listed = kept.agg(F.array_sort(F.collect_list(F.struct(F.col(process).cast("string").alias("p"), "status"))).alias("all"))
    line = lambda f: F.array_join(F.transform("all", lambda x: fixed_width(f(x), width)), " ")
    return listed.select(line(lambda x: x["p"]).alias("header"), line(lambda x: x["status"]).alias("row"))


def status(launched: Column, live: Column, finished: Column, total: Column, runnable: Column) -> Column:
    """A process's status from its signals: launches, whether an id is alive, finished tasks of all tasks, and whether more may be launched."""
    return (
        F.when(launched == 0, "TO-DO")
        .when(live, "IN-PROGRESS")
        .when(finished >= total, "FINISHED")
        .when(runnable, "UNFINISHED_BUT_RUNNABLE")
        .otherwise("UNFINISHED")
    )


def exit_code(column: str = "status") -> Column:
    """0 if all have finished, 2 if any is in progress, else 3, as an aggregate."""
    all_done = F.bool_and(F.col(column) == "FINISHED")
    any_live = F.bool_or(F.col(column) == "IN-PROGRESS")
    return F.when(all_done, ALL_FINISHED).when(any_live, SOME_IN_PROGRESS).otherwise(SOME_UNFINISHED)


def summary(rows: DataFrame, column: str = "status") -> DataFrame:
    """Rows (status, n), one for each status that occurs."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def one_row(rows: DataFrame, width: int, column: str = "status") -> DataFrame:
    """One row: each status's count in fixed width, the whole percentage that has not finished, and the program's exit code."""
    counts = {s: F.count(F.when(F.col(column) == s, True)) for s in STATUSES}
    left = F.floor((F.count("*") - counts["FINISHED"]) * 100 / F.greatest(F.count("*"), F.lit(1))).cast("long")
    return rows.agg(*[fixed_width(n, width).alias(s.lower().replace("-", "_")) for s, n in counts.items()], left.alias("unfinished_percent"), exit_code(column).cast("int").alias("exit_code"))


def holds(kind: Column, state: Column) -> Column:
    """Whether a dependency of that kind on a process of that status is met."""
    return (
        F.when(kind == "none", True)
        .when(kind == "after", ~state.isin("TO-DO", "UNFINISHED"))
        .when(kind.isin("afterok", "aftercorr"), state == "FINISHED")
        .when(kind == "afternotok", state == "FAILED")
        .when(kind == "afterany", state.isin("FINISHED", "FAILED"))
        .otherwise(False)
    )


def dependency_check(deps: DataFrame, statuses: DataFrame) -> DataFrame:
    """Rows (consumer, conj, ready) of dependencies (consumer, producer, deptype, conj): AND wants all met, OR any; unknown producers are not met."""
    return ready(deps.join(statuses.select(F.col("process").alias("producer"), "status"), "producer", "left"))


def ready(deps: DataFrame) -> DataFrame:
    """Rows (consumer, conj, ready) of dependencies (consumer, deptype, conj, status) with the producer's status, null if it is unknown; repeated ones change nothing."""
    met = deps.withColumn("met", F.coalesce(holds(F.col("deptype"), F.col("status")), F.lit(False)))
    return met.groupBy("consumer", "conj").agg(F.bool_or("met").alias("any_met"), F.bool_and("met").alias("all_met")).select("consumer", "conj", F.when(F.col("conj") == "OR", F.col("any_met")).otherwise(F.col("all_met")).alias("ready"))
