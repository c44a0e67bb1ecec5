"""Incremental recomputation: what changed since the last run, and what has to run again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.graph import reached
from sluice.sources.tables import cut


def option_diff(old: DataFrame, new: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Rows (keys, change): new, removed, changed or unchanged, of two snapshots with a value for each key."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, list(keys), "full_outer")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def array_diff(old: DataFrame, new: DataFrame, id_option: str = "-id") -> DataFrame:
    """Rows (process, change) of two snapshots of options (process, task_idx, opt, value): new, removed, changed or unchanged.

    A task is known by its id option, or by its index without one; of tasks of
    one id the last counts.  A process has changed if its tasks differ in
    number, in name, or in any option.
    """

    def tasks(options: DataFrame, side: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("opt", "value")))
        own = F.max(F.when(F.col("opt") == id_option, F.concat(F.lit("id "), F.col("value"))))
        each = options.groupBy("process", "task_idx").agg(pairs.alias("all"), F.coalesce(own, F.concat(F.lit("at "), F.col("task_idx").cast("string"))).alias("task"))
        counts = each.groupBy("process").agg(F.count("*").alias(f"{side}_n"))
        last = each.groupBy("process", "task").agg(F.max_by("all", "task_idx").alias(side))
        return last.join(counts, "process")

    both = tasks(old, "old").join(tasks(new, "new"), ["process", "task"], "full_outer")
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False)) & (F.col("old_n") == F.col("new_n"))
    judged = both.groupBy("process").agg(F.count("old").alias("was"), F.count("new").alias("is"), F.bool_and(same).alias("same"))
    change = F.when(F.col("was") == 0, "new").when(F.col("is") == 0, "removed").when(F.col("same"), "unchanged").otherwise("changed")
    return judged.select("process", change.alias("change"))


def changed_seeds(diff: DataFrame) -> dict[str, DataFrame]:
    """The marks of a diff (process, change): new processes, and those whose input changed."""
    return {reason: diff.where(F.col("change") == change).select(F.col("process").alias("node")) for reason, change in (("new_process", "new"), ("input_change", "changed"))}


def diff_lists(diff: DataFrame, most: int = 10) -> DataFrame:
    """Rows (change, n, processes): how many processes a diff has of each kind, and the first `most` in order, then three dots if there are more."""
    order = Window.partitionBy("change").orderBy("process")
    first = diff.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most)
    named = first.groupBy("change").agg(F.array_sort(F.collect_list("process")).alias("all"))
    both = diff.groupBy("change").agg(F.count("*").alias("n")).join(named, "change")
    shown = F.concat(F.transform("all", lambda x: x.cast("string")), F.when(F.col("n") > most, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")))
    return both.select("change", "n", F.array_join(shown, ",").alias("processes"))


def outdated(processes: DataFrame, modules: DataFrame) -> DataFrame:
    """The finished processes (node) that last ran before a change of their modules, or left no trace.

    processes: (process, module, status, ran_at); modules: (module, changed_at).
    """
    newest = modules.groupBy("module").agg(F.max("changed_at").alias("changed_at"))
    old = processes.where("status = 'FINISHED'").join(newest, "module", "left")
    return old.where("ran_at is null or ran_at < changed_at").select(F.col("process").alias("node")).distinct()


def rerun(marks: dict[str, DataFrame], dependencies: DataFrame, streams: DataFrame) -> DataFrame:
    """Rows (node, reasons) of all processes to run again: by the marks themselves, and by what passes them on.

    A process has the reason propagate_dependencies if one of its producers runs
    again, and propagate_fifo if the other end of one of its streams does.
    """
    first = cut(reduce(DataFrame.unionByName, [df.select("node", F.lit(reason).alias("reason")) for reason, df in marks.items()]).distinct())
    all_marked = cut(to_rerun(first.select("node").distinct(), dependencies, streams))
    down = dependencies.select(F.col("producer").alias("node"), F.col("consumer").alias("to"), F.lit("propagate_dependencies").alias("reason"))
    there = streams.select(F.col("owner").alias("node"), F.col("user").alias("to"), F.lit("propagate_fifo").alias("reason"))
    back = streams.select(F.col("user").alias("node"), F.col("owner").alias("to"), F.lit("propagate_fifo").alias("reason"))
    passed = down.unionByName(there).unionByName(back).join(all_marked, "node").select(F.col("to").alias("node"), "reason").distinct()
    return first.unionByName(passed).groupBy("node").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def reset(statuses: DataFrame, marked: DataFrame) -> DataFrame:
    """statuses (process, status) once the completion of the marked (node) is taken back."""
    hit = marked.select(F.col("node").alias("process"), F.lit(True).alias("_hit")).distinct()
    both = statuses.join(hit, "process", "left")
    return both.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "FINISHED"), "TO-DO").otherwise(F.col("status"))).drop("_hit")


def to_rerun(seeds: DataFrame, dependencies: DataFrame, streams: DataFrame) -> DataFrame:
    """The processes to run again: marks pass from producers to consumers, and both ways over streams, until none is new.

    seeds: (node); dependencies: (producer, consumer); streams: (owner, user).
    """
    down = dependencies.select(F.col("producer").alias("node"), F.col("consumer").alias("following"))
    there = streams.select(F.col("owner").alias("node"), F.col("user").alias("following"))
    back = streams.select(F.col("user").alias("node"), F.col("owner").alias("following"))
    return reached(seeds, down.unionByName(there).unionByName(back))


def half_finished_streams(streams: DataFrame, finished: DataFrame) -> DataFrame:
    """The ends (node) of streams of which just one end has finished: both have to run again."""
    done = finished.select("process").distinct().withColumn("done", F.lit(True))
    a, b = done.select(F.col("process").alias("owner"), F.col("done").alias("a")), done.select(F.col("process").alias("user"), F.col("done").alias("b"))
    odd = streams.join(a, "owner", "left").join(b, "user", "left").where("a is null and b or a and b is null")
    return odd.select(F.explode(F.array("owner", "user")).alias("node")).distinct()


def reasons(marks: dict[str, DataFrame]) -> DataFrame:
    """Rows (node, reasons): why each process runs again, of marks by reason."""
    each = [df.select("node", F.lit(reason).alias("reason")) for reason, df in marks.items()]
    return reduce(DataFrame.unionByName, each).groupBy("node").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
