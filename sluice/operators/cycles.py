"""Cycles of processes that pass a value round, one run for each row of a table; rows are independent of one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def two_process_cycle(rows: DataFrame, key: str, limit: Column) -> DataFrame:
    """Rows (key, step, sent, received): the first process sends a value from 1 on while it is at most `limit`, the second returns it plus 1."""
    each = rows.select(key, F.explode(F.when(limit >= 1, F.sequence(F.lit(1).cast("long"), limit.cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("sent"))
    return each.select(key, (F.col("sent") - 1).alias("step"), "sent", (F.col("sent") + 1).alias("received"))


def state_cycles(rows: DataFrame, key: str, start: Column, limit: Column, threshold: Column, steps: list[Callable[[Column], Column]], most: int) -> DataFrame:
    """Rows (key, step, sent, received, total): a value sent from `start` on while it is at most `limit`, and changed by one of two steps.

    The first step is taken while the sum of what has been returned is at most
    the threshold of the round, an array's entry or one number for all; each is a
    function of the value.  At most `most` rounds, which a greater need for
    raises an error.
    """
    spread = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)  # few files may hold many rows, each of which is a run of its own
    bound = (lambda s, i: F.get(s["threshold"], i)) if isinstance(rows.select(threshold.alias("t")).schema["t"].dataType, ArrayType) else (lambda s, i: s["threshold"])
    kind = "array<struct<step:bigint,sent:bigint,received:bigint,total:bigint>>"
    over = lambda s: s["v"] > s["limit"]

    def round_(state: Column, i: Column) -> Column:
        v, total = state["v"], state["total"]
        out = F.when(total <= bound(state, i), steps[0](v)).otherwise(steps[1](v)).cast("long")
        row = F.struct(i.cast("long").alias("step"), v.alias("sent"), out.alias("received"), (total + out).alias("total"))
        following = F.struct(out.alias("v"), (total + out).alias("total"), state["limit"].alias("limit"), state["threshold"].alias("threshold"), F.concat(state["rows"], F.array(row)).alias("rows"))
        return F.when(over(state), state).otherwise(following)

    def ended(state: Column) -> Column:
        return F.when(over(state), state["rows"]).otherwise(F.raise_error(F.lit(f"a cycle goes on after {most} rounds")).cast(kind))

    first = F.struct(start.cast("long").alias("v"), F.lit(0).cast("long").alias("total"), limit.cast("long").alias("limit"), threshold.alias("threshold"), F.array().cast(kind).alias("rows"))
    runs = F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), first, round_, ended)  # the limit and the thresholds ride along, so that they are computed once a run
    return spread.select(key, F.explode(runs).alias("r")).select(key, "r.*")


def triggered(triggers: DataFrame, pos: str, is_end: Column) -> DataFrame:
    """The triggers before the first end token, each of which starts a run."""
    first = triggers.where(is_end).agg(F.min(pos).alias("m")).scalar()
    return triggers.where(F.coalesce(F.col(pos) < first, F.lit(True)))
