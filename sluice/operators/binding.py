"""Parameter binding: mandatory, default and conditional options, flags, and references to other processes' outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.sources.tables import cut


@dataclass(frozen=True)
class Option:
    """How an option is bound: mandatory ones must be given, flags too; flags only say whether they are."""

    name: str
    mandatory: bool = False
    default: str | None = None
    flag: bool = False


def bound(given: Column, option: Option) -> Column:
    """The value of an option among the given ones, a map of strings."""
    missing = F.raise_error(F.concat(F.lit("missing option "), F.lit(option.name)))
    if option.flag:
        has = F.coalesce(F.map_contains_key(given, option.name), F.lit(False))
        return F.when(has, True).otherwise(missing.cast("boolean")) if option.mandatory else has
    value = F.try_element_at(given, F.lit(option.name))
    if option.mandatory:
        return F.coalesce(value, missing.cast("string"))
    return F.coalesce(value, F.lit(option.default)) if option.default is not None else value


def bind(rows: DataFrame, given: str, options: list[Option]) -> DataFrame:
    """rows with a column for each option, named after it."""
    return rows.withColumns({o.name: bound(F.col(given), o) for o in options})


def merged(*maps: Column) -> Column:
    """Option maps merged; later ones win."""
    first, *rest = maps
    if not rest:
        return first
    later = merged(*rest)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(later, k)), later)


def resolved(options: DataFrame, most: int = 64) -> DataFrame:
    """Options (process, task_idx, opt, value, ref_process, ref_task, ref_opt) with the references replaced by the values they lead to.

    Chains are followed link by link.  A reference to nothing, or a chain of
    over `most` links, which is a circle, raises an error.
    """
    keys = ["process", "task_idx", "opt"]
    values = cut(options.where("ref_process is null").select(*keys, "value"))
    waiting = cut(options.where("ref_process is not null").select(*keys, "ref_process", "ref_task", "ref_opt"))
    for _ in range(most):
        if waiting.isEmpty():
            return values
        known = values.select(F.col("process").alias("ref_process"), F.col("task_idx").alias("ref_task"), F.col("opt").alias("ref_opt"), "value")
        refs = ["ref_process", "ref_task", "ref_opt"]
        found = cut(waiting.join(known, refs).select(*keys, "value"))
        if found.isEmpty():
            break
        waiting = cut(waiting.join(known, refs, "left_anti"))
        values = cut(values.unionByName(found))
    if waiting.isEmpty():
        return values
    raise ValueError(f"unresolved references, such as {waiting.first().asDict()}")
