"""Ports of processes: file paths, passed values, arguments, generated tasks, option documents and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.scalars import NO_FILE, NOT_FOUND, VOID, absolute, argument, is_value_reference
from sluice.functions.units import is_output


def file_ports(rows: DataFrame, value: str, files: DataFrame, folder: str, default: str | None = None, mandatory: bool = False) -> DataFrame:
    """rows with `path` and `state` of a file option: given, default, none (no file is wanted), or missing.

    files: the paths that exist.  Relative paths are below `folder`.  Without a
    value the default counts; if there is none, a mandatory option raises an
    error and another one is `none`.
    """
    given = F.coalesce(F.col(value), F.lit(default))
    if mandatory:
        given = F.coalesce(given, F.raise_error(F.lit(f"missing option {value}")).cast("string"))
    named = rows.withColumn("_given", given).withColumn("path", F.when(F.col("_given") != NO_FILE, absolute(F.col("_given"), F.lit(folder))))
    known = files.select(F.col("path").alias("_file")).distinct()
    state = F.when(F.col("path").isNull(), "none").when(F.col("_file").isNull(), "missing").when(F.col(value).isNull(), "default").otherwise("given")
    return named.join(known, F.col("path") == F.col("_file"), "left").withColumn("state", state).drop("_given", "_file")


def existing(ports: DataFrame) -> DataFrame:
    """The rows of file_ports(); a missing file raises an error."""
    fault = F.raise_error(F.concat(F.lit("no such file: "), F.col("path"))).cast("boolean")
    return ports.where(F.when(F.col("state") != "missing", True).otherwise(fault))


def with_arguments(rows: DataFrame, args: str, values: DataFrame, *options: str) -> DataFrame:
    """rows with a column for each option of an array of arguments, named without dashes.

    A path that stands for a passed value is replaced by the value, of values
    (path, value), but for output options; an unknown path stays.
    """
    names = {option: option.lstrip("-") for option in options}
    known = values.where(is_value_reference(F.col("path"))).select(F.col("path").alias("_path"), F.col("value").alias("_value"))
    other = F.concat(F.lit("no path "), F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]).cast("string"))  # spreads the values that are no path, which may all be alike
    out = rows.withColumns({name: argument(F.col(args), option) for option, name in names.items()} | {"_other": other})
    for name in names.values():
        if not name.startswith("out"):
            joined = out.withColumn("_wanted", F.when(is_value_reference(F.col(name)), F.col(name)).otherwise(F.col("_other"))).join(known, F.col("_wanted") == F.col("_path"), "left")
            out = joined.withColumn(name, F.coalesce("_value", name)).drop("_wanted", "_path", "_value")
    return out.drop("_other")


def written_values(rows: DataFrame, path: Column, value: Column) -> DataFrame:
    """Rows (path, value): values passed on under a path, of which the greatest stays if there are several."""
    return rows.groupBy(path.alias("path")).agg(F.max(value.cast("string")).alias("value"))


def generated(processes: DataFrame, size: Column, options: dict[str, Column], process: str = "process") -> DataFrame:
    """Rows (process, task_idx, opt, value): tasks 0 to size - 1 of each process, and each option's value made of its columns and task_idx."""
    tasks = processes.withColumn("task_idx", F.explode(F.when(size > 0, F.sequence(F.lit(0).cast("long"), size.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))))
    each = F.array(*[F.struct(F.lit(o).alias("opt"), v.cast("string").alias("value")) for o, v in options.items()])
    return tasks.select(process, "task_idx", F.explode(each).alias("x")).select(process, "task_idx", "x.opt", "x.value")


def found(value: Column) -> Column:
    """Whether an argument was given with a value."""
    return ~value.isin(NOT_FOUND, VOID)


def candidates(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The inputs (process, task_idx, opt, value) that may make a dependency: no output option, an absolute path, and some process puts it out."""
    usable = inputs.where(~is_output(F.col("opt")) & F.col("value").startswith("/"))
    return usable.join(outputs.select("value").distinct(), "value", "left_semi")


def output_index(outputs: DataFrame) -> DataFrame:
    """Rows (value, makers): for each value the tasks that put it out, as process:task in order."""
    label = F.struct("process", "task_idx")
    listed = outputs.groupBy("value").agg(F.array_sort(F.collect_set(label)).alias("all"))
    return listed.select("value", F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["process"].cast("string"), x["task_idx"].cast("string"))), ",").alias("makers"))


def array_sizes(options: DataFrame) -> DataFrame:
    """Rows (opt, process, n): how many tasks of a process have an option."""
    return options.groupBy("opt", "process").agg(F.count("*").alias("n"))


def documents(options: DataFrame) -> DataFrame:
    """Rows (process, document): the options (process, opt, kind, category, required, description) of each process as Markdown, by category and name."""
    line = F.concat(F.lit("- `"), F.col("opt"), F.lit("` "), F.col("kind"), F.when(F.col("required"), F.lit(" (required)")).otherwise(F.lit("")), F.lit(": "), F.col("description"))
    rows = options.select("process", F.struct("category", "opt", line.alias("line")).alias("x"))
    listed = rows.groupBy("process").agg(F.array_sort(F.collect_list("x")).alias("all"))
    first = lambda x, i: F.when((i == 0) | (F.get("all", i - 1)["category"] != x["category"]), F.concat(F.lit("### "), x["category"], F.lit("\n"))).otherwise(F.lit(""))
    body = F.array_join(F.transform("all", lambda x, i: F.concat(first(x, i), x["line"])), "\n")
    return listed.select("process", F.concat(F.lit("## "), F.col("process"), F.lit("\n"), body).alias("document"))


def run_table(samples: DataFrame, program: str, shared: str, options: str = "options", entry: str = "entry") -> DataFrame:
    """Rows (entry, command): one run of a program for each sample, with the sample's options and then those that all share."""
    return samples.select(entry, F.concat_ws(" ", F.lit(program), F.col(options), F.lit(shared)).alias("command"))
