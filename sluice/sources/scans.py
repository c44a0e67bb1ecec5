"""Lines of specification, option, stream, status and selection files as rows; lines that make no sense raise an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.scalars import ELEM_SEP, deserialised, fields


def require(rows: DataFrame, test: Column, message: Column) -> DataFrame:
    """rows; the first one that fails the test raises the message."""
    return rows.where(F.when(test, True).otherwise(F.raise_error(message).cast("boolean")))


def entries(lines: DataFrame, column: str = "line") -> DataFrame:
    """The lines that are neither blank nor comments, which begin with #."""
    first = F.get(fields(F.col(column)), F.lit(0))
    return lines.where(first.isNotNull() & ~first.startswith("#"))


def option_rows(rows: DataFrame, args: str, *keys: str) -> DataFrame:
    """Rows (keys, opt, value) of an array of arguments: each option with what follows it, empty if that is an option or nothing; the last of an option counts.

    An argument that follows no option raises an error, but for the mark of a
    shortened array.
    """
    each = rows.select(*keys, F.col(args).alias("_args"), F.posexplode(args).alias("at", "arg"))
    before, after = F.get("_args", F.col("at") - 1), F.get("_args", F.col("at") + 1)
    option = F.col("arg").startswith("-")
    sound = option | F.coalesce(before.startswith("-"), F.lit(False)) | (F.col("arg") == "...")
    kept = require(each.withColumns({"value": F.when(after.startswith("-"), "").otherwise(F.coalesce(after, F.lit(""))), "_sound": sound}), F.col("_sound"), F.concat(F.lit("unexpected token "), F.col("arg")))
    options = kept.where(F.col("arg").startswith("-"))
    return options.groupBy(*keys, F.col("arg").alias("opt")).agg(F.max_by("value", "at").alias("value"))


def option_file(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows (process, task_idx, opt, value) of lines `PROCESS: p ; OPTIONS: -a x -b y ||| -a z`.

    Blank lines are left out.  Other lines, and a process with two lines, raise
    an error.  A task without options has no row.
    """
    line = F.trim(column)
    kept = lines.where(line != "").select(line.alias("line"))
    name = F.regexp_extract("line", r"^PROCESS:\s*([^;]*?)\s*;\s*OPTIONS:", 1)
    named = require(kept.withColumn("process", name), F.col("process") != "", F.concat(F.lit("malformed line "), F.col("line")))
    once = named.groupBy("process").agg(F.min("line").alias("line"), F.count("*").alias("times"))
    single = require(once, F.col("times") == 1, F.concat(F.lit("duplicate process "), F.col("process")))
    tasks = single.select("process", F.posexplode(F.split(F.regexp_replace("line", r"^PROCESS:[^;]*;\s*OPTIONS:", ""), r"\|\|\|", -1)).alias("task_idx", "chunk"))
    return option_rows(tasks.select("process", F.col("task_idx").cast("long").alias("task_idx"), fields(F.col("chunk")).alias("args")), "args", "process", "task_idx")


def task_of(label: Column) -> tuple[Column, Column]:
    """The process and the task index of a label `process__ELEMSEP__index`; the index is null where it is no number."""
    return F.substring_index(label, ELEM_SEP, 1), F.substring_index(label, ELEM_SEP, -1).try_cast("long")


def exhaustive_options(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows (process, task_idx, args) of lines `process__ELEMSEP__index -> arguments`; lines that state a length are left out."""
    words = F.split(column, r"\s+", 3)
    process, index = task_of(F.get(words, F.lit(0)))
    rows = lines.select(process.alias("process"), index.alias("task_idx"), deserialised(F.regexp_replace(F.coalesce(F.get(words, F.lit(2)), F.lit("")), r"\s", "")).alias("args"))
    return rows.where("task_idx is not null")


def output_values(options: DataFrame) -> DataFrame:
    """Rows (value, process, task_idx, opt): the absolute paths that stand behind an output option among args."""
    each = options.select("process", "task_idx", "args", F.posexplode("args").alias("at", "value"))
    opt = F.get("args", F.col("at") - 1)
    return each.withColumn("opt", opt).where(F.col("value").startswith("/") & (F.col("opt").startswith("-out") | F.col("opt").startswith("--out"))).select("value", "process", "task_idx", "opt")


def stream_file(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows (stream, owner, owner_task, user, user_task) of lines `name owner__ELEMSEP__i user__ELEMSEP__j`; of lines of one stream the last counts.  lines: lineno, line."""
    words = fields(F.col(column))
    owner, user = task_of(F.get(words, F.lit(1))), task_of(F.get(words, F.lit(2)))
    rows = lines.select("lineno", F.get(words, F.lit(0)).alias("stream"), owner[0].alias("owner"), owner[1].alias("owner_task"), user[0].alias("user"), user[1].alias("user_task"))
    names = ["owner", "owner_task", "user", "user_task"]
    return rows.where("stream is not null").groupBy("stream").agg(F.max_by(F.struct(*names), "lineno").alias("x")).select("stream", *[f"x.{n}" for n in names])


def status_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows (process, status) of lines `PROCESS: p ; STATUS: s`; other lines are left out."""
    words = fields(F.col(column))
    return lines.where(F.get(words, F.lit(0)) == "PROCESS:").select(F.get(words, F.lit(1)).alias("process"), F.get(words, F.lit(4)).alias("status"))


def selection_items(lines: DataFrame, capacities: int, column: str = "line") -> DataFrame:
    """Rows (item, value, weights) of lines `id value w1 w2 ...`; blank lines are left out."""
    words = fields(F.col(column))
    weights = F.array(*[F.get(words, F.lit(2 + k)).cast("double") for k in range(capacities)])
    return lines.where(F.size(words) > 0).select(F.get(words, F.lit(0)).alias("item"), F.get(words, F.lit(1)).cast("double").alias("value"), weights.alias("weights"))


def selection_deps(lines: DataFrame, items: DataFrame, column: str = "line") -> DataFrame:
    """Rows (successor, predecessor, state) of lines `successor predecessor`: kept, unknown_successor, or done where only the predecessor is unknown."""
    words = fields(F.col(column))
    pairs = lines.where(F.size(words) > 1).select(F.get(words, F.lit(0)).alias("successor"), F.get(words, F.lit(1)).alias("predecessor"))
    known = items.select("item").distinct()
    a, b = known.select(F.col("item").alias("successor"), F.lit(True).alias("_a")), known.select(F.col("item").alias("predecessor"), F.lit(True).alias("_b"))
    state = F.when(F.col("_a").isNull(), "unknown_successor").when(F.col("_b").isNull(), "done").otherwise("kept")
    return pairs.join(a, "successor", "left").join(b, "predecessor", "left").select("successor", "predecessor", state.alias("state"))


def nth_line(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line): line n of each text, from 1; null beyond its end."""
    return docs.select(key, F.get(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), F.lit(n - 1)).alias("line"))


def random_lines(keys: DataFrame, width: int, seed: int, key: str = "line_no") -> DataFrame:
    """Rows (key, line): for each key a line of `width` characters that depends on key and seed alone."""
    pieces = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(str(k)))) for k in range(-(-width // 32))]
    return keys.select(key, F.substring(F.concat(*pieces), 1, width).alias("line"))
