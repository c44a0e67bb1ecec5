"""Sources and sinks: tables, text files by line, option files, and results cut off from their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line) of one text file, a directory or a glob."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def file_tasks(files: DataFrame) -> DataFrame:
    """One task for each file: rows (path, task_idx), from 0 in the order of paths.  files: a column path; one row a file is ordered."""
    from pyspark.sql import Window

    return files.select("path").distinct().withColumn("task_idx", F.row_number().over(Window.orderBy("path")) - 1)


def write_blocks(rows: DataFrame, path: str, block: int = 10_000) -> None:
    """Writes a table in files of at most `block` rows."""
    rows.write.option("maxRecordsPerFile", block).mode("overwrite").parquet(path)


def write_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def task_options(blocks: DataFrame, wanted: DataFrame, size: int = 10_000, process: str = "process", index: str = "task_idx") -> DataFrame:
    """The rows of blocks (process, block, place, ...) of the wanted tasks (process, task_idx): each is looked up in the one block that can hold it."""
    at = wanted.select(process, index, F.floor(F.col(index) / size).cast("long").alias("block"), F.pmod(F.col(index), F.lit(size)).cast("long").alias("place"))
    return at.join(blocks, [process, "block", "place"]).drop("block", "place")


def output_path(folder: str, process: str, task: int | None = None, base: str | None = None) -> str:
    """Where a process writes: below the program's folder by its own or a given name, tasks of an array apart."""
    own = f"{folder.rstrip('/')}/{base or process}"
    return own if task is None else f"{own}/task_idx={task}"


def shared_path(folder: str, name: str) -> str:
    """A folder that all processes of a program share."""
    return f"{folder.rstrip('/')}/__shared__/{name}"


def write_tasks(rows: DataFrame, path: str, index: str = "task_idx") -> None:
    """Writes an array's outputs by task; tasks that rows hold replace their earlier output, others keep theirs."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(index).parquet(path)


def mark_done(done: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """Adds the ids of fresh that are not among done's to the markers at path, once each, and returns those added."""
    added = cut(fresh.select("id").distinct().join(done.select("id"), "id", "left_anti"))
    added.write.mode("append").parquet(path)
    return added


def cut(df: DataFrame) -> DataFrame:
    """df, kept in the shared checkpoint folder: what follows never repeats the work before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sluice-"))
    return context.getCheckpointDir()
