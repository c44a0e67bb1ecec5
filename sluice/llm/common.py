"""Helpers shared by the operators: tables, intermediate results, column names and text that may be null."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sluice-"))
    return context.getCheckpointDir()


class Tables:
    """Intermediate tables of one run of an operator, in a folder of their own below the shared one, written and read by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and read again: what follows never repeats the work before it, and survives the loss of executors."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back from it.

    Cuts the lineage, so what follows never repeats the work before it, and
    survives the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_text(column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of docs has it, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: A sieve has two to the power of this many bits, a megabyte, whatever the input.
SIEVE_BITS = 23


def sifted(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose value of a column is wanted, and few others while the wanted are not many.

    What is broadcast has 2 ** SIEVE_BITS bits at most, whatever the input; a
    full sieve lets all rows through.
    """
    slot = F.shiftrightunsigned(F.xxhash64(column), 64 - SIEVE_BITS)
    word, bit = F.shiftright(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    table = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(table), "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_bits")


def once(value: Column) -> Column:
    """value as a generator of one row: Spark computes it once a row, however often what follows reads it."""
    return F.explode(F.array(value))
