"""Live streams: counters, echoes up to an end token, running state, idempotent tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.scalars import END, block_index
from sluice.functions.text import lines
from sluice.operators import fanout
from sluice.operators.values import until_token
from sluice.sources.tables import cut, shared_folder


def counter(spark: SparkSession, n: int, token: bool = False) -> DataFrame:
    """Rows (pos, value) of a finite counter: 1 to n, and then the end token if it is wanted."""
    rows = spark.range(1, n + 1 + token)
    return rows.select(F.col("id").alias("pos"), F.when(F.col("id") > n, END).otherwise(F.col("id").cast("string")).alias("value"))


def feeder(spark: SparkSession, text: str, per_second: int = 1) -> DataFrame:
    """A stream (timestamp, value) that says a text again and again."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select("timestamp", F.lit(text).alias("value"))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """Runs a stream over all that is there now and returns what it put out; with a batch function it returns nothing."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if batch is not None:
        writer.foreachBatch(batch).start().awaitTermination()
        return None
    writer.outputMode(mode).format("parquet").option("path", f"{path}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream takes no path of one file


def folder_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, the oldest first, so many a batch: another program writes them, and none is read before it is asked for."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def echo_until(stream: DataFrame, pos: str, is_token: Column) -> DataFrame:
    """What a stream of messages gives before its first end token.

    The batch with the token ends the echo: nothing that comes after is written.
    Messages stand in the order of pos within a batch, and batches in theirs.
    """
    spark = stream.sparkSession
    path, ended, written = shared_path(spark, "echo"), [], []

    def put(rows: DataFrame, n: int) -> None:
        if ended:
            return
        kept = cut(rows)
        if not kept.where(is_token).isEmpty():
            ended.append(n)
        until_token(kept, pos, is_token).write.mode("overwrite").parquet(f"{path}/batch={n}")
        written.append(n)

    drained(stream, put)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={n}" for n in written]) if written else spark.createDataFrame([], stream.schema)


def first_message(messages: DataFrame, pos: str) -> DataFrame:
    """The one message that comes first, as one row; none of an empty stream."""
    return messages.orderBy(pos).limit(1)


def announced(stream: DataFrame, per_block: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (block, n_lines, n_chars, ready): the lines of a stream of texts cut into blocks of per_block, in the order of batches and then of keys.

    ready: the batch whose rows have filled the block, null for one that is not
    full yet.  Each batch is written as soon as it has come, with the number of
    lines before it; keys are unique whole numbers.
    """
    spark, path, before = stream.sparkSession, shared_path(stream.sparkSession, "blocks"), [0]

    def put(rows: DataFrame, n: int) -> None:
        whole = cut(rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")))
        counts = whole.select(key, F.size(lines(F.col("_text"))).cast("long").alias("n"))
        each = whole.join(fanout.offsets(counts, key, "n"), key).select("first", F.posexplode(lines(F.col("_text"))).alias("at", "line"))
        block = F.floor((F.lit(before[-1]) + F.col("first") + F.col("at")) / per_block).cast("long")
        told = each.groupBy(block.alias("block")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))
        told.write.mode("overwrite").parquet(f"{path}/batch={n}")
        before.append(before[-1] + (counts.agg(F.sum("n")).first()[0] or 0))

    drained(stream, put)
    found = spark.read.schema("block long, n_lines long, n_chars long, batch long").parquet(path)
    all_of = found.groupBy("block").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_chars").alias("n_chars"), F.max("batch").alias("last"))
    return all_of.select("block", "n_lines", "n_chars", F.when(F.col("n_lines") == per_block, F.col("last")).alias("ready"))


def running_state(stream: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Rows (key, n, total, over): the messages of each key and their sum, over all batches, and whether it is over the threshold.

    The state of a key is two numbers, kept by Spark from batch to batch; each
    batch replaces what the one before it told.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, "state")
    sums = stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total")).withColumn("over", F.col("total") > threshold)
    told: list[int] = []

    def tell(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{n}")
        told.append(n)

    query = sums.writeStream.outputMode("complete").option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True)
    query.foreachBatch(tell).start().awaitTermination()
    return spark.read.schema(sums.schema).parquet(f"{path}/{told[-1]}") if told else spark.createDataFrame([], sums.schema)


def with_side_input(stream: DataFrame, side: DataFrame, *keys: str) -> DataFrame:
    """Each message of a stream with the side input of its keys, null where there is none."""
    return stream.join(side, list(keys), "left")


def on_trigger(triggers: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `run` makes of each batch of a stream of triggers, all batches together."""
    spark, path = triggers.sparkSession, shared_path(triggers.sparkSession, "triggered")
    drained(triggers, lambda rows, n: run(rows).write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return spark.read.parquet(path).drop("batch")


def dispatched(paths: DataFrame, workers: int, column: str = "path") -> DataFrame:
    """Rows (path, idx, worker): the block files among paths, each with the worker it goes to; a batch or a stream."""
    idx = block_index(F.trim(column))
    return paths.where(idx.isNotNull()).select(F.trim(column).alias("path"), idx.alias("idx"), F.pmod(idx, F.lit(workers)).alias("worker"))


def dispatch_counts(paths: DataFrame, workers: int, column: str = "path") -> DataFrame:
    """Rows (worker, n): how many paths each worker gets; the skipped ones, of no block, have worker -1, and blank lines none."""
    idx = block_index(F.trim(column))
    named = paths.where(F.trim(column) != "").select(F.coalesce(F.pmod(idx, F.lit(workers)), F.lit(-1).cast("long")).alias("worker"))
    return named.groupBy("worker").agg(F.count("*").alias("n"))


def once(stream: DataFrame, path: str, key: str = "id") -> None:
    """Appends the rows of a stream whose key has no marker at path yet; running it again adds nothing."""

    def put(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        cut(fresh).write.mode("append").parquet(path)

    drained(stream, put)
