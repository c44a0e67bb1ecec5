"""From raw documents to token ids: quality, line dedup, near-copy dedup, mixing, encoding.

Each stage takes the rows that the one before has kept, written as Parquet in
the session's shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, lines, mixing, quality, simhash
from sluice.llm.common import free, shared_folder, table
from sluice.llm.queries import byte_bpe_path

#: Documents of a lower probability of good quality go.
LEAST_QUALITY = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject.

    Null and empty texts are scored like any other; rows of one id or one text
    are each judged by themselves.  An empty table gives an empty one.  Columns
    are passed on as they are, whatever their names.
    """
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    (score,) = free(docs, "score")
    return quality.with_score(docs, model, score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line is like; n_chars follows the text.

    Null texts stay null, with 0 characters; a text may become empty, and stays.
    Of lines that are alike the first by id and number stays, null ids first;
    equal rows stay equal.  An empty table gives an empty one.
    """
    kept = lines.without_repeats(docs)
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of similarity 0.8 or more.

    The one of least id stays, null ids last; of equal rows one.  Null texts and
    texts without words are one group.  An empty table gives an empty one.
    """
    return simhash.one_of_alike(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which each source keeps to its target weight.

    Null sources are a source of their own; null texts count as empty.  An empty
    table gives an empty one.  Columns are passed on, whatever their names.
    """
    return mixing.in_mixed_order(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document its place in the mix, its token ids, and a digest of the text that they decode to.

    The place is computed on this stage's rows, as it depends on ids, sources
    and texts only: rows that are written and read again have no order.  Null
    texts have no tokens and decode to the empty text; equal rows give equal
    ones.  An empty table gives an empty one; further columns are not read.
    """
    encoded = bpe.encode(mixing.mixed(docs.select("doc_id", "source", "text")), byte_bpe_path()).drop("text")
    both = bpe.decode(encoded, byte_bpe_path())
    return both.select(
        "doc_id",
        "source",
        "slot",
        "slot_rank",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", good_documents),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("mixing", mixed_sources),
    ("tokens", token_ids),
]

#: No SQL has the classifier, the schedule or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
