"""The operators applied to their whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, fingerprint, lines, mixing, quality, secrets, simhash, topk, toxicity, wrapper
from sluice.llm.common import table


def byte_bpe_path() -> str:
    """Where the public byte-level vocabulary of 50 thousand tokens is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and its length.  Null html gives an empty text."""
    found = wrapper.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids and the decoded text of every document.  Null texts have no tokens."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), byte_bpe_path())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix of all sources.  Null sources are one source."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "slot", "slot_rank")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document.  Null texts have none."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, null and empty texts too."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best products of every fiftieth vector with all others.  Unsound vectors take no part."""
    return topk.top_products(table(spark, sf_dir, "embeddings"), lambda x: x % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, null and empty texts too."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the group of every document.  Texts without words have fingerprint zero."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that an earlier line is like.  Null texts count as one empty line."""
    return lines.line_report(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness.  Null texts count as empty."""
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_lines": op9_lines,
    "op10_fingerprint": op10_fingerprint,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op4_secrets": secrets.oracle(), "op6_topk": topk.ORACLE, "op9_lines": lines.ORACLE}
