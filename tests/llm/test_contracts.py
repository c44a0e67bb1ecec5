"""Each numbered query over the small tables: its columns, one row for each input row, and nothing lost."""

from __future__ import annotations

import pytest

from sluice.llm.queries import QUERIES
from tests.llm.brute import brute_alike, brute_lines, brute_slots
from tests.llm.conftest import CLASHES

COLUMNS = {
    "op1_html": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op2_bpe": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op3_mixing": ("documents", ["doc_id", "source", "slot", "slot_rank"]),
    "op4_secrets": ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "op5_quality": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op7_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op8_simhash": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op9_lines": ("documents", ["doc_id", "n_lines", "n_kept", "removed"]),
    "op10_fingerprint": ("documents", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_a_row_for_each_row(spark, small, name):
    table, columns = COLUMNS[name]
    got = QUERIES[name](spark, small).toPandas()
    key = columns[0]
    assert set(columns) <= set(got.columns)
    want = spark.read.parquet(f"{small}/{table}.parquet").select(key).toPandas()[key]
    assert sorted(got[key]) == sorted(want)


def test_held_out_folds_and_scores(spark, small):
    import zlib

    for name, folds, held, least in (("op5_quality", 5, 0, 0.3), ("op7_toxicity", 3, 1, 0.7)):
        got = QUERIES[name](spark, small).toPandas()
        assert [zlib.crc32(str(i).encode()) % folds == held for i in got["doc_id"]] == list(got["held_out"])
        assert got["score"].between(0, 1).all() and list(got["predicted"]) == [int(s >= least) for s in got["score"]]


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, small)
        assert kept.columns == docs.columns
    done = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in done.select("doc_id").collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert 0 < done.count() <= docs.count()


def test_stages_on_odd_rows(spark, small, odd_documents, no_documents):
    import corpus_pipeline

    clashes = lambda rows: {tuple(r[c] for c in CLASHES) for r in rows.select(*CLASHES).collect()}
    docs, empty = odd_documents, no_documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, small), stage(spark, empty, small)
        assert docs.columns == odd_documents.columns and clashes(docs) == {tuple(range(len(CLASHES)))}, name
        assert empty.columns == no_documents.columns and empty.count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, small).count() == docs.count() > 0 and last(spark, empty, small).count() == 0


def test_pipeline_is_that_of_brute_force(spark, small):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    import corpus_pipeline
    from sluice.llm import mixing, quality
    from sluice.llm.queries import byte_bpe_path

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fitted(docs, labels)
    good = [d for d in rows if quality.scores([rows[d]["text"] or ""], model, {})[0] >= corpus_pipeline.LEAST_QUALITY]
    gone = brute_lines([(d, rows[d]["text"]) for d in good])
    texts = {d: rows[d]["text"] and "\n".join(x for k, x in enumerate(rows[d]["text"].split("\n")) if k not in gone.get(d, ())) for d in good}
    kept = brute_alike([*texts.items()])
    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert sorted(done) == kept
    usual = Tokenizer.from_file(byte_bpe_path())
    for d in kept:
        assert done[d]["ids"] == usual.encode(texts[d] or "", add_special_tokens=False).ids and done[d]["source"] == rows[d]["source"]
    sizes: dict = {}
    for d in kept:
        sizes[rows[d]["source"]] = sizes.get(rows[d]["source"], 0) + len(texts[d] or "") + 1
    want = brute_slots([(d, rows[d]["source"], done[d]["slot_rank"], len(texts[d] or "") + 1) for d in kept], {s: float(n) ** 0.5 for s, n in sizes.items()}, mixing.BLOCK_CHARS)
    assert {d: r["slot"] for d, r in done.items()} == want
    hashes = spark.createDataFrame([*texts.items()], "doc_id long, text string").select("doc_id", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(17)).alias("h"))
    assert {r["doc_id"]: r["h"] for r in hashes.collect() if r["doc_id"] in done} == {d: r["slot_rank"] for d, r in done.items()}


def test_pipeline_keeps_the_mix(spark, small):
    import corpus_pipeline
    from sluice.llm import mixing

    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('word ', 200) AS text", "CASE WHEN id % 5 = 0 THEN 'small' ELSE 'big' END AS source")
    got = corpus_pipeline.token_ids(spark, docs.repartition(7), small).toPandas()
    assert len(got) == 1000 and (got["n_tokens"] == got["ids"].map(len)).all()
    order = got.sort_values(["slot", "slot_rank"])["source"].to_numpy() == "small"
    # Weights are roots of sizes: one to two until the small source has run out.
    prefix = slice(0, max(order.nonzero()[0]))
    drift = 1001 * (order.cumsum() - (order.cumsum() + (~order).cumsum()) / 3)
    assert abs(drift[prefix]).max() <= mixing.BLOCK_CHARS + 2 * 1001
