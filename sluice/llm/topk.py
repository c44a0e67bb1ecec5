"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, and buckets into blocks of bounded
size.  Each query first meets the longest vectors, which gives it a score that
its k-th best cannot be below.  For every other bucket that score becomes a
threshold on the cosine: above 1 the bucket is skipped; high, and coordinates
prune candidates; low, and their lengths do.  What is left is verified by the
integer inner product.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import saved

#: Candidates in a block and queries in a block: what one task holds at once.
BLOCK, QUERIES = 8192, 4096
#: Buckets for each doubling of the length.
STEPS = 4
#: Cosine thresholds from which coordinates prune better than lengths, and the coordinates looked at.
STEEP, FOCUS = 0.6, 3
#: Slack against rounding in the pruning tests, which only ever keeps more.
SLACK = 1e-9
#: Scores below this are exact in double arithmetic.
EXACT = float(1 << 52)
#: Scores are longs; what is beyond is clipped.
MOST = (1 << 63) - 1

FOUND = "query_id long, query_copy int, vec_id long, copy int, score long"


def whole_vectors(vectors: DataFrame, scale: int, id_column: str, column: str) -> DataFrame:
    """Rows (vec_id, copy, v, norm): components floor(scale * x), the number of the row among those of one id, and the length.

    Vectors that are null or empty, hold null or non-finite components, or have
    a null id take no part.
    """
    x = F.col(column).cast("array<double>")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.when(sound, whole).alias("v")).where("vec_id is not null and v is not null")
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.xxhash64("v"))).cast("int")
    return rows.select("vec_id", copy.alias("copy"), "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("norm"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(rows), width))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of each row of q with each of c, exact whatever their size."""
    if bound < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    full = whole(q) @ whole(c).T
    return np.vectorize(lambda x: max(-MOST - 1, min(MOST, x)), otypes=[np.int64])(full) if full.size else np.zeros(full.shape, np.int64)


def kept_by_coordinates(q: np.ndarray, unit: np.ndarray, least: float) -> np.ndarray:
    """Rows of unit vectors that can have a cosine of `least` with the unit query: each coordinate confines the others' product."""
    keep = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        x = unit[:, f]
        keep &= (x * q[f] + np.sqrt(np.maximum(0.0, 1 - x * x)) * math.sqrt(max(0.0, 1 - q[f] * q[f])) >= least - SLACK) & np.isfinite(x)
    return keep


def best_of_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of a block for each query, of those that can reach the query's known score."""
    queries = queries.rename(columns={"qid": "vec_id", "qcopy": "copy", "qv": "v", "qnorm": "norm"})
    width = max(max(map(len, queries["v"])), max(map(len, block["v"])))
    block = block.sort_values("norm", ascending=False, ignore_index=True)
    q, c = matrix(queries["v"], width), matrix(block["v"], width)
    norms, lengths = block["norm"].to_numpy(), queries["norm"].to_numpy()
    ids, copies = block["vec_id"].to_numpy(), block["copy"].to_numpy()
    qid, qcopy, known = queries["vec_id"].to_numpy(), queries["copy"].to_numpy(), queries["known"].to_numpy(float)
    unit = c / np.maximum(norms, 1e-300)[:, None]
    found = []

    def take(i: int, scores: np.ndarray, at: np.ndarray) -> None:
        other = (ids[at] != qid[i]) | (copies[at] != qcopy[i])
        at, scores = at[other], scores[other]
        good = scores >= known[i] if known[i] > -math.inf else np.ones(len(at), bool)
        at, scores = at[good], scores[good]
        order = np.lexsort((copies[at], ids[at], ~scores))[:k]  # ~ turns the order of whole numbers round
        found.extend((int(qid[i]), int(qcopy[i]), v, n, s) for v, n, s in zip(ids[at[order]].tolist(), copies[at[order]].tolist(), scores[order].tolist(), strict=True))

    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.where(lengths * norms[0] > 0, known / (lengths * norms[0]), np.where(known > 0, math.inf, -math.inf))
    plain = np.flatnonzero(cosine < STEEP)
    if len(plain):
        # Length pruning: candidates stand by falling length, so each query needs a prefix of them.
        needed = np.array([len(norms) if known[i] <= 0 or lengths[i] == 0 else np.searchsorted(-norms, -(known[i] / lengths[i]) * (1 - SLACK), "right") for i in plain])
        scores = products(q[plain], c[: needed.max()], float(lengths[plain].max() * norms[0]))
        for row, i in enumerate(plain):
            take(i, scores[row, : needed[row]], np.arange(needed[row]))
    for i in np.flatnonzero((cosine >= STEEP) & (cosine <= 1 + SLACK)):
        at = np.flatnonzero(kept_by_coordinates(q[i] / lengths[i], unit, min(1.0, float(cosine[i]))))
        if len(at):
            take(i, products(q[i : i + 1], c[at], float(lengths[i] * norms[0]))[0], at)
    return pd.DataFrame(found, columns=["query_id", "query_copy", "vec_id", "copy", "score"])


def matched(queries: DataFrame, blocks: DataFrame, places: DataFrame, parts: int, k: int) -> DataFrame:
    """The best of each query in each of the blocks that it is sent to, query block by candidate block.

    places: rows (bucket, chunk, longest), one for each candidate block; a pair
    of a query block and a candidate block is one group, of bounded size.  Which
    pairs can matter is told by the lengths and known scores of each
    query block, before any vector moves: blocks that no query can use are not
    copied.
    """
    reach = F.when(F.col("known").isNull() | (F.col("known") <= 0), float("inf")).otherwise(F.col("qnorm") / F.col("known"))
    far = queries.groupBy("part").agg(F.max(reach).alias("reach"))
    # One row for each pair of blocks: their numbers are those of rows over thousands.
    each = places.select("bucket", "chunk", "longest", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    pairs = saved(each.join(far, "part").where(F.col("reach") * F.col("longest") * (1 + 1e-9) >= 1).drop("reach"))
    asked = queries.join(pairs, "part").where("known is null or known <= qnorm * longest * (1 + 1e-9)")
    asked = asked.withColumn("known", F.coalesce(F.col("known").cast("double"), F.lit(float("-inf"))))
    dealt = blocks.join(pairs.drop("longest"), ["bucket", "chunk"])

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("query_id", "query_copy", "vec_id", "copy", "score")})
        return best_of_block(q, c, k)

    keys = ["bucket", "chunk", "part"]
    return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(compare, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "copy")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Callable, k: int = 5, scale: int = 256, id_column: str = "vec_id", column: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """For each query row the k best other rows by integer inner product: query_id, rank (from 1), vec_id, score.

    is_query: a condition on the column of ids.  Ties go to the smaller id; a
    query's own row is no candidate, but another row of its id is.  Vectors of
    different lengths are compared as if the shorter ended in zeros.  Rows with
    a null id, a null or empty vector, or a null or non-finite component take
    no part; neither do further columns.  Fewer than k candidates give fewer
    rows, an empty table none.  Scores beyond a long are clipped.
    """
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(F.lit(-(1 << 20))).cast("int")
    rows = saved(whole_vectors(vectors, scale, id_column, column).withColumn("bucket", bucket))
    # One row for each quarter of a doubling of the length: bounded by the range of a double.
    sizes = sorted(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect(), key=lambda r: -r["bucket"])
    session = vectors.sparkSession
    shape = "bucket int, chunk int, longest double"
    chunks = {r["bucket"]: -(-r["n"] // block) for r in sizes}
    seeds, rest, have = [], [], 0
    for r in sizes:
        first = 0
        if have <= k:
            seeds.append((r["bucket"], 0, r["longest"]))
            have += r["n"] // chunks[r["bucket"]] // 2 + (chunks[r["bucket"]] == 1) * r["n"]
            first = 1
        rest.append((r["bucket"], first, chunks[r["bucket"]], r["longest"]))
    spread = session.createDataFrame(rest, "bucket int, low int, high int, longest double").where("low < high")
    others = spread.select("bucket", F.explode(F.expr("sequence(low, high - 1)")).alias("chunk"), "longest")
    many = F.create_map(*[F.lit(x) for b, n in chunks.items() for x in (b, n)]) if chunks else F.create_map(F.lit(0), F.lit(1))
    blocks = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "copy"), many[F.col("bucket")].cast("long")).cast("int"))
    asked = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("qid"), F.col("copy").alias("qcopy"), F.col("v").alias("qv"), F.col("norm").alias("qnorm"))
    parts = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("qid", "qcopy", F.lit("query")), F.lit(parts)).cast("int"))
    first = saved(best(matched(asked.withColumn("known", F.lit(None).cast("long")), blocks, session.createDataFrame(seeds, shape), parts, k), k))
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("query_copy").alias("qcopy"), F.col("score").alias("known"))
    second = matched(asked.join(known, ["qid", "qcopy"], "left"), blocks, others, parts, k)
    both = first.drop("rank").unionByName(second)
    return best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB SQL with the rows of top_products over the table embeddings, for ids divisible by 50.
ORACLE = """
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM e WHERE vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
