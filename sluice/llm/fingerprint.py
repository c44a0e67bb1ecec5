"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its words; a term's weight S is 1 + ln(its count).  For
sample i each term has draws of its own, the same in all documents: r and c
from Gamma(2, 1) and b from Uniform(0, 1), made from hashes of the term and i.
With t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1), the term of least
a is sampled, and (term, t) is the i-th part of the signature.  Two documents
agree in a part with the probability sum(min S) / sum(max S), their generalised
Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import saved, whole_text

#: Parts of a signature; the share of equal parts has a standard error of 0.09 at most.
SAMPLES = 32
#: Documents dealt to one bucket, about, and the most buckets; their first keys pass through the driver.
BUCKET_ROWS, MOST_BUCKETS = 2000, 4096
#: Parts of a two-level search.
FAN = 64


def weighted_terms(texts: DataFrame, column: str, name: str) -> DataFrame:
    """texts and an array of (term, n) structs: the hash of each different word, and how often it stands in the text."""
    words = F.filter(F.split(column, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = texts.withColumn("_s", F.array_sort(F.transform(words, lambda w: F.xxhash64(w))))
    new = lambda i: (i == 1) | (F.element_at("_s", i) != F.element_at("_s", F.greatest(i - 1, F.lit(1))))
    starts = F.when(F.size("_s") > 0, F.filter(F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))), new)).otherwise(F.array().cast("array<int>"))
    runs = hashed.withColumn("_at", starts)
    ends = F.concat(F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(1))), F.array(F.size("_s") + 1))
    terms = F.zip_with("_at", F.slice(ends, F.lit(1), F.size("_at")), lambda a, b: F.struct(F.element_at("_s", a).alias("term"), (b - a).alias("n")))
    return runs.withColumn(name, terms).drop("_s", "_at")


def uniform(h: Column, shift: int) -> Column:
    """21 bits of a hash as a number above 0 and below 1."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << 21) - 1) + F.lit(0.5)) / F.lit(float(1 << 21))


def sample(term: Column, log_weight: Column, i: int) -> Column:
    """ln a of a term in sample i in the upper half of a bigint, and a hash of (term, t) in the lower: the least is the sampled one."""
    h, g = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    r = -F.ln(uniform(h, 0) * uniform(h, 21))
    c = -F.ln(uniform(h, 42) * uniform(g, 0))
    b = uniform(g, 21)
    t = F.floor(log_weight / r + b)
    a = F.ln(c) - r * (t - b + 1)
    scaled = F.floor((F.greatest(a, F.lit(-60.0)) + 60.0) * float(1 << 24)).cast("long")
    return F.shiftleft(scaled, 32).bitwiseOR((term.bitwiseXOR(t * 2654435761)).bitwiseAND(0xFFFFFFFF))


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """Rows (keys, sig): the signature of each group of rows (keys, term, n), null for a group whose only term is null."""
    weighed = terms.withColumn("_w", F.ln(1 + F.ln(F.col("n").cast("double"))))
    least = weighed.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("_w"), i)).alias(f"_{i}") for i in range(samples)])
    parts = F.array(*[F.col(f"_{i}").bitwiseAND(0xFFFFFFFF) for i in range(samples)])
    return least.select(*keys, F.when(F.col("_0").isNotNull(), parts).alias("sig"))


def written(sig: Column) -> Column:
    """A signature as a string: eight hex digits a part, empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal parts; 1 for two texts without words, 0 for one."""
    size = F.greatest(F.size(a), F.lit(1)).cast("double")
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / size)


def in_order(rows: DataFrame) -> DataFrame:
    """rows (doc_id, h, text) with a bucket: ranges of the order by doc_id, then h.  Each bucket ends with the first row of the next, marked extra."""
    keys = rows.select("doc_id", "h")
    count = keys.count()
    buckets = max(1, min(MOST_BUCKETS, -(-count // BUCKET_ROWS)))
    ranged = saved(keys.repartitionByRange(buckets, "doc_id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "h")).alias("first")))
    firsts = sorted((r["first"] for r in ranged.select("first").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    if not firsts:
        return rows.withColumns({"bucket": F.lit(0), "extra": F.lit(False)})
    kind = rows.schema["doc_id"].dataType
    as_struct = lambda x: F.struct(F.lit(x[0]).cast(kind).alias("doc_id"), F.lit(x[1]).cast("long").alias("h"))
    own = F.struct("doc_id", "h")
    fine = F.array(*map(as_struct, firsts))
    if len(firsts) <= FAN:
        bucket = F.size(F.filter(fine, lambda x: x <= own)) - 1
    else:
        coarse = F.size(F.filter(F.array(*map(as_struct, firsts[::FAN])), lambda x: x <= own)) - 1
        bucket = coarse * FAN + F.size(F.filter(F.slice(fine, coarse * FAN + 1, F.lit(FAN)), lambda x: x <= own)) - 1
    dealt = rows.withColumn("bucket", F.greatest(bucket, F.lit(0)))
    # At most MOST_BUCKETS keys, however many documents there are.
    heads = rows.sparkSession.createDataFrame([(x[0], x[1], (k - 1) % len(firsts)) for k, x in enumerate(firsts)], rows.select("doc_id", "h").withColumn("bucket", F.lit(0)).schema)
    same = rows["doc_id"].eqNullSafe(heads["doc_id"]) & (rows["h"] == heads["h"])
    extra = rows.join(F.broadcast(heads), same).select(rows["doc_id"], rows["h"], rows["text"], heads["bucket"]).dropDuplicates(["bucket"])
    return dealt.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, and the signature `sig` of its whole text; null for a text without words (null, empty or blank)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), whole_text(text_column).alias("text"))
    terms = weighted_terms(rows, "text", "terms").select("doc_id", "row", F.explode_outer("terms").alias("x")).select("doc_id", "row", "x.term", "x.n")
    return signatures(terms, ["doc_id", "row"], samples).select("doc_id", "sig")


def edit_likeness(docs: DataFrame, samples: int = SAMPLES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs, with the fingerprints of its text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many, or all, of the next document's: the next row by id, rows of
    one id by a hash of their texts; the first row follows the last.  A lone
    document follows itself.  Repeated rows are documents of their own, each
    followed by its copy.  Null ids come first.  Null texts count as empty.
    Further columns of docs are not read.  The texts move once, by ranges of the
    order; all that follows stays where they are.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text")).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("extra", "doc_id", "h")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    paired = in_order(rows).withColumns({"following": F.lead("text").over(order), "rn": F.row_number().over(order)})
    texts = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left(F.coalesce("following", F.lit("")), half)))
    known = texts.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    keys = ["bucket", "rn", "doc_id", "n_chars", "extra", "edited_sha256"]
    both = weighted_terms(weighted_terms(known, "text", "t0").drop("text", "following"), "edited", "t1").drop("edited")
    each = both.select(*keys, F.posexplode(F.array("t0", "t1")).alias("which", "terms"))
    terms = each.select(*keys, "which", F.explode_outer("terms").alias("x")).select(*keys, "which", "x.term", "x.n")
    sigs = signatures(terms, [*keys, "which"], samples)
    order = Window.partitionBy("bucket").orderBy("rn")
    pair = sigs.groupBy(*keys).agg(*[F.first(F.when(F.col("which") == k, F.col("sig")), ignorenulls=True).alias(f"s{k}") for k in (0, 1)])
    near = pair.withColumn("s2", F.lead("s0").over(order)).where("not extra")
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("s0")).alias("fingerprint"),
        written(F.col("s1")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1")).alias("near_edited"),
        likeness(F.col("s0"), F.col("s2")).alias("near_next"),
    )
