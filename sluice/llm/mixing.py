"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a shuffled order, are cut into blocks of about
`block_chars` characters.  Block k of a source of weight w may not start before
slot floor(k / w) and must be done by slot ceil((k + 1) / w); earliest deadline
first among the released blocks then keeps every source within less than one
block of its share at every slot.  The driver schedules the blocks of all
sources, at most BLOCKS and one a source, from the exact weights; no job walks
through documents one after another.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import free, saved, whole_text

#: Slots of a period of `shares`.
PERIOD = 1000
BLOCK_CHARS = 50_000
#: Blocks that the driver schedules at most, besides one for each source; beyond 50 GB blocks get larger.
BLOCKS = 1 << 20
#: Documents of a source whose running sum is one task's work, about.
RUN = 1000


def shares(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole parts of a period for each source, at least one each, by largest remainder.

    The period grows to the number of sources if there are more sources than
    slots.  Weights must be positive.
    """
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    period = max(period, len(weights))
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (exact[s] - parts[s], s is not None, s or ""))
    while (left := period - sum(parts.values())) != 0:
        if left > 0:
            for s in order[::-1][:left]:
                parts[s] += 1
        else:
            for s in [x for x in order if parts[x] > 1][:-left]:
                parts[s] -= 1
    return parts


def slots_of(weights: dict[str | None, float], blocks: dict[str | None, int]) -> dict[str | None, list[int]]:
    """For each source the places of its blocks in the order of all blocks: earliest deadline first among the released ones, ties by name.

    Weights are taken as they are, as fractions of their sum.  Block k of a
    source is released at floor(k / w) and due at ceil((k + 1) / w).  Time goes
    on by a slot with each block, and to the next release if none is released.
    """
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = lcm(*(w.denominator for w in exact.values()))
    whole = {s: w.numerator * (common // w.denominator) for s, w in exact.items()}
    total, out = sum(whole.values()), {s: [] for s in weights}
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    waiting = [(0, n) for n, s in enumerate(names) if blocks[s]]
    ready: list[tuple[int, int]] = []
    time = place = 0
    while waiting or ready:
        if not ready:
            time = max(time, waiting[0][0])
        while waiting and waiting[0][0] <= time:
            n = heappop(waiting)[1]
            heappush(ready, (-(-(len(out[names[n]]) + 1) * total // whole[names[n]]), n))
        n = heappop(ready)[1]
        s, own = names[n], out[names[n]]
        own.append(place)
        time, place = time + 1, place + 1
        if len(own) < blocks[s]:
            heappush(waiting, (len(own) * total // whole[s], n))
    return out


def schedule(parts: dict[str | None, int]) -> list[str | None]:
    """The source of each slot of one period, where each source has as many blocks as parts."""
    return [s for _, s in sorted((slot, s) for s, slots in slots_of(parts, parts).items() for slot in slots)]


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> dict[str | None, int]:
    """The characters of each source over all documents, and one more for each document.  One row a source comes to the driver."""
    sizes = docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.sum(F.length(whole_text(text)).cast("long") + 1).alias("n")).collect()
    return {r["s"]: r["n"] for r in sizes}


def with_blocks(keys: DataFrame, block_chars: int) -> DataFrame:
    """keys (id, s, h, n) with `block`, by the running sum of n in a source in the order of h.

    The running sum of a source is taken in two levels: over stretches of the
    hashed order, then within each stretch, so no task holds a whole source.
    """
    most = keys.groupBy("s").agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0
    bits = min(40, max(0, (most // RUN).bit_length()))
    stretch = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    staged = keys.withColumn("stretch", stretch)
    sums = staged.groupBy("s", "stretch").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("s").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each RUN documents.
    offsets = saved(sums.select("s", "stretch", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("s", "stretch").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("a.s").eqNullSafe(F.col("b.s")) & (F.col("a.stretch") == F.col("b.stretch"))
    start = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return staged.alias("a").join(offsets.alias("b"), same).select("a.*", "b.offset").withColumn("block", F.floor(start / block_chars).cast("long")).select("id", "s", "h", "block")


def with_slots(blocks: DataFrame, slots: dict[str | None, list[int]]) -> DataFrame:
    """blocks with `slot`, the place of `block` of source `s`, from a table of the slots of each source."""
    rows = pa.table({"source": pa.array(slots.keys(), pa.string()), "slots": pa.array(slots.values(), pa.list_(pa.int64()))})
    own = saved(blocks.sparkSession.createDataFrame(rows))
    placed = blocks.join(F.broadcast(own), F.col("s").eqNullSafe(F.col("source")))
    return placed.select("id", "s", "h", F.element_at("slots", (F.col("block") + 1).cast("int")).alias("slot"))


def mixed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, source: str = "source", id_column: str = "doc_id", text: str = "text", seed: int = 17, slot: str = "slot", rank: str = "slot_rank"
) -> DataFrame:
    """Every row of docs once, with its `slot` (bigint) and `slot_rank` (bigint), the order within the slot.

    Ordered by (slot, slot_rank), any prefix holds each source's share of
    characters by the given weights, as they are and however many sources there
    are, to within a block and the document that straddles its end, until a
    source runs out; the others then go on among themselves.  A block is
    `block_chars` characters, or the BLOCKS-th part of all if that is more.
    Without weights, each source's is the square root of its characters.  Null
    sources are a source of their own; sources that `weights` does not name get
    the least weight named.  Null and empty texts count one character, as each
    document has a mark after it.  Rows of one id and different texts are placed
    like any others; equal rows have one place.  Columns called like `slot` or
    `rank` are replaced, others kept whatever their names; an empty table gives
    an empty one.  Places are made of ids, hashes and sizes alone, and joined
    to the rows once.
    """
    docs = docs.drop(slot, rank)
    sizes = source_sizes(docs, source, text)
    if not sizes:
        return docs.withColumns({slot: F.lit(None).cast("long"), rank: F.lit(None).cast("long")})
    least = min(weights.values()) if weights is not None else None
    found = {s: float(n) ** 0.5 if weights is None else weights.get(s, least) for s, n in sizes.items()}
    block_chars = max(block_chars, -(-sum(sizes.values()) // BLOCKS))
    slots = slots_of(found, {s: (n - 1) // block_chars + 1 for s, n in sizes.items()})
    name, mark = free(docs, "source_name", "hash")
    marked = docs.withColumns({name: F.col(source).cast("string"), mark: F.xxhash64(F.col(id_column), F.xxhash64(whole_text(text)), F.lit(seed))})
    each = marked.select(F.col(id_column).alias("id"), F.col(name).alias("s"), F.col(mark).alias("h"), (F.length(whole_text(text)).cast("long") + 1).alias("n"))
    places = with_slots(with_blocks(each.groupBy("id", "s", "h").agg(F.sum("n").alias("n")), block_chars), slots)
    same = F.col(f"d.{id_column}").eqNullSafe(F.col("p.id")) & F.col(f"d.{name}").eqNullSafe(F.col("p.s")) & (F.col(f"d.{mark}") == F.col("p.h"))
    return marked.alias("d").join(places.alias("p"), same).select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("p.slot").alias(slot), F.col("p.h").alias(rank))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs sorted by their place in the mix, with the columns of docs, whatever their names.  Rows are placed as in mixed()."""
    slot, rank = free(docs, "slot", "slot_rank")
    return mixed(docs, **options, slot=slot, rank=rank).sort(slot, rank).select(*docs.columns)
