"""SimHash fingerprints of word shingles, and near copies by bit-sliced comparison.

Fingerprints that differ in at most `radius` bits are linked.  Equal
fingerprints are one class and compared once.  Of `radius + 2` bands of bits, a
pair within the radius agrees on two at least, so only classes that share two
bands meet; they are compared in blocks, with their bits stored as planes.

Texts of a given likeness of their shingles may differ in many more bits than
bands allow.  They meet where they share one of the shingles of least hash of
each; the same bit-sliced comparison, with a radius that such texts keep to,
leaves pairs, and parities of the sets of shingles, a few bits a shingle, leave
of these the ones whose sets may be alike at all and are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import Tables, free, saved, sifted, whole_text
from sluice.llm.components import connected_components

BITS = 64
#: Rows compared at once; a block of this many rows takes about 40 MB.
BLOCK = 2048
#: Shingles whose bits are counted at once, so that very long texts take bounded memory.
SLICE = 1 << 16
#: Shingles that a text is found by.  Two texts of likeness 0.8 share none of them with a probability under 0.2 ** KEYS, 4e-9; texts of up to 5 * KEYS shingles always share one.
KEYS = 12
#: Bits in which fingerprints of texts of likeness 0.8 differ at most: 10 in the mean, more than this in four of a million pairs.
REACH = 22
#: Texts found by one shingle from which they are found by two at once.
LISTED = 2048
#: Nearest texts, of each list and block, that each text is compared with before all others.
NEAREST = 1
#: Bits of a parity at most, 16 kB, whatever the text.
PARITY = 1 << 17
#: Words of 64 bits of parities that are compared at once.
WORDS = 1 << 18
#: Texts of which shingles are held at once in a worker.
AT_ONCE = 64


def shingle_votes(data: bytes, words: int) -> tuple[np.ndarray, int]:
    """How many of the text's shingles have each bit of their hash set, and how many shingles there are."""
    found = data.lower().split()  # bytes: lower-cases A-Z and splits at the six ASCII blanks only
    counts, total = np.zeros(BITS, np.int64), 0
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    if len(found) < words:
        grams = iter([b" ".join(found)] if found else [])
    else:
        grams = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    while hashes := list(map(hashed, islice(grams, SLICE))):
        rows = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return counts, total


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned number: a bit is set if it is in over half of the shingles' hashes."""
    counts, total = shingle_votes((text or "").encode("utf-8", "surrogatepass"), words)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def with_fingerprint(docs: DataFrame, words: int = 3, column: str = "text", name: str = "fp") -> DataFrame:
    """docs with its fingerprints in a bigint column.  Null texts count as empty; an empty text's fingerprint is 0."""

    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint_of(x, words) for at in range(0, len(texts), AT_ONCE) for x in texts.slice(at, AT_ONCE).to_pylist()]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprints(whole_text(column)))


def bits_of(fingerprints: np.ndarray) -> np.ndarray:
    """A row for each fingerprint with its 64 bits."""
    return np.unpackbits(fingerprints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def planes_of(bits: np.ndarray) -> np.ndarray:
    """Bit planes: in plane p, word w, bit k is bit p of fingerprint 64 * w + k."""
    padded = np.zeros((BITS, -(-len(bits) // 64) * 64), np.uint8)
    padded[:, : len(bits)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def near_pairs(asked: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all asked[i] and block[j] that differ in at most `radius` bits.

    Each of asked is compared with all of the block at once: carry-save adders
    over words of 64 fingerprints count the differing bits, and a sticky
    overflow marks distances beyond the counters.  An asked row whose whole
    block has overflowed is abandoned.
    """
    none = np.zeros(0, np.int64)
    if not len(asked) or not len(block):
        return none, none
    planes, own = planes_of(bits_of(block)), bits_of(asked)
    width = max(1, int(radius).bit_length())
    live = np.arange(len(asked))
    flip = np.where(own, ~np.uint64(0), np.uint64(0))
    counters = np.zeros((width, len(asked), planes.shape[1]), np.uint64)
    over = np.zeros((len(asked), planes.shape[1]), np.uint64)
    if spare := planes.shape[1] * 64 - len(block):
        over[:, -1] = ~np.uint64(0) << np.uint64(64 - spare)
    for p in range(BITS):
        carry = planes[p][None, :] ^ flip[:, p][:, None]
        for c in counters:
            c ^= carry
            carry &= ~c
        over |= carry
        if p % 8 == 7 and p >= radius:
            alive = ~(over == ~np.uint64(0)).all(axis=1)
            if not alive.any():
                return none, none
            if alive.sum() < 0.75 * len(alive):
                live, flip, counters, over = live[alive], flip[alive], counters[:, alive], over[alive]
    # Counters hold up to 2 ** width - 1; take the counts over the radius out too.
    if (1 << width) - 1 > radius:
        above, equal = np.zeros_like(over), np.full_like(over, ~np.uint64(0))
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        over |= above
    hits = np.unpackbits((~over).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    i, j = np.nonzero(hits)
    return live[i], j.astype(np.int64)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> dict[int, int]:
    """For each of n positions that a pair joins to a lower one, the least position that it reaches."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return {int(k): int(r) for k, r in enumerate(root) if r != k}


def links_of_block(first: np.ndarray, second: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that join just what all pairs of the block join: a spanning forest, never more links than rows."""
    rows = first if second is None else np.concatenate([first, second])
    asked, block, shift = (first, first, 0) if second is None else (first, second, len(first))
    i, j = [], []
    for at in range(0, len(asked), 256):
        x, y = near_pairs(asked[at : at + 256], block, radius)
        i.append(x + at)
        j.append(y + shift)
    forest = spanning(np.concatenate(i or [np.zeros(0, np.int64)]), np.concatenate(j or [np.zeros(0, np.int64)]), len(rows))
    return [(int(rows[k]), int(rows[r])) for k, r in forest.items()]


def compared(dealt: DataFrame, keys: list[str], more: list[str], schema: str, pairs, block: int) -> DataFrame:
    """What pairs(first, second) finds in each group of dealt, a frame for each; small groups share a call.

    A group has the keys `keys`, of which the last two are numbers of chunks;
    rows have the chunk that they are of in `own`.  first and second are
    the rows of the two chunks, second is None if they are one.
    """
    order = [*keys, "own", *more]
    sorted_rows = dealt.repartition(*keys).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []  # a pair that is near is a link wherever it meets
        size, key, parts = 0, None, []

        def ended() -> Iterator[pd.DataFrame]:
            nonlocal waiting, size
            rows = pd.concat(parts)
            if key[-2] != key[-1]:
                yield pairs(rows[rows["own"] == key[-2]], rows[rows["own"] == key[-1]])
                return
            if size + len(rows) > block and waiting:
                yield pairs(pd.concat(waiting), None)
                waiting, size = [], 0
            waiting.append(rows)
            size += len(rows)

        for frame in batches:
            if frame.empty:
                continue
            columns = frame[keys].to_numpy()
            cuts = [0, *(np.nonzero((columns[1:] != columns[:-1]).any(axis=1))[0] + 1), len(frame)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(columns[lo])
                if key is not None and now != key:
                    yield from ended()
                    parts = []
                key = now
                parts.append(frame.iloc[lo:hi])
        if key is not None:
            yield from ended()
        if waiting:
            yield pairs(pd.concat(waiting), None)

    return sorted_rows.mapInPandas(run, schema)


def in_chunks(rows: DataFrame, keys: list[str], name: str, n: Column) -> DataFrame:
    """rows in chunks by the hash of `name`, each row once for every chunk that its own meets: `own`, and the pair of chunks `lo` and `hi`."""
    dealt = rows.withColumn("chunks", n).withColumn("own", F.pmod(F.xxhash64(name, F.lit("chunk")), F.col("chunks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return each.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("chunks", "other")


def near_links(fingerprints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints, whose components are those of all pairs within the radius.

    fingerprints: a column fp, each value once.  Groups that share two bands and
    hold more than `block` rows are dealt into chunks, and every pair of chunks
    is compared in a task of its own: no group is cut short, none lands in one
    task.
    """
    bands = radius + 2
    edges = [round(k * BITS / bands) for k in range(bands + 1)]
    band = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = [F.struct(F.lit(n).alias("t"), band[x].alias("x"), band[y].alias("y")) for n, (x, y) in enumerate(combinations(range(bands), 2))]
    keyed = fingerprints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.x", "k.y")
    shared = keyed.groupBy("t", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    dealt = in_chunks(keyed.join(shared, ["t", "x", "y"]), ["t", "x", "y"], "fp", F.ceil(F.col("n") / block).cast("int")).drop("n")

    def found(first: pd.DataFrame, second: pd.DataFrame | None) -> pd.DataFrame:
        own = lambda rows: np.unique(rows["fp"].to_numpy().view(np.uint64))
        links = links_of_block(own(first), None if second is None else own(second), radius)
        ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return compared(dealt, ["t", "x", "y", "lo", "hi"], ["fp"], "a long, b long", found, block).distinct()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: its id, its fingerprint (bigint `fp`) and the least id of its group (`component_id`).

    Null texts count as empty, and empty texts have fingerprint 0, linked like
    any other.  Rows with equal texts share a fingerprint and so a group.
    Repeated ids give repeated rows.  A null id gives a row with that null, and
    never names a group unless the whole group has null ids.  Further columns of
    docs, whatever their names, are not read.
    """
    rows = saved(with_fingerprint(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), words).select("doc_id", "fp"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots_of(rows, radius), "fp")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(groups, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def roots_of(fingerprints: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, root): each different fingerprint of a column fp, and the one that its group is known by."""
    classes = fingerprints.select("fp").distinct()
    roots = connected_components(near_links(classes, radius)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without all but one row of each group of fingerprints within the radius: the one of least id, null ids last.

    Of rows of one id and one fingerprint the text of least hash stays, of equal
    rows one.  All empty and null texts are one group.  Columns, whatever their
    names, are passed on as they are; an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    rows = saved(with_fingerprint(texts, words).select("doc_id", "fp", F.xxhash64("text").alias("h")))
    return first_of_groups(docs, rows.join(roots_of(rows, radius), "fp"), id_column, text_column)


def first_of_groups(docs: DataFrame, rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The row of docs of least id, then of least hash of its text, of each group.  rows: doc_id, h (the hash of the text) and root of each row of docs."""
    h, nth = free(docs, "h", "nth")
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("least")).select("least.doc_id", "least.h")
    marked = docs.withColumn(h, F.xxhash64(whole_text(text_column)))
    stay = marked.alias("d").join(least.alias("s"), F.col(f"d.{id_column}").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{h}") == F.col("s.h")), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_column, h).orderBy(h))
    return stay.withColumn(nth, first).where(F.col(nth) == 1).select(*docs.columns)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The different hashes of the text's shingles in ascending order; a text of fewer words is one shingle, an empty one none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) < words:
        grams = [b" ".join(found)] if found else []
    else:
        grams = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64))


def fingerprint_of_set(own: np.ndarray) -> int:
    """The fingerprint of different hashes: a bit is set if it is in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(own), SLICE):
        counts += bits_of(own[at : at + SLICE]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")[0]) if len(own) else 0


def parity_of(own: np.ndarray) -> bytes:
    """Bits of a set of hashes, one to two for each: a bit is set if an odd number of them fall on it.

    Two sets have at least as many members that are not common as their parities
    have different bits, so sets that differ in more are told apart for certain.
    """
    width = min(PARITY, max(64, 1 << (len(own) - 1).bit_length()))
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(parities: list[bytes], words: int) -> np.ndarray:
    """A row for each parity, none of fewer words of 64 bits, folded to that length."""
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, words), axis=0) for x in parities])


def may_be_alike(first: pd.DataFrame, second: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair (first[i], second[j]) whether sizes and parities allow a likeness of 0.8: at most a ninth of all members not common."""
    m, n = first["n"].to_numpy(np.int64)[i], second["n"].to_numpy(np.int64)[j]
    good = 5 * np.minimum(m, n) >= 4 * np.maximum(m, n)
    one, two = first["parity"].to_numpy(), second["parity"].to_numpy()
    words = np.minimum(np.array([len(x) // 8 for x in one], np.int64)[i], np.array([len(x) // 8 for x in two], np.int64)[j])
    for width in np.unique(words[good]).tolist():
        these = np.flatnonzero(good & (words == width))
        (rows, x), (others, y) = np.unique(i[these], return_inverse=True), np.unique(j[these], return_inverse=True)
        left, right = folded(one[rows], width), folded(two[others], width)
        step = max(1, WORDS // width)
        for at in range(0, len(these), step):
            k = these[at : at + step]
            apart = np.bitwise_count(left[x[at : at + step]] ^ right[y[at : at + step]]).sum(axis=1, dtype=np.int64)
            good[k] = 9 * apart <= m[k] + n[k]
    return good


def with_sets(docs: DataFrame, words: int, column: str) -> DataFrame:
    """Rows (doc_id, h, set, n, fp, keys, parity) of docs: a hash of its set of shingles, the set's size, fingerprint and parity, and its KEYS least members."""

    @F.arrow_udf("set long, n int, fp long, keys array<long>, parity binary")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for at in range(0, len(batch), AT_ONCE):
                for text in batch.slice(at, AT_ONCE).to_pylist():
                    own = shingle_set(text, words)
                    name = np.array([xxhash.xxh64_intdigest(own.tobytes()), fingerprint_of_set(own)], np.uint64).view(np.int64)
                    rows.append({"set": int(name[0]), "n": len(own), "fp": int(name[1]), "keys": own[:KEYS].view(np.int64).tolist(), "parity": parity_of(own)})
            yield pa.array(rows, pa.struct([("set", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("parity", pa.binary())]))

    each = docs.select("doc_id", F.xxhash64(column).alias("h"), found(column).alias("found"))
    return each.select("doc_id", "h", "found.*")


def near(a: str, b: str) -> Column:
    """Whether two sets may be alike, by their sizes and fingerprints."""
    small, large = F.least(f"{a}.n", f"{b}.n").cast("long"), F.greatest(f"{a}.n", f"{b}.n").cast("long")
    return (5 * small >= 4 * large) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= REACH)


def alike_sets(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, tables: Tables, name: str) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of 0.8 or more.  sets: (set, h), each once; texts: (h, text)."""

    @F.arrow_udf("array<long>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([shingle_set(x, words).view(np.int64) for x in batch.slice(at, AT_ONCE).to_pylist()], pa.list_(pa.int64())) for at in range(0, len(batch), AT_ONCE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    pairs = tables.put(f"{name}_pairs", pairs)
    wanted = tables.put(f"{name}_ends", pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(sets.select("set", "h"), "set"))
    found = sifted(texts, wanted, "h").join(wanted, "h").dropDuplicates(["set"])
    members = tables.put(f"{name}_sets", found.select("set", shingles("text").alias("members")))
    one, two = members.select(F.col("set").alias("a"), F.col("members").alias("x")), members.select(F.col("set").alias("b"), F.col("members").alias("y"))
    same = F.size(F.array_intersect("x", "y")).cast("long")
    out = tables.put(f"{name}_links", pairs.join(one, "a").join(two, "b").where(9 * same >= 4 * (F.size("x").cast("long") + F.size("y"))).select("a", "b"))
    tables.drop(f"{name}_pairs", f"{name}_ends", f"{name}_sets")
    return out


def lists_of(sets: DataFrame, tables: Tables) -> DataFrame:
    """Rows (token, set, n, fp): the sets that each key finds, if it finds several; where it finds over LISTED, two keys of a set find it together."""
    posts = sets.select("set", "n", "fp", F.explode("keys").alias("token"))
    counts = tables.put("counts", posts.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"))
    short = posts.join(counts.where(F.col("times") <= LISTED).select("token"), "token")
    long = sets.select("set", "n", "fp", "keys", F.explode("keys").alias("token")).join(counts.where(F.col("times") > LISTED).select("token"), "token")
    both = long.select("set", "n", "fp", "token", F.explode("keys").alias("other"))
    # Equal tokens stand for a set that has no other.
    pairs = both.where("token <> other or n = 1").select(F.xxhash64(F.least("token", "other"), F.greatest("token", "other")).alias("token"), "set", "n", "fp").distinct()
    return tables.put("lists", short.select("token", "set", "n", "fp").unionByName(pairs))


def likely_pairs(left: DataFrame, sets: DataFrame, block: int, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of sets that share a token, have different labels, are near by bit-sliced comparison and may be alike by their parities.

    left: (token, set, n, fp, label); sets: (set, parity), each once.  most: for
    each set of a block only so many of the nearest; None for all.
    """
    lists = left.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / block).cast("int").alias("times")).where("low < high")
    listed = left.join(lists.select("token", "times"), "token").join(sets.select("set", "parity"), "set")
    dealt = in_chunks(listed, ["token"], "set", F.col("times")).drop("times")

    def found(first: pd.DataFrame, second: pd.DataFrame | None) -> pd.DataFrame:
        first = first.drop_duplicates("set")
        second = first if second is None else second.drop_duplicates("set")
        a, b = [], []
        for at in range(0, len(first), 256):
            asked = first.iloc[at : at + 256]
            i, j = near_pairs(asked["fp"].to_numpy().view(np.uint64), second["fp"].to_numpy().view(np.uint64), REACH)
            other = asked["label"].to_numpy()[i] != second["label"].to_numpy()[j]
            i, j = i[other], j[other]
            good = may_be_alike(asked, second, i, j)
            i, j = i[good], j[good]
            if most is not None:
                far = np.bitwise_count(asked["fp"].to_numpy()[i].view(np.uint64) ^ second["fp"].to_numpy()[j].view(np.uint64))
                order = np.lexsort((far, i))
                starts = np.flatnonzero(np.diff(i[order], prepend=-1))
                nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
                i, j = i[order[nth < most]], j[order[nth < most]]
            a.append(asked["set"].to_numpy()[i])
            b.append(second["set"].to_numpy()[j])
        one, two = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)}).drop_duplicates()

    return compared(dealt, ["token", "lo", "hi"], ["set"], "a long, b long", found, block).distinct()


def alike_links(sets: DataFrame, texts: DataFrame, words: int, tables: Tables, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of sets, whose components are those of all pairs that are alike and share a key.  sets: (set, n, fp, keys, parity, h), each once; texts: (h, text).

    First each set meets one of its list, twice, then the nearest in each block;
    only sets that those have not linked to one and the same meet all others.
    """
    lists = lists_of(sets, tables)
    links = None
    left = lists.withColumn("label", F.col("set"))
    for turn in ("first", "second"):
        heads = left.where("label = set").groupBy("token").agg(F.min(F.struct("set", "n", "fp")).alias("h")).select("token", "h.*")
        star = left.where("label = set").alias("x").join(heads.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("y.set") < F.col("x.set")) & near("x", "y"))
        own = alike_sets(star.select(F.col("y.set").alias("a"), F.col("x.set").alias("b")).distinct(), sets, texts, words, tables, turn)
        links = own if links is None else links.unionByName(own)
        labels = links.groupBy(F.col("b").alias("set")).agg(F.min("a").alias("label"))
        left = tables.put(f"after_{turn}", lists.join(labels, "set", "left").select("token", "set", "n", "fp", F.coalesce("label", "set").alias("label")))
    links = links.unionByName(alike_sets(likely_pairs(left, sets, block, NEAREST), sets, texts, words, tables, "nearest"))
    labels = labels_of(links, tables)
    left = tables.put("after_nearest", lists.join(labels, "set", "left").select("token", "set", "n", "fp", F.coalesce("label", "set").alias("label")))
    return links.unionByName(alike_sets(likely_pairs(left, sets, block), sets, texts, words, tables, "last"))


def labels_of(links: DataFrame, tables: Tables, hops: int = 3) -> DataFrame:
    """Rows (set, label): for each end of a link the least set that it reaches in so many hops."""
    ends = links.select(F.col("a").alias("set"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("set"), F.col("a").alias("other")))
    labels = ends.groupBy("set").agg(F.least(F.col("set"), F.min("other")).alias("label"))
    for hop in range(1, hops):
        labels = tables.put(f"labels{hop}", labels)
        told = ends.join(labels.select(F.col("set").alias("other"), F.col("label").alias("theirs")), "other").groupBy("set").agg(F.min("theirs").alias("theirs"))
        labels = labels.join(told, "set").select("set", F.least("label", "theirs").alias("label"))
    return tables.put("labels", labels)


def one_of_alike(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without all but one row of each group of near copies: the one of least id, null ids last.

    Near copies are rows of which the different shingles of `words` words have a
    Jaccard similarity of 0.8 or more, and a group is all that such pairs reach.
    Pairs are found by KEYS and REACH, whose losses are stated there; parities
    lose none, and each pair that they leave is verified.  All texts without words, null ones too, are one group.  Of
    rows of one id and one group the text of least hash stays, of equal rows
    one.  Columns, whatever their names, are passed on as they are; an empty
    table gives an empty one.
    """
    tables = Tables(docs.sparkSession)
    texts = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    rows = tables.put("rows", with_sets(texts, words, "text"))
    sets = rows.groupBy("set").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("parity").alias("parity"), F.min("h").alias("h"))
    sets = tables.put("sets", sets)
    hashed = texts.select(F.xxhash64("text").alias("h"), "text")
    roots = connected_components(alike_links(sets, hashed, words, tables, block)).withColumnRenamed("node", "set")
    named = rows.select("doc_id", "h", "set").join(roots, "set", "left").select("doc_id", "h", F.coalesce("root", "set").alias("root"))
    return first_of_groups(docs, named, id_column, text_column)
