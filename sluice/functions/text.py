"""Column expressions on texts: words, lines, greedy line filling, character counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words folded at a time, so that long texts are not copied once per word.
STRETCH = 256


def words(text: Column) -> Column:
    """The words of a text: what stands between blanks, tabs and newlines, without empty ones.  Null gives null."""
    return F.filter(F.split(text, "[ \t\n]+", -1), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def characters(text: Column) -> Column:
    """The code points of a text, newlines left out."""
    return F.filter(F.split(F.replace(text, F.lit("\n"), F.lit("")), "", -1), lambda c: c != "")


def greedy_fill(tokens: Column, limit: int, extra_blank: bool = False) -> Column:
    """Words laid out in lines of at most `limit` characters; an over-long word has a line of its own.

    A word goes on the line if it fits with the blank that follows the word
    before, else on a new line, so an over-long first word leaves an empty first
    line.  extra_blank puts one more blank, which no limit counts, before each
    word that fits.
    """
    gap = F.lit(" ") if extra_blank else F.lit("")
    after = lambda n: F.when(n + 1 <= limit, n + 1).otherwise(n)

    def put(state: Column, word: Column) -> Column:
        n, size = state["n"], F.length(word)
        fits = n + size <= limit
        return F.struct(
            F.when(fits, after(n + size)).otherwise(after(size)).cast("int").alias("n"),
            F.when(fits, F.concat(state["t"], F.when(n > 0, F.lit(" ")).otherwise(F.lit("")), gap, word)).otherwise(F.concat(state["t"], F.lit("\n"), word)).alias("t"),
        )

    state = lambda n, t: F.struct(n.cast("int").alias("n"), t.alias("t"))
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda at: F.slice(tokens, at, F.lit(STRETCH)))

    def part(done: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, state(done["n"], F.lit("")), put)
        return state(own["n"], F.concat(done["t"], own["t"]))

    return F.aggregate(parts, state(F.lit(0), F.lit("")), part, lambda s: s["t"])
