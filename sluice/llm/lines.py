"""Line dedup as an exact set-similarity join, with DataFrame functions only.

The tokens of a line (its different words) are ordered by length, longest first,
then by hash: long words are rare, and no word has to be counted for it.  Of two
lines of Jaccard similarity t, each of the tokens that only one has parts at most
one of the tokens that both have from the next, so a pair of neighbours in this
order is shared among the first 2 n (1 - t) + 1 of each; of a threshold of one
half or less, a token among the first n - ceil(t n) + 1.  Only lines that meet in
these postings are compared: by their sizes and by bitmaps that bound how many
tokens they can share; the full token sets verify.  Of matching lines the later
ones go.  Equal lines are one class, compared once.  Postings that no other line
has, by far the most, go first.  Where the postings of a pair of neighbours are
long, lines meet in those of two such pairs: similar lines share two among the
first 2 n (1 - t) + 2.  Where even those are long, as in large groups of near
copies, each line is first compared with a few early ones, which settles most of
the group, and what is left with all, in chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import Tables, free, once, sifted, whole_text

INK = r"[^\x20\x09-\x0D]"
#: Postings of one token that are all compared with one another, and how many early ones the lines of longer lists are compared with first.
LISTED, LEADERS = 256, 8
#: Bits of a number that hold a line's place in its document, where ids allow to keep both in one: no text has more lines.
LINE_BITS, ID_BITS = 31, 32
#: Bits of what a posting is found by.
TOKEN_BITS = 40
#: Lines of more tokens have two bitmaps.
LONG_LINE = 64
BITMAPS = ["bitmap", "half"]
#: Candidates of a line that are verified before the others.
FIRST = 4


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, line, class): the lines that are not blank; equal lines have one class."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return each.where(F.rlike("line", F.lit(INK))).withColumn("class", F.xxhash64("line"))


def plain(text: Column) -> Column:
    """The text with a space for every blank; a text without some kind of blank is not copied for it."""
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def tokens_of(line: Column) -> Column:
    """The different words of a line as numbers that sort longer words first: their length, of one byte, negated, and 56 bits of their hash."""
    number = lambda w: F.shiftleft((-F.octet_length(w)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8))
    return F.array_distinct(F.transform(F.array_remove(F.split(plain(line), " ", -1), ""), number))


@dataclass
class Corpus:
    """What is known of a table of texts: its documents, and whether a number names a line."""

    docs: DataFrame
    packed: bool

    def place(self) -> Column:
        """A line's place in the order of all lines, which names it: one number where ids allow, else all that tells lines apart."""
        return F.shiftleft("doc_id", LINE_BITS).bitwiseOR(F.col("line_no")) if self.packed else F.struct("doc_id", "line_no", "class")

    def lines(self) -> DataFrame:
        """Rows (doc_id, line_no, line, class, place)."""
        return lines_of(self.docs).withColumn("place", self.place())


def surveyed(docs: DataFrame) -> Corpus:
    """Looks at the ids alone: a number names a line where they are numbers, different and not too large."""
    if docs.schema["doc_id"].dataType != T.LongType():
        return Corpus(docs, False)
    low, high, nulls = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    packed = low is not None and not nulls and low >= 0 and high < 1 << ID_BITS
    return Corpus(docs, packed and docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty())


def overlap(n: Column, other: Column, threshold: float) -> Column:
    """The common tokens that sets of these sizes need for the threshold."""
    return F.ceil((n + other) * (threshold / (1 + threshold)) - 1e-9).cast("int")


def by_neighbours(threshold: float) -> bool:
    """Whether lines that reach the threshold share at least two pairs of neighbours."""
    return threshold > 0.5


def prefix_length(n: Column, threshold: float) -> Column:
    """How many pairs of neighbours, or tokens, of a line of n tokens hold one that any line that reaches the threshold shares."""
    if by_neighbours(threshold):
        return F.least(n + 1, F.floor(n * (2 * (1 - threshold)) + 1e-9).cast("int") + 1)
    return n - F.ceil(n * threshold - 1e-9).cast("int") + 1


def first_tokens(tokens: Column, threshold: float) -> Column:
    """The tokens that a line is found by and one more, or a zero for the end of the line; their upper halves keep the length of the word and 24 bits of its hash."""
    count = prefix_length(F.size(tokens), threshold) + 1
    ended = F.when(F.size(tokens) < count, F.concat(tokens, F.array(F.lit(0).cast("long")))).otherwise(tokens) if by_neighbours(threshold) else tokens
    return F.transform(F.slice(ended, F.lit(1), count), lambda t: F.shiftright(t, 32).cast("int"))


def gram(prefix: Column, i: Column, threshold: float) -> Column:
    """What the posting of a place in a prefix is found by: the token there, and the one before it where neighbours count; none is before the first."""
    return F.xxhash64(*[F.get(prefix, i - k) for k in range(2 if by_neighbours(threshold) else 1)]).bitwiseAND((1 << TOKEN_BITS) - 1)


def classes_of(corpus: Corpus, threshold: float) -> DataFrame:
    """Rows (class, place, times, n, the bitmaps, prefix) of the different lines.

    place: the first line of the class.  times: how many lines it has.  n: its
    tokens.  bitmap: bit b is set if an odd number of its tokens hash to b; as
    many tokens at least tell two lines apart as their bitmaps have different
    bits.  half: 0 but for long lines, where it is the same for half of the
    tokens, so that two bitmaps count apart.  prefix: its first_tokens().
    """
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))

    def head(tokens: Column) -> Column:
        none, n = F.lit(0).cast("long"), F.size(tokens)
        whole = F.aggregate(tokens, none, lambda a, t: a.bitwiseXOR(bit(t)))
        half = F.aggregate(tokens, none, lambda a, t: F.when(t.bitwiseAND(64) != 0, a.bitwiseXOR(bit(t))).otherwise(a))
        return F.struct(n.alias("n"), whole.alias("bitmap"), F.when(n > LONG_LINE, half).otherwise(none).alias("half"), first_tokens(tokens, threshold).alias("prefix"))

    # The one element of an array is computed once, however often the function of it reads it.
    heads = corpus.lines().select("class", "place", F.inline(F.transform(F.array(F.sort_array(tokens_of(F.col("line")))), head)))
    return heads.groupBy("class", "n", *BITMAPS, "prefix").agg(F.min("place").alias("place"), F.count("*").alias("times"))


def postings(classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (token, place, n, the bitmaps, long): the prefix of each class, without what no other class has.  long: whether over LISTED postings have the token."""
    each = classes.select("place", "prefix", F.explode(F.sequence(F.lit(0), prefix_length(F.col("n"), threshold) - 1)).alias("i"))
    each = each.select("place", gram(F.col("prefix"), F.col("i"), threshold).alias("token"))
    # Both sides of the join read one shuffle: the filter is what Spark would add to one of them.
    each = each.where("token is not null and place is not null").repartition("token")
    lists = each.groupBy("token").agg(F.count("*").alias("count"), F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    met = each.join(lists.select("token", (F.col("count") > LISTED).alias("long")).hint("shuffle_hash"), "token")
    return met.join(classes.select("place", "n", *BITMAPS), "place").select("token", "place", "n", *BITMAPS, "long")


def pair_postings(classes: DataFrame, posts: DataFrame, threshold: float) -> DataFrame:
    """Postings of two tokens, one of posts and each that follows it in the line's prefix."""
    # The sieve keeps most prefixes where they are while few postings are long.
    both = posts.join(sifted(classes.select("place", "prefix"), posts, "place"), "place")
    grams = F.transform(F.sequence(F.lit(0), F.size("prefix") - 1), lambda i: gram(F.col("prefix"), i, threshold))
    all_of = both.select("token", "place", "n", *BITMAPS, once(grams).alias("grams"))
    each = all_of.select("token", "place", "n", *BITMAPS, F.explode(F.slice("grams", F.array_position("grams", F.col("token")).cast("int") + 1, F.size("grams"))).alias("other"))
    return each.select(F.xxhash64("token", "other").alias("token"), "place", "n", *BITMAPS)


def long_lists(posts: DataFrame) -> DataFrame:
    """The tokens of over LISTED postings: at most one for every LISTED of them."""
    return posts.groupBy("token").agg(F.count("*").alias("count")).where(F.col("count") > LISTED).select("token")


def passes(a: str, b: str, threshold: float) -> Column:
    """Whether posting b is earlier than posting a of one token, and their lines may reach the threshold: by sizes and bitmaps."""
    n, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = overlap(n, n2, threshold)
    sized = (n2 >= n * threshold - 1e-9) & (n >= n2 * threshold - 1e-9)
    whole, half = (F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}")) for x in BITMAPS)
    apart = F.when((n > LONG_LINE) & (n2 > LONG_LINE), F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))).otherwise(F.bit_count(whole))
    return (F.col(f"{b}.place") < F.col(f"{a}.place")) & sized & (n + n2 - apart >= 2 * need)


def met(a: DataFrame, b: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Rows (place, n, place2, n2): pairs of classes whose postings in a and b meet and pass all filters, the later one first."""
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    pairs = a.alias("a").join(b.alias("b"), [*on, passes("a", "b", threshold)])
    return pairs.select(F.col("a.place").alias("place"), F.col("a.n").alias("n"), F.col("b.place").alias("place2"), F.col("b.n").alias("n2")).distinct()


def alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose tokens in sets reach the threshold, or may do so where several tokens of a line are one in sets."""
    other = sets.select(F.col("place").alias("place2"), F.col("tokens").alias("tokens2"))
    both = pairs.select("place", "n", "place2", "n2").join(sets, "place").join(other, "place2")
    common = F.size(F.array_intersect("tokens", "tokens2")) + F.col("n") - F.size("tokens")
    return both.where(common >= overlap(F.col("n"), F.col("n2"), threshold)).select("place", "n", "place2", "n2")


class Search:
    """One search for the classes that an earlier class is like, with its intermediate tables."""

    def __init__(self, corpus: Corpus, threshold: float, tables: Tables):
        self.corpus, self.threshold, self.tables, self.rounds = corpus, threshold, tables, 0
        self.classes = tables.put("classes", classes_of(corpus, threshold))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The later places (place) of pairs whose token sets reach the threshold.

        One match is enough, so of each line a few candidates go first, and the
        others only for the lines that those have left.
        """
        self.rounds += 1
        at = lambda name: f"{name}{self.rounds}"
        pairs = self.tables.put(at("pairs"), pairs)
        sets = self.sets_of(pairs, at("sets"))
        few = pairs.groupBy("place", F.pmod(F.xxhash64("place2"), F.lit(FIRST))).agg(F.min("place2").alias("place2"))
        settled = self.tables.put(at("first"), alike(pairs.join(few.select("place", "place2"), ["place", "place2"], "left_semi"), sets, self.threshold).select("place").distinct())
        settled = settled.unionByName(self.compared(pairs.join(settled, "place", "left_anti"), sets, at("rest")))
        self.tables.drop(*map(at, ("pairs", "sets", "sets_wanted")))
        return settled

    def sets_of(self, pairs: DataFrame, name: str) -> DataFrame:
        """Rows (place, tokens) of the lines of pairs.  Their lines are taken from the documents again, so that tokens never move for lines that nothing is like."""
        wanted = self.tables.put(f"{name}_wanted", pairs.select(F.explode(F.array("place", "place2")).alias("place")).distinct())
        # An inner join with different places: a semi-join would be pushed below the sieve, and all lines would move.
        found = sifted(self.corpus.lines().select("place", "line"), wanted, "place").join(wanted, "place")
        return self.tables.put(name, found.select("place", once(tokens_of(F.col("line"))).alias("tokens")))

    def compared(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The later places (place) of pairs whose sets reach the threshold: by sixteen bits of each token first, and what they leave by whole tokens."""
        short = F.array_distinct(F.transform("tokens", lambda t: (t.bitwiseAND(0xFFFF) - 0x8000).cast("smallint")))
        likely = self.tables.put(f"{name}_likely", alike(pairs, sets.select("place", short.alias("tokens")), self.threshold))
        out = self.tables.put(f"{name}_matched", alike(likely, sets, self.threshold).select("place").distinct())
        self.tables.drop(f"{name}_likely")
        return out

    def matched(self) -> DataFrame:
        """The places of the first lines of their classes that an earlier line is like."""
        threshold, posts = self.threshold, self.tables.put("posts", postings(self.classes, self.threshold))
        long, rest = posts.where("long"), posts.where("not long")
        found = met(rest, rest, ["token"], threshold)
        if long.isEmpty():
            return self.verified(found)
        # Below the threshold of neighbours lines may share a single token.
        pairs = self.tables.put("two_tokens", pair_postings(self.classes, long, threshold)) if by_neighbours(threshold) else long
        hotter = self.tables.put("hotter", long_lists(pairs))
        found = found.unionByName(met(rest := pairs.join(hotter, "token", "left_anti"), rest, ["token"], threshold))
        if hotter.isEmpty():
            return self.verified(found.distinct())
        lists = self.tables.put("lists", pairs.join(hotter, "token", "left_semi"))
        leaders = lists.groupBy("token", F.pmod(F.xxhash64("place"), F.lit(LEADERS))).agg(F.min("place").alias("place"))
        early = lists.join(leaders.select("token", "place"), ["token", "place"], "left_semi")
        settled = self.verified(found.unionByName(met(lists, early, ["token"], threshold)).distinct())
        # What is left meets all others of its lists, in chunks of about LISTED.
        chunks = lists.groupBy("token").agg(F.ceil(F.count("*") / LISTED).cast("int").alias("chunks"))
        dealt = lists.join(chunks, "token")
        left = dealt.join(settled, "place", "left_anti").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        right = dealt.withColumn("chunk", F.pmod(F.xxhash64("place", F.lit("chunk")), F.col("chunks")).cast("int"))
        return settled.unionByName(self.verified(met(left, right, ["token", "chunk"], threshold))).distinct()


def removed_lines(corpus: Corpus, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, gone): for each id with such lines, the (line_no, class) of the lines that an earlier line is like.

    The corpus has doc_id and text, without null texts.  Lines are ordered by
    doc_id (null first) and their number.
    """
    search = Search(corpus, threshold, Tables(corpus.docs.sparkSession))
    matched = search.matched().select(F.col("place").alias("first"), F.lit(True).alias("matched"))
    first = search.classes.select("class", F.col("place").alias("first"), "times")
    judged = first.join(matched, "first", "left").where("times > 1 or matched").drop("times")
    lines = corpus.lines().select("doc_id", "line_no", "class", "place")
    gone = lines.join(judged, "class").where(F.col("matched").isNotNull() | (F.col("place") != F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "class")).alias("gone"))


def numbers_of(gone: str, class_of) -> Column:
    """The numbers of a row's own lines to remove, from 0 and ascending: rows of one id have the lines of all of them among the gone.  class_of: the class of its line of a number."""
    own = F.filter(F.coalesce(gone, F.array().cast("array<struct<line_no:int,class:bigint>>")), lambda x: class_of(x["line_no"]) == x["class"])
    return F.array_sort(F.transform(own, lambda x: x["line_no"]))


def with_removed(docs: DataFrame, threshold: float, id_column: str, text_column: str, lines: str, numbers: str) -> DataFrame:
    """docs with its lines in an array and the numbers of those to remove."""
    texts = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    gone = removed_lines(surveyed(texts), threshold)
    both = docs.alias("d").join(gone.alias("g"), F.col(f"d.{id_column}").eqNullSafe(F.col("g.doc_id")), "left")
    split = both.select("d.*", F.col("g.gone").alias(numbers), once(F.split(whole_text(f"d.{text_column}"), "\n", -1)).alias(lines))
    return split.withColumn(numbers, numbers_of(numbers, lambda k: F.xxhash64(F.get(lines, k))))


def without_repeats(docs: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the lines removed from its texts that an earlier line of the same or another document is like.

    Blank lines are kept and match nothing.  A line is removed if any earlier
    line, itself removed or not, has a Jaccard similarity of `threshold` or more
    with it.  Earlier is by id, null ids first, then by the line's number; equal
    lines at one place of rows with one id count as one and are kept or removed
    together, so repeated rows stay equal.  A null text stays null; a text may
    become empty.  Other columns, whatever their names, are passed on as they
    are; an empty table gives an empty one.
    """
    lines, numbers = free(docs, "lines", "numbers")
    marked = with_removed(docs, threshold, id_column, text_column, lines, numbers)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers), lambda i: F.get(lines, i))
    text = F.when(F.size(numbers) > 0, F.array_join(kept, "\n")).otherwise(F.col(text_column).cast("string"))
    return marked.withColumn(text_column, text).select(*docs.columns)


def line_report(docs: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, how many lines it has (n_lines), how many stay (n_kept), and the numbers (from 0) of those removed, comma-joined (removed).

    Which lines go is as in without_repeats().  A null text counts as empty,
    and an empty one has one blank line, which stays.  Null and repeated ids
    give rows like any other; further columns are not read; an empty table
    gives an empty one.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    corpus = surveyed(texts)
    gone, lines = removed_lines(corpus, threshold), F.split("text", "\n", -1)
    if corpus.packed:  # the lines of an id are those of its one row
        both = texts.select("doc_id", F.size(lines).cast("long").alias("n")).join(gone, "doc_id", "left")
        numbers = F.array_sort(F.transform(F.coalesce("gone", F.array().cast("array<struct<line_no:int,class:bigint>>")), lambda x: x["line_no"]))
        marked = both.select("doc_id", "n", numbers.alias("numbers"))
    else:  # of the texts only the classes of their lines move
        classes = texts.select("doc_id", F.transform(lines, lambda x: F.xxhash64(x)).alias("classes"))
        both = classes.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
        marked = both.select("d.doc_id", F.size("classes").cast("long").alias("n"), once(numbers_of("g.gone", lambda k: F.get("classes", k))).alias("numbers"))
    n = F.col("n")
    return marked.select("doc_id", n.alias("n_lines"), (n - F.size("numbers")).cast("long").alias("n_kept"), F.array_join(F.col("numbers").cast("array<string>"), ",").alias("removed"))


#: DuckDB SQL with the rows of line_report over the table documents, at the default threshold.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
ink AS (SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (
  SELECT line, row_number() OVER (ORDER BY d, k) AS place FROM (
    SELECT line, min(doc_id) AS d, min(k) AS k FROM (
      SELECT line, doc_id, line_no AS k, min(doc_id) OVER (PARTITION BY line) AS m FROM ink) WHERE doc_id = m GROUP BY line)),
t AS (SELECT DISTINCT place, word FROM (SELECT place, unnest(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) AS word FROM c) WHERE word <> ''),
f AS (SELECT word, count(*) AS n FROM t GROUP BY word),
r AS (
  SELECT place, word, row_number() OVER (PARTITION BY place ORDER BY f.n, word) AS i, count(*) OVER (PARTITION BY place) AS n
  FROM t JOIN f USING (word)),
p AS (SELECT place, word, n FROM r WHERE i <= n - (4 * n + 4) // 5 + 1),
pair AS (
  SELECT DISTINCT a.place AS early, b.place AS late, a.n AS n1, b.n AS n2
  FROM p a JOIN p b USING (word) WHERE a.place < b.place AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
hit AS (
  SELECT DISTINCT late FROM (
    SELECT early, late, n1, n2, count(*) AS both_have
    FROM pair JOIN t a ON a.place = early JOIN t b ON b.place = late AND a.word = b.word GROUP BY ALL)
  WHERE 9 * both_have >= 4 * (n1 + n2)),
firsts AS (SELECT line, doc_id, line_no, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS nth FROM ink),
gone AS (
  SELECT doc_id, line_no FROM firsts JOIN c USING (line) LEFT JOIN hit ON hit.late = c.place
  WHERE nth > 1 OR hit.late IS NOT NULL)
SELECT l.doc_id, count(*) AS n_lines, count(*) - count(g.line_no) AS n_kept,
  coalesce(string_agg(CAST(g.line_no AS VARCHAR), ',' ORDER BY g.line_no), '') AS removed
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no
GROUP BY l.doc_id
"""
