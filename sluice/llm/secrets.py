"""Secrets in texts, found with an inverted index of the trigrams that each rule needs.

From each rule's regular expression a Boolean query over trigrams is derived:
an AND of ORs of trigram sets, one of which every match must contain.  The
index has postings (trigram, document) for those trigrams; intersecting them
gives the candidates, in which the expression is then matched.  A rule without
mandatory trigrams scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import saved, sifted, whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose `group` has under `least` code points are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The patterns of the kinds.  In hex and access the least length stands in the pattern, which finds the
#: same spans there: both match whole runs of one class of characters.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

#: A set of alternatives larger than this is not followed further; its trigrams so far are used.
MOST_STRINGS = 64

Alternatives = frozenset[frozenset[str]]


def strings_of(node: tuple) -> set[str] | None:
    """All strings that a part of an expression matches, lower-cased, or None if they are too many to list."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        if any(k is not op.LITERAL for k, _ in value):
            return None
        return {chr(v).lower() for _, v in value}
    if kind is op.SUBPATTERN:
        return sequence_of(value[3])
    if kind is op.BRANCH:
        all_of = [sequence_of(x) for x in value[1]]
        return None if any(x is None for x in all_of) else set().union(*all_of)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, what = value
        one = sequence_of(what)
        if one is None or high > 8 or len(one) ** int(high) > MOST_STRINGS:
            return None
        return {"".join(x) for n in range(low, high + 1) for x in product(one, repeat=n)}
    return {""} if kind is op.AT else None


def sequence_of(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        own = strings_of(node)
        if own is None or len(found) * len(own) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def grams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def trigram_query(pattern: str) -> list[Alternatives]:
    """An AND of ORs of sets of lower-case trigrams; empty if the expression has no mandatory trigram."""
    clauses: list[Alternatives] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(x) >= 3 for x in strings):
            sets = {grams(x) for x in strings}
            clauses.append(frozenset(x for x in sets if not any(y < x for y in sets)))

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            own = strings_of(node)
            if own is not None and len(run) * len(own) <= MOST_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            close(run)
            run = {""} if own is None else own
            kind, value = node
            if own is None and kind is op.SUBPATTERN:
                walk(value[3])
            elif own is None and kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                walk(value[2])
        close(run)

    walk(regex_parser.parse(pattern))
    return clauses


def postings(keyed: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index: rows (gram, doc_id, h), each wanted trigram with the documents that hold it, in whatever case."""
    low = keyed.select("doc_id", "h", F.lower("text").alias("low"))
    found = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in wanted]), lambda x: x.isNotNull())
    return low.select("doc_id", "h", F.explode(found).alias("gram"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (doc_id, h, kind): the documents whose trigrams satisfy a rule's query, for the rules that have one.

    The query is a small table of (gram, kind, clause, alternative, how many).
    Its join with the index intersects the postings of each alternative; a rule
    holds where each of its clauses has an alternative that does.  Equal rows of
    a document add nothing.  Lists are counted by document, so the postings of a
    frequent trigram are spread over all tasks.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = [(g, kind, c, a, len(one)) for kind, q in queries.items() for c, clause in enumerate(q) for a, one in enumerate(sorted(clause, key=sorted)) for g in sorted(one)]
    asked = keyed.sparkSession.createDataFrame(rows, "gram string, kind string, clause int, alternative int, wanted int")
    lists = postings(keyed, sorted({r[0] for r in rows})).join(F.broadcast(asked), "gram")
    met = lists.groupBy("doc_id", "h", "kind", "clause", "alternative", "wanted").agg(F.countDistinct("gram").alias("n")).where("n = wanted")
    clauses = F.create_map(*[F.lit(x) for kind, q in queries.items() for x in (kind, len(q))])
    return met.groupBy("doc_id", "h", "kind").agg(F.countDistinct("clause").alias("n")).where(F.col("n") == clauses[F.col("kind")]).select("doc_id", "h", "kind")


def match_rows(texts: DataFrame, rule: Rule) -> DataFrame:
    """Rows (doc_id, h, kind, k, gap, size, value): match k, the code points between the match before and it, its own and its group's."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    value = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    parts = texts.where(F.regexp_like("text", pattern)).select("doc_id", "h", F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), whole.alias("size"), value.alias("value")).alias("parts"))
    rows = parts.select("doc_id", "h", F.posexplode("parts").alias("k", "part"))
    return rows.where("part.size is not null").select("doc_id", "h", F.lit(rule.kind).alias("kind"), "k", *[F.length(f"part.{c}").cast("long").alias(c) for c in ("gap", "size", "value")])


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id and `found`, an array of (start, number of the rule, kind, end, base).

    Positions are in code points, the end exclusive; spans are in order of start
    and then of the rules.  Null texts count as empty and have none.  Equal rows
    of a document get the same spans; rows with one id and different texts their
    own.  Further columns of docs are not read.
    """
    keyed = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text")).withColumn("h", F.xxhash64("text"))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    chosen = candidates(keyed, tuple(indexed)).groupBy("doc_id", "h").agg(F.collect_set("kind").alias("kinds")) if indexed else None
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
    tables = [match_rows(keyed, r) for r in rules if r not in indexed]
    if chosen is not None:
        chosen = saved(chosen)
        few = sifted(keyed, chosen, "h")
        likely = few.alias("a").join(chosen.alias("b"), same(few, chosen)).select("a.doc_id", "a.h", "a.text", "b.kinds")
        each = likely.select("doc_id", "h", "text", F.explode("kinds").alias("kind"))
        tables += [verified(each, indexed)]
    rows = reduce(DataFrame.unionByName, tables).repartition("doc_id", "h").distinct()
    before = Window.partitionBy("doc_id", "h", "kind").orderBy("k")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    numbers = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)])
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.least)])
    base = F.col("kind").isin([r.kind for r in rules if r.base])
    kept = placed.where(F.col("value") >= least[F.col("kind")])
    spans = kept.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", numbers[F.col("kind")].alias("rule"), "kind", "end", base.alias("base")))).alias("found"))
    left = keyed.select("doc_id", "h")
    return left.alias("a").join(spans.alias("b"), same(left, spans), "left").select("a.doc_id", F.coalesce("b.found", F.expr("filter(array(struct(0L as start, 0 as rule, '' as kind, 0L as end, false as base)), x -> false)")).alias("found"))


def verified(each: DataFrame, rules: list[Rule]) -> DataFrame:
    """The matches of candidates: each text only against the rule that it is a candidate of."""
    chosen = lambda make: reduce(lambda rest, r: F.when(F.col("kind") == r.kind, make(r)).otherwise(rest), reversed(rules), F.array().cast("array<string>"))
    whole = chosen(lambda r: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))
    value = chosen(lambda r: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)))
    gaps = chosen(lambda r: F.split("text", r.pattern, -1))
    rows = each.select("doc_id", "h", "kind", F.posexplode(F.arrays_zip(gaps.alias("gap"), whole.alias("size"), value.alias("value"))).alias("k", "part"))
    return rows.where("part.size is not null").select("doc_id", "h", "kind", "k", *[F.length(f"part.{c}").cast("long").alias(c) for c in ("gap", "size", "value")])


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of docs: the counts of the base kinds, a digest of its base spans, and all spans as text.

    Null and empty texts have no spans.  Null and repeated ids give rows like any
    other; further columns are not read; an empty table gives an empty one.
    """
    found = secret_spans(docs, rules)
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL with the rows of secret_report over the table documents."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS rule, {quoted(r.kind)} AS kind, {r.least} AS least, {str(r.base).lower()} AS base, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS w, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS v, regexp_split_to_array(t, {quoted(r.pattern)}) AS g FROM d"
        for n, r in enumerate(rules)
    )
    written = "coalesce(string_agg(concat(kind, ':', CAST(a AS VARCHAR), ':', CAST(a + n AS VARCHAR)), ',' ORDER BY a, rule)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
k AS (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM m),
s AS (
  SELECT doc_id, rule, kind, base, length(w[k]) AS n,
    list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0) AS a
  FROM k WHERE length(v[k]) >= least)
SELECT d.doc_id, {counts},
  sha256({written} FILTER (base), '')) AS base_sha256, {written} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
