"""Process graphs: edges inferred from shared values, closures, levels, validity of specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.units import PRIORITY, attempts, attempt, attributes, is_name, memory_mb
from sluice.sources.tables import cut


def strongest(kind: Column, order: Column) -> Column:
    """The kind of dependency that stays of several edges to one producer: by priority, of equals the later one."""
    rank = F.create_map(*[F.lit(x) for k, n in PRIORITY.items() for x in (k, n)])
    return F.max_by(kind, F.struct(rank[kind], order))


def infer_edges(inputs: DataFrame, outputs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows (consumer, producer, deptype): a process that takes a value which another one puts out depends on it.

    inputs, outputs: (process, task_idx, value).  tasks: (process, num_tasks).
    Edges between tasks of one index of a consumer of several tasks are
    aftercorr, others afterok; of several to one producer the strongest stays.
    """
    n = max(inputs.sparkSession.sparkContext.defaultParallelism, -(-(inputs.count() + outputs.count()) // 100_000))  # tasks grow in number, not in size
    met = meetings(inputs.join(tasks, "process").withColumnRenamed("task_idx", "i"), outputs.withColumnRenamed("task_idx", "j"), n)
    ok = F.coalesce((F.col("num_tasks") <= 1) | (F.col("i") != F.col("j")), F.lit(True))
    each = met.select("consumer", "producer", ok.alias("ok")).repartition(n, "consumer", "producer")
    return each.groupBy("consumer", "producer").agg(F.bool_or("ok").alias("ok")).select("consumer", "producer", F.when(F.col("ok"), "afterok").otherwise("aftercorr").alias("deptype"))


def meetings(inputs: DataFrame, outputs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (consumer, producer, value, ...): each time that a process takes a value which another one puts out, with the further columns of both.

    inputs, outputs: (process, value, ...), each row counted once; an edge may
    come several times.
    """
    takes, puts = inputs.distinct().withColumnRenamed("process", "consumer"), outputs.distinct().withColumnRenamed("process", "producer")
    return in_slices(takes, puts, "value", parts=parts).where("consumer <> producer")


def in_slices(left: DataFrame, right: DataFrame, key: str, size: int = 10_000, parts: int | None = None) -> DataFrame:
    """left joined with right on key, where the right rows of a frequent key are cut into slices of about `size`, each joined by itself.

    The frequent keys, one for `size` rows at most, are broadcast.  The join is
    made in so many parts, if they are given.
    """
    often = F.broadcast(right.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("_slices")).where("_slices > 1"))
    slices = lambda df: df.join(often, key, "left").withColumn("_slices", F.coalesce("_slices", F.lit(1)))
    dealt = slices(right).withColumn("_slice", F.pmod(F.xxhash64(*right.columns), F.col("_slices")).cast("int")).drop("_slices")
    each = slices(left).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    if parts is not None:
        each, dealt = each.repartition(parts, key, "_slice"), dealt.repartition(parts, key, "_slice")
    return each.join(dealt, [key, "_slice"]).drop("_slice")


def stream_edges(streams: DataFrame) -> DataFrame:
    """Rows (owner, user, deptype) of streams (fifo, owner, user, seq): the last user of a stream counts, and nothing waits for it."""
    return streams.groupBy("fifo", "owner").agg(F.max_by("user", "seq").alias("user")).where("owner <> user").select("owner", "user", F.lit("none").alias("deptype")).distinct()


def option_arcs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Rows (producer, producer_task, consumer, consumer_task, value): the arcs from outputs to the inputs with their value."""
    puts = outputs.select(F.col("process").alias("producer"), F.col("task_idx").alias("producer_task"), "value").distinct()
    takes = inputs.select(F.col("process").alias("consumer"), F.col("task_idx").alias("consumer_task"), "value").distinct()
    return in_slices(takes, puts, "value").where("producer <> consumer").select("producer", "producer_task", "consumer", "consumer_task", "value")


def stream_owners(streams: DataFrame) -> DataFrame:
    """Rows (user, owners): whose streams a process reads, each owner once and in order."""
    return streams.where("owner <> user").groupBy("user").agg(F.array_join(F.array_sort(F.collect_set(F.col("owner").cast("string"))), ",").alias("owners"))


def both_ways(streams: DataFrame) -> DataFrame:
    """Rows (item, partner): the two ends of a stream, each with the other, as they run together or not at all."""
    there = streams.select(F.col("owner").alias("item"), F.col("user").alias("partner"))
    return there.unionByName(there.select(F.col("partner").alias("item"), F.col("item").alias("partner"))).where("item <> partner").distinct()


def closure(edges: DataFrame, most: int = 40) -> DataFrame:
    """Rows (ancestor, node): all that a node is reached from, in a graph that may have cycles; a node on one is its own ancestor.

    edges: (ancestor, node).  Pairs are found by their shortest ways, which
    double in length with each join.
    """
    found, reach = cut(edges.select("ancestor", "node").distinct().withColumn("steps", F.lit(1).cast("long"))), 1
    for _ in range(most):
        far = found.where(F.col("steps") == reach)
        if far.isEmpty():
            return found.select("ancestor", "node")
        found, reach = cut(found.unionByName(beyond(far, found, reach)).groupBy("ancestor", "node").agg(F.min("steps").alias("steps"))), 2 * reach
    raise RuntimeError("the closure has not settled")


def beyond(far: DataFrame, found: DataFrame, reach: int) -> DataFrame:
    """Rows (ancestor, node, steps): the ways of far, all of `reach` steps, and then one of found.

    The first `reach` steps of a shortest way are a shortest way themselves, as
    of a longest one in an acyclic graph, so these ways are all that is new up
    to twice the length, and each is found by few joins.
    """
    onward = found.select(F.col("ancestor").alias("node"), F.col("node").alias("further"), "steps")
    return far.select("ancestor", "node").join(onward, "node").select("ancestor", F.col("further").alias("node"), (F.col("steps") + reach).alias("steps"))


def rounds(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows (node, place, round) in the order of a file: a node goes in the first pass over the file in which all that it needs has gone before it.

    nodes: (node, place), places different; edges: (ancestor, node).  Nodes
    whose ancestors have all gone are peeled off, front by front; a cycle raises
    an error.  Sorted by round and place it is the order that entries run in.
    """
    left = cut(nodes.select("node", "place").join(edges.groupBy("node").agg(F.count("*").alias("needs")), "node", "left").select("node", "place", F.coalesce("needs", F.lit(0)).alias("needs"), F.lit(0).cast("long").alias("round")))
    places = nodes.select(F.col("node").alias("ancestor"), F.col("place").alias("_place"))
    links = cut(edges.join(places, "ancestor").select("ancestor", "node", "_place"))
    done = None
    for _ in range(most):
        front = cut(left.where("needs = 0"))
        if front.isEmpty():
            break
        done = front if done is None else done.unionByName(front)
        told = links.join(front.select(F.col("node").alias("ancestor"), F.col("round").alias("_round")).hint("merge"), "ancestor")
        got = told.groupBy("node").agg(F.count("*").alias("_met"), F.array_agg(F.struct("_round", "_place")).alias("_from"))
        latest = lambda: F.array_max(F.transform("_from", lambda x: x["_round"] + F.when(x["_place"] > F.col("place"), 1).otherwise(0)))
        rest = left.where("needs > 0").join(got.hint("merge"), "node", "left")
        left = cut(rest.select("node", "place", (F.col("needs") - F.coalesce("_met", F.lit(0))).alias("needs"), F.greatest("round", F.coalesce(latest().cast("long"), F.lit(0))).alias("round")))
    if not left.where("needs > 0").isEmpty():
        raise ValueError("the graph has a cycle")
    empty = nodes.select("node", "place", F.lit(0).cast("long").alias("round")).limit(0)
    return (empty if done is None else done).select("node", "place", "round")


def longest_paths(edges: DataFrame, most: int = 40) -> DataFrame:
    """Rows (ancestor, node, steps): all that is reached from a node of an acyclic graph, and the longest way there.

    edges: (ancestor, node).  Paths double in length with each join, so there
    are as many joins as the longest path has binary digits.  A cycle never
    settles and raises an error.
    """
    paths, reach = cut(edges.select("ancestor", "node", F.lit(1).cast("long").alias("steps")).distinct()), 1
    for _ in range(most):
        if not paths.where("ancestor = node").isEmpty():
            raise ValueError("the graph has a cycle")
        far = paths.where(F.col("steps") == reach)
        if far.isEmpty():
            return paths
        paths, reach = cut(paths.unionByName(beyond(far, paths, reach)).groupBy("ancestor", "node").agg(F.max("steps").alias("steps"))), 2 * reach
    raise ValueError("the graph has a cycle")


def levels(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows (node, level): 0 for a node without ancestors, else the longest way to it; sorted by level it is a topological order.

    edges: (ancestor, node).  Nodes whose ancestors have all gone are peeled
    off, level by level; a cycle raises an error.  The fronts are all nodes
    together, so none is broadcast.
    """
    needs = edges.distinct().groupBy("node").agg(F.count("*").alias("needs"))
    left = cut(nodes.select("node").distinct().join(needs.hint("merge"), "node", "left").select("node", F.coalesce("needs", F.lit(0)).alias("needs")))
    links, done = cut(edges.select("ancestor", "node").distinct()), None
    for level in range(most):
        front = cut(left.where("needs = 0").select("node"))
        if front.isEmpty():
            break
        own = front.select("node", F.lit(level).cast("long").alias("level"))
        done = own if done is None else done.unionByName(own)
        met = links.join(front.select(F.col("node").alias("ancestor")).hint("merge"), "ancestor").groupBy("node").agg(F.count("*").alias("met"))
        left = cut(left.where("needs > 0").join(met.hint("merge"), "node", "left").select("node", (F.col("needs") - F.coalesce("met", F.lit(0))).alias("needs")))
    if not left.isEmpty():
        raise ValueError("the graph has a cycle")
    return nodes.select("node", F.lit(0).cast("long").alias("level")).limit(0) if done is None else done


def reached(seeds: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """The nodes that the seeds reach, themselves included, in a graph of any kind.  seeds: (node); edges: (node, following)."""
    edges = cut(edges.select("node", "following").distinct())
    found = front = cut(seeds.select("node").distinct())
    for turn in range(most):
        front = cut(front.join(edges, "node").select(F.col("following").alias("node")).distinct().join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)  # each front is stored once; what was found before is written again only now and then
        found = cut(found) if turn % 32 == 31 else found
    raise RuntimeError("the marks have not settled")


def parsed_specs(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Specifications `name k=v; ... ||| k=v; ...` as columns: resources of the first two attempts, dependencies, validity."""
    head = F.trim(F.element_at(F.split(column, r"\|\|\|", -1), 1))
    tail = F.trim(F.coalesce(F.get(F.split(column, r"\|\|\|", -1), F.lit(1)), F.lit("")))
    name = F.regexp_extract(head, r"^(\S+)", 1)
    named = specs.withColumns({"process": name, "_a": attributes(F.trim(F.regexp_replace(head, r"^\S+\s*", ""))), "_b": attributes(tail)})
    a, b = (lambda k: F.try_element_at("_a", F.lit(k))), (lambda k: F.try_element_at("_b", F.lit(k)))
    deps = F.filter(F.split(F.coalesce(b("processdeps"), F.lit("")), "[,?]", -1), lambda d: d != "")
    return named.select(
        "process",
        a("cpus").cast("int").alias("cpus"),
        memory_mb(attempt(a("mem"), 1)).alias("mem_mb"),
        memory_mb(attempt(a("mem"), 2)).alias("mem_mb_2"),
        attempts(a("mem"), a("time")).cast("int").alias("n_attempts"),
        a("throttle").cast("int").alias("throttle"),
        F.split_part(F.get(deps, F.lit(0)), F.lit(":"), F.lit(1)).alias("deptype"),
        F.split_part(F.get(deps, F.lit(0)), F.lit(":"), F.lit(2)).alias("producer"),
        (b("force") == "yes").alias("forced"),
        (is_name(name) & F.contains(column, F.lit("|||"))).alias("valid"),
    )


def spec_dependencies(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Rows (process, conj, place, deptype, producer): all dependencies of each specification, which commas join by AND and question marks by OR."""
    parts = F.split(column, r"\|\|\|", -1)
    name = F.regexp_extract(F.trim(F.get(parts, F.lit(0))), r"^(\S+)", 1)
    text = F.coalesce(F.try_element_at(attributes(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))), F.lit("processdeps")), F.lit(""))
    each = specs.select(name.alias("process"), F.when(F.contains(text, F.lit("?")), "OR").otherwise("AND").alias("conj"), F.posexplode(F.filter(F.split(text, "[,?]", -1), lambda d: d != "")).alias("place", "dep"))
    return each.select("process", "conj", F.col("place").cast("long").alias("place"), F.split_part("dep", F.lit(":"), F.lit(1)).alias("deptype"), F.split_part("dep", F.lit(":"), F.lit(2)).alias("producer"))


def invalid_specs(parsed: DataFrame) -> DataFrame:
    """Rows (process, problem): names that are malformed or stand twice, and producers that are no process."""
    bad = parsed.where("not valid").select("process", F.lit("malformed").alias("problem"))
    twice = parsed.groupBy("process").agg(F.count("*").alias("n")).where("n > 1").select("process", F.lit("duplicated").alias("problem"))
    known = parsed.select(F.col("process").alias("producer")).distinct()
    missing = parsed.where("producer <> ''").join(known, "producer", "left_anti").select("process", F.lit("unknown producer").alias("problem"))
    return bad.unionByName(twice).unionByName(missing).distinct()


def as_dot(edges: DataFrame, source: str = "producer", target: str = "consumer", kind: str = "deptype") -> DataFrame:
    """A line of the graph's DOT text for each edge."""
    return edges.select(F.format_string('"%s" -> "%s" [label="%s"];', F.col(source).cast("string"), F.col(target).cast("string"), F.col(kind)).alias("line"))
