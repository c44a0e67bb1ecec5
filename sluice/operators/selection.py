"""Selection of tasks under limited resources: a greedy knapsack, with and without precedence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.graph import beyond
from sluice.sources.tables import cut


def greedy(items: DataFrame, group: str, item: str, value: str, weight: str, capacity: int) -> DataFrame:
    """Rows (group, n_items, weight, chosen): items taken by falling value per weight while they fit, ties by id.

    Weights are positive whole numbers.  At most capacity / w items of weight w
    can be taken, and those are the first of that weight, so a group's fold
    never sees more than capacity * (1 + 1/2 + 1/3 + ...) items, however large
    the group is.  chosen: the ids in the order taken, comma-joined.
    """
    ratio = F.col(value) / (F.col(weight) / F.lit(float(capacity)))
    usable = items.where((F.col(weight) > 0) & (F.col(weight) <= capacity)).select(group, item, F.col(weight).cast("int").alias("_w"), ratio.alias("_r"))
    of_weight = Window.partitionBy(group, "_w").orderBy(F.desc("_r"), item)
    able = usable.withColumn("_n", F.row_number().over(of_weight)).where(F.col("_n") <= F.floor(F.lit(capacity) / F.col("_w")))
    ordered = able.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(item).alias("id"), F.col("_w").alias("w")))).alias("_all"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"))
    take = lambda s, x: F.when(s["used"] + x["w"] <= capacity, F.struct((s["used"] + x["w"]).alias("used"), F.concat(s["ids"], F.array(x["id"].cast("string"))).alias("ids"))).otherwise(s)
    done = ordered.select(group, F.aggregate("_all", start, take).alias("s"))
    return done.select(group, F.size("s.ids").cast("long").alias("n_items"), F.col("s.used").cast("long").alias("weight"), F.array_join("s.ids", ",").alias("chosen"))


def priorities(items: DataFrame, group: str, capacities: tuple[float, ...]) -> DataFrame:
    """Rows (group, item, priority) of items (group, item, value, weights): value per summed share of the capacities.

    Shares of a capacity of 0 do not count, and a sum of 0 counts as 1e-9.
    """
    shares = [F.get("weights", F.lit(k)) / F.lit(c) for k, c in enumerate(capacities) if c]
    total = reduce(Column.__add__, shares, F.lit(0.0))
    return items.select(group, "item", (F.col("value") / F.when(total == 0, 1e-9).otherwise(total)).alias("priority"))


def fitting(items: DataFrame, capacities: tuple[float | None, ...]) -> DataFrame:
    """The items (item, weights, ...); one that no capacity can ever hold raises an error.  A capacity of None is unlimited."""
    fits = reduce(Column.__and__, [F.get("weights", F.lit(k)) <= F.lit(float(c)) for k, c in enumerate(capacities) if c is not None], F.lit(True))
    return items.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("never fits: "), F.col("item").cast("string"))).cast("boolean")))


def resources_left(tasks: DataFrame, group: str, cpus: int | None, memory: int | None) -> DataFrame:
    """Rows (group, used_cpus, used_mem, free_cpus, free_mem): what tasks (group, status, cpus, mem) in progress hold; null is unlimited."""
    live = lambda c: F.sum(F.when(F.col("status") == "IN-PROGRESS", F.col(c)).otherwise(0)).cast("long")
    used = tasks.groupBy(group).agg(live("cpus").alias("used_cpus"), live("mem").alias("used_mem"))
    return used.withColumns({"free_cpus": F.lit(cpus).cast("long") - F.col("used_cpus"), "free_mem": F.lit(memory).cast("long") - F.col("used_mem")})


def selectable(tasks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (process, task_idx, value, weights) of tasks (process, task_idx, cpus, mem): a task's value is one over its array's size (process, size)."""
    weights = F.array(F.col("cpus").cast("double"), F.col("mem").cast("double"))
    return tasks.join(sizes, "process").select("process", "task_idx", (F.lit(1.0) / F.col("size")).alias("value"), weights.alias("weights"))


def totals(items: DataFrame, chosen: DataFrame, group: str, weights: int) -> DataFrame:
    """Rows (group, n, value, weight0, ...): the sums over the chosen (group, item) of items."""
    picked = items.join(chosen.select(group, "item"), [group, "item"])
    return picked.groupBy(group).agg(F.count("*").alias("n"), F.sum("value").alias("value"), *[F.sum(F.get("weights", F.lit(k))).alias(f"weight{k}") for k in range(weights)])


def within(links: DataFrame, sizes: DataFrame, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """Rows (ancestor, node) of all others that a node builds on, without the nodes that can never fit; and those (node).

    links: (ancestor, node); sizes: (node, w0, ..., r0, ...), what a node takes
    and what there is room for.  A node goes as soon as what is known of its
    bundle exceeds the room, or one that it builds on has gone, so no node
    gathers much more than fits.
    """
    ws, rooms = [c for c in sizes.columns if c[0] == "w"], [c for c in sizes.columns if c[0] == "r"]
    taken = sizes.select(F.col("node").alias("ancestor"), *ws)
    gone = cut(sizes.where(reduce(Column.__or__, [F.col(w) > F.col(r) for w, r in zip(ws, rooms, strict=True)], F.lit(False))).select("node"))
    left, of_node = sizes.select("node", *[(F.col(r) - F.col(w)).alias(r) for w, r in zip(ws, rooms, strict=True)]), Window.partitionBy("node")
    found, reach, more = links.distinct().withColumn("steps", F.lit(1).cast("long")).join(taken, "ancestor"), 1, True
    for _ in range(most):
        lost = found.join(gone.select(F.col("node").alias("ancestor"), F.lit(True).alias("lost")), "ancestor", "left").join(left, "node")
        over = reduce(Column.__or__, [F.sum(w).over(of_node) > F.col(r) for w, r in zip(ws, rooms, strict=True)], F.max(F.coalesce("lost", F.lit(False))).over(of_node))
        judged = cut(lost.select("ancestor", "node", "steps", *ws, F.coalesce(over, F.lit(False)).alias("over")))
        going = judged.where("over").select("node").distinct()
        found, far = judged.where("not over").drop("over"), judged.where(~F.col("over") & (F.col("steps") == reach))
        none_new, more = going.isEmpty(), more and not far.isEmpty()
        if none_new and not more:
            return found.select("ancestor", "node"), gone
        gone = cut(gone.unionByName(going))
        if more:
            onward = beyond(far, found.select("ancestor", "node", "steps"), reach).where("ancestor <> node").join(taken, "ancestor")
            found, reach = found.unionByName(onward).groupBy("ancestor", "node").agg(F.min("steps").alias("steps"), *[F.first(w).alias(w) for w in ws]), 2 * reach
    raise RuntimeError("the bundles have not settled")


def greedy_with_precedence(items: DataFrame, group: str, capacities: tuple[float, ...]) -> DataFrame:
    """Rows (group, item, place) taken of items (group, item, value, weights, before), each with all that it builds on, together or not at all.

    By falling priority, ties by item; what an item builds on goes in the same
    order.  Items that build on one another stand or fall together, and unknown
    ones are taken as done.  What each item builds on is found by joins, without
    the items whose bundles exceed a capacity: all that has been taken stays, so
    those never fit.  The others of one group, the waiting tasks of one program,
    are then folded in order.
    """
    of_group = Window.partitionBy(group)
    weight = [F.get("weights", F.lit(k)) for k in range(len(capacities))]
    spare = [F.sum(F.least(w, F.lit(0.0))).over(of_group) for w in weight]  # what weights below 0 may give back
    room = [F.lit(float(c)) - s + (abs(c) - s) * 1e-6 for c, s in zip(capacities, spare, strict=True)]  # the fold decides what rounding might
    order = F.row_number().over(of_group.orderBy(F.desc("priority"), "item"))
    numbered = items.join(priorities(items, group, capacities), [group, "item"]).select(group, "item", "weights", order.alias("rank"), *[r.alias(f"r{k}") for k, r in enumerate(room)])
    ranked = cut(numbered.withColumn("node", F.monotonically_increasing_id()))
    edges = items.select(group, "item", F.explode("before").alias("b")).where("b is not null and b <> item")
    edges = edges.join(ranked.select(group, F.col("item").alias("b"), F.col("node").alias("ancestor")), [group, "b"]).join(ranked.select(group, "item", "node"), [group, "item"])
    paths, gone = within(edges.select("ancestor", "node"), ranked.select("node", *[w.alias(f"w{k}") for k, w in enumerate(weight)], *[f"r{k}" for k in range(len(capacities))]))
    able = ranked.join(gone, "node", "left_anti")
    own = able.select(F.col("node").alias("ancestor"), "node").unionByName(paths)
    bundles = own.join(ranked.select(F.col("node").alias("ancestor"), F.struct("rank", F.col("item").alias("id"), "weights").alias("x")), "ancestor")
    each = bundles.groupBy("node").agg(F.array_sort(F.collect_list("x")).alias("bundle"))
    listed = each.join(able.select("node", group, "rank"), "node").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "bundle"))).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array(*[F.lit(0.0)] * len(capacities)).alias("used"))

    def adding(k: int) -> Callable[[Column, Column], Column]:
        return lambda a, b: a + F.get(b["weights"], F.lit(k))

    def put(state: Column, x: Column) -> Column:
        missing = F.filter(x["bundle"], lambda b: ~F.array_contains(state["taken"], b["id"]))
        need = F.array(*[F.aggregate(missing, F.get(state["used"], F.lit(k)), adding(k)) for k in range(len(capacities))])
        fits = reduce(Column.__and__, [F.get(need, F.lit(k)) <= float(c) for k, c in enumerate(capacities)])
        more = F.struct(F.concat(state["taken"], F.transform(missing, lambda b: b["id"])).alias("taken"), need.alias("used"))
        return F.when(fits, more).otherwise(state)

    done = listed.select(group, F.aggregate("all", start, put)["taken"].alias("taken"))
    return done.select(group, F.posexplode("taken").alias("place", "item")).select(group, "item", F.col("place").cast("long").alias("place"))
