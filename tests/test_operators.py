"""Rules by hand-made cases, and properties that hold whatever the parameters."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import scalars, units
from sluice.operators import arrays, binding, cycles, fanout, graph, ports, rerun, selection, status, text, values
from sluice.sources import scans, tables
from sluice.streaming import messages


def filled(words: list[str], limit: int) -> str:
    out, n = "", 0
    for w in words:
        if n + len(w) <= limit:
            out, n = out + (" " if n > 0 else "") + w, n + len(w)
        else:
            out, n = out + "\n" + w, len(w)
        n += n + 1 <= limit
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=12), max_size=700), min_size=1, max_size=4), st.integers(1, 20))
def test_greedy_fill(spark, texts, limit):
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["filled"] for r in text.recompose(docs, limit).collect()}
    assert got == {k: filled(w, limit) for k, w in enumerate(texts)}


def test_greedy_fill_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb  cc\n\tdddddddd e"), (2, None), (3, " \n")], "doc_id long, text string")
    got = {r["doc_id"]: r["filled"] for r in text.recompose(docs, 5).collect()}
    assert got == {1: "aa bb\ncc\ndddddddd\ne", 2: "", 3: ""}
    more = {r["doc_id"]: r["filled"] for r in text.recompose(docs, 5, True).collect()}
    assert more[1] == " aa  bb\ncc\ndddddddd\ne"
    over = spark.createDataFrame([(1, "toolong a")], "doc_id long, text string")
    assert text.recompose(over, 3).first()["filled"] == "\ntoolong\na"


@pytest.mark.parametrize(("blocks", "workers"), [(1, 1), (3, 2), (20, 5), (500, 7)])
def test_fan_out_does_not_depend_on_blocks_or_workers(spark, small, blocks, workers):
    docs = tables.table(spark, small, "documents").select("doc_id", "text").limit(60)
    whole = {(r["ch"], r["n"]) for r in text.char_counts(docs).collect()}
    dealt = fanout.dispatch(fanout.fragment(docs, blocks), workers)
    parts = fanout.merge_counts(fanout.partial_counts(dealt)).collect()
    assert {(r["ch"], r["n"]) for r in parts} == whole
    assert dealt.select("block").distinct().count() <= blocks


def test_offsets_of_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(fanout, "STRETCH", 3)
    rows = spark.range(100).selectExpr("id AS k", "id % 7 AS n")
    assert {tuple(r) for r in fanout.offsets(rows, "k", "n").collect()} == {(k, sum(j % 7 for j in range(k))) for k in range(100)}


def test_units(spark):
    rows = spark.createDataFrame([("512",), ("2048K",), ("3G",), ("1T",), ("7M",), ("x",), (None,)], "m string")
    assert [r[0] for r in rows.select(units.memory_mb(F.col("m"))).collect()] == [512, 2, 3072, 1048576, 7, None, None]
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(units.elapsed_text(F.lit(12_034_567))) == "12.034"
    assert value(units.normal_path(F.lit("//a///b/"))) == "/a/b"
    assert [value(units.attempt(F.lit("1,2,3"), k)) for k in (1, 3, 9)] == ["1", "3", "3"]
    assert value(units.version_number(F.lit("1.2.3"))) == 1_002_003
    assert [value(units.is_name(F.lit(n))) for n in ("a_1", "m::p", "1a", "a b", "")] == [True, True, False, False, False]
    assert value(units.fixed_width(F.lit("abcd"), 3)) == "abc"


def test_strongest_dependency(spark):
    rows = spark.createDataFrame([("a", "afterok", 1), ("a", "afternotok", 2), ("b", "aftercorr", 1), ("b", "none", 2), ("c", "afterany", 1), ("c", "after", 2)], "p string, k string, s int")
    got = dict(rows.groupBy("p").agg(graph.strongest(F.col("k"), F.col("s"))).collect())
    assert got == {"a": "afternotok", "b": "aftercorr", "c": "afterany"}


def test_edges(spark):
    ins = spark.createDataFrame([("c", 0, "/x"), ("c", 1, "/y"), ("d", 0, "/x"), ("a", 0, "/x")], "process string, task_idx int, value string")
    outs = spark.createDataFrame([("a", 0, "/x"), ("a", 1, "/y"), ("b", 5, "/y")], "process string, task_idx int, value string")
    tasks = spark.createDataFrame([("c", 2), ("d", 1), ("a", 2)], "process string, num_tasks int")
    got = {tuple(r) for r in graph.infer_edges(ins, outs, tasks).collect()}
    assert got == {("c", "a", "aftercorr"), ("c", "b", "afterok"), ("d", "a", "afterok")}
    assert "SortAggregate" not in plan_of(graph.infer_edges(ins, outs, tasks))
    streams = spark.createDataFrame([("f", "a", "b", 1), ("f", "a", "c", 2)], "fifo string, owner string, user string, seq int")
    assert [tuple(r) for r in graph.stream_edges(streams).collect()] == [("a", "c", "none")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_broadcast_no_front(spark, monkeypatch):
    plans, kept = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (kept(df), plans.append(plan_of(df)))[0])
    nodes = spark.range(8).select(F.col("id").alias("node"))
    chain = spark.range(1, 8).select((F.col("id") - 1).alias("ancestor"), F.col("id").alias("node"))
    assert dict(graph.levels(nodes, chain).collect()) == {k: k for k in range(8)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_arguments_that_are_no_path_are_spread(spark):
    rows = spark.range(200).select("id", F.array(F.lit("-n"), F.lit("-s"), F.concat(F.lit("/o/"), F.col("id").cast("string"), F.lit("/.__VAL_DESCRIPTOR__x"))).alias("args"))
    values = spark.createDataFrame([("/o/7/.__VAL_DESCRIPTOR__x", "seven"), ("_VOID_VALUE_", "never")], "path string, value string")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = ports.with_arguments(rows, "args", values, "-s", "-n")
        sizes = [len(part) for part in got.rdd.glom().collect()]
        found = {r["id"]: (r["s"], r["n"]) for r in got.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) < 150
    assert found[7] == ("seven", "_VOID_VALUE_") and found[8] == ("/o/8/.__VAL_DESCRIPTOR__x", "_VOID_VALUE_") and len(found) == 200


def test_readiness_of_repeated_meetings(spark):
    ins = spark.createDataFrame([("c", "/x"), ("c", "/y"), ("c", "/x"), ("a", "/x")], "process string, value string")
    outs = spark.createDataFrame([("a", "/x", "FINISHED"), ("a", "/y", "FINISHED"), ("b", "/y", None)], "process string, value string, status string")
    met = graph.meetings(ins, outs)
    assert sorted((r["consumer"], r["producer"], r["status"] or "") for r in met.collect()) == [("c", "a", "FINISHED"), ("c", "a", "FINISHED"), ("c", "b", "")]
    both = met.select("consumer", F.lit("afterok").alias("deptype"), F.explode(F.array(F.lit("AND"), F.lit("OR"))).alias("conj"), "status")
    assert {(r["conj"], r["ready"]) for r in status.ready(both).collect()} == {("AND", False), ("OR", True)}


def test_paths_levels_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "ancestor string, node string")
    paths = graph.longest_paths(edges)
    assert {tuple(r) for r in paths.collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("c", "d", 1), ("b", "d", 2), ("a", "d", 3)}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "node string")
    assert dict(graph.levels(nodes, edges).collect()) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0}
    with pytest.raises(ValueError, match="cycle"):
        graph.longest_paths(spark.createDataFrame([("a", "b"), ("b", "a")], "ancestor string, node string"))
    assert graph.longest_paths(edges.limit(0)).isEmpty()
    chain = spark.range(1, 21).select((F.col("id") - 1).alias("ancestor"), F.col("id").alias("node"))
    short = chain.unionByName(spark.createDataFrame([(0, 9), (4, 20)], "ancestor long, node long"))
    assert {tuple(r) for r in graph.longest_paths(short).collect()} == {(a, b, b - a) for b in range(21) for a in range(b)}
    assert {tuple(r) for r in graph.closure(short).collect()} == {(a, b) for b in range(21) for a in range(b)}
    mutual = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "ancestor string, node string")
    assert {tuple(r) for r in graph.closure(mutual).collect()} == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"), ("a", "c"), ("b", "c")}
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, mutual)
    places = spark.createDataFrame([("a", 3), ("b", 2), ("c", 5), ("d", 1), ("e", 4)], "node string, place int")
    assert {r["node"]: r["round"] for r in graph.rounds(places, edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 0}
    with pytest.raises(ValueError, match="cycle"):
        graph.rounds(places, mutual)


def test_frequent_values_are_joined_in_slices(spark):
    left, right = spark.range(30).selectExpr("id % 2 AS v", "id AS a"), spark.range(40).selectExpr("id % 3 AS v", "id AS b")
    want = {tuple(r) for r in left.join(right, "v").select("v", "a", "b").collect()}
    assert {tuple(r) for r in graph.in_slices(left, right, "v", 4).select("v", "a", "b").collect()} == want


def test_rerun(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "1")], "process string, value string")
    new = spark.createDataFrame([("a", "2"), ("b", None), ("d", "1")], "process string, value string")
    assert dict(rerun.option_diff(old, new, "process").collect()) == {"a": "changed", "b": "unchanged", "c": "removed", "d": "new"}
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "producer string, consumer string")
    streams = spark.createDataFrame([("z", "c")], "owner string, user string")
    seeds = spark.createDataFrame([("a",)], "node string")
    first = rerun.to_rerun(seeds, deps, streams)
    assert {r[0] for r in first.collect()} == {"a", "b", "c", "z"}
    assert {r[0] for r in rerun.to_rerun(first, deps, streams).collect()} == {"a", "b", "c", "z"}
    done = spark.createDataFrame([("z",)], "process string")
    assert {r[0] for r in rerun.half_finished_streams(streams, done).collect()} == {"z", "c"}
    why = rerun.reasons({"forced": seeds, "input_change": seeds.union(done.toDF("node"))})
    assert dict(why.collect()) == {"a": ["forced", "input_change"], "z": ["input_change"]}


def test_status_and_dependencies(spark):
    states = spark.createDataFrame([("a", "FINISHED"), ("b", "FAILED"), ("c", "TO-DO"), ("d", "IN-PROGRESS")], "process string, status string")
    deps = spark.createDataFrame(
        [("p", "a", "afterok", "AND"), ("p", "b", "afternotok", "AND"), ("q", "c", "after", "OR"), ("q", "d", "after", "OR"), ("r", "b", "afterok", "AND"), ("s", "gone", "none", "AND"), ("t", "d", "afterany", "AND")],
        "consumer string, producer string, deptype string, conj string",
    )
    assert {r["consumer"]: r["ready"] for r in status.dependency_check(deps, states).collect()} == {"p": True, "q": True, "r": False, "s": True, "t": False}
    code = lambda *s: spark.createDataFrame([(x,) for x in s], "status string").agg(status.exit_code()).first()[0]
    assert [code("FINISHED"), code("FINISHED", "IN-PROGRESS"), code("TO-DO")] == [0, 2, 3]


def test_knapsack_with_precedence(spark):
    items = [("x", 10.0, [1.0, 512.0]), ("a", 5.0, [1.0, 256.0]), ("b", 7.0, [2.0, 256.0]), ("y", 8.0, [1.0, 512.0])]

    def taken(before: dict[str, list[str]], capacities: tuple[float, ...]) -> list[str]:
        rows = spark.createDataFrame([(0, *i, before.get(i[0], [])) for i in items], "g int, item string, value double, weights array<double>, before array<string>")
        return [r["item"] for r in selection.greedy_with_precedence(rows, "g", capacities).sort("place").collect()]

    before = {"a": ["x"], "b": ["x", "y"]}
    assert taken(before, (4, 4096)) == ["x", "y", "a"]
    assert taken(before, (2, 2048)) == ["x", "y"]
    assert taken({"x": ["a"], "a": ["x"]}, (1, 4096)) == ["y"]
    assert taken(before, (0, 4096)) == []
    rows = spark.createDataFrame([("x", [9.0, 1.0])], "item string, weights array<double>")
    assert selection.fitting(rows, (None, 1.0)).count() == 1
    with pytest.raises(Exception, match="never fits: x"):
        selection.fitting(rows, (8.0, None)).collect()


def test_bundles_that_can_never_fit_are_not_gathered(spark):
    n = 200
    links = spark.createDataFrame([(k - 1, k) for k in range(1, n)] + [(n, n + 1), (n + 1, n)], "ancestor long, node long")
    sizes = spark.createDataFrame([(k, 1.0, 10.0) for k in range(n + 2)], "node long, w0 double, r0 double")
    paths, gone = selection.within(links, sizes)
    assert {tuple(r) for r in paths.collect()} == {(a, b) for b in range(10) for a in range(b)} | {(n, n + 1), (n + 1, n)}
    assert {r["node"] for r in gone.collect()} == set(range(10, n))


def test_what_builds_on_one_another_counts_once(spark):
    rows = [(0, "x", 9.0, [1.0], ["a"]), (0, "a", 5.0, [1.0], ["x"]), (0, "y", 1.0, [2.0], ["x"])]
    chosen = selection.greedy_with_precedence(spark.createDataFrame(rows, "g int, item string, value double, weights array<double>, before array<string>"), "g", (2.0,))
    assert [r["item"] for r in chosen.sort("place").collect()] == ["x", "a"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 40)), min_size=1, max_size=80), st.integers(1, 30))
def test_greedy_knapsack_prunes_nothing_it_would_take(spark, items, capacity):
    rows = [(0, k, float(v), w) for k, (w, v) in enumerate(items)]
    taken, used = [], 0
    for _, k, v, w in sorted(rows, key=lambda r: (-(r[2] / (r[3] / float(capacity))), r[1])):
        if used + w <= capacity:
            taken, used = [*taken, str(k)], used + w
    got = selection.greedy(spark.createDataFrame(rows, "g long, id long, v double, w int"), "g", "id", "v", "w", capacity).collect()
    assert [(r["chosen"], r["weight"]) for r in got] == ([(",".join(taken), used)] if taken else [])


def test_binding(spark):
    rows = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "y", "v": ""})], "id int, given map<string,string>")
    wanted = [binding.Option("a", mandatory=True), binding.Option("c", default="40"), binding.Option("w"), binding.Option("v", flag=True)]
    assert [tuple(r)[2:] for r in binding.bind(rows, "given", wanted).sort("id").collect()] == [("x", "40", None, False), ("y", "40", None, True)]
    with pytest.raises(Exception, match="missing option b"):
        binding.bind(rows, "given", [binding.Option("b", mandatory=True)]).collect()
    with pytest.raises(Exception, match="missing option v"):
        binding.bind(rows, "given", [binding.Option("v", mandatory=True, flag=True)]).collect()
    kind = "process string, task_idx int, opt string, value string, ref_process string, ref_task int, ref_opt string"
    chain = spark.createDataFrame([("a", 0, "-outf", "/x", None, None, None), ("b", 0, "-inf", None, "a", 0, "-outf"), ("c", 0, "-inf", None, "b", 0, "-inf")], kind)
    assert {(r["process"], r["value"]) for r in binding.resolved(chain).collect()} == {("a", "/x"), ("b", "/x"), ("c", "/x")}
    with pytest.raises(ValueError, match="unresolved"):
        binding.resolved(chain.where("process <> 'a'"))
    merged = spark.range(1).select(binding.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2")))).first()[0]
    assert merged == {"a": "1", "b": "2"}


def test_sources_and_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("PROCESS: p ; OPTIONS: -inf /a -n 3 -flag ||| -inf /b -n 1 -n 2",), ("noise",)], "line string")
    got = {(r["process"], r["task_idx"], r["opt"]): r["value"] for r in scans.option_file(lines.where("line <> 'noise'")).collect()}
    assert got == {("p", 0, "-inf"): "/a", ("p", 0, "-n"): "3", ("p", 0, "-flag"): "", ("p", 1, "-inf"): "/b", ("p", 1, "-n"): "2"}
    for faulty, message in ((lines, "malformed line noise"), (lines.limit(1).union(lines.limit(1)), "duplicate process p"), (spark.createDataFrame([("PROCESS: p ; OPTIONS: x -n 3",)], "line string"), "unexpected token x")):
        with pytest.raises(Exception, match=message):
            scans.option_file(faulty).collect()
    tables.write_lines(lines, str(tmp_path / "t"))
    read = tables.text_lines(spark, str(tmp_path / "t"))
    assert {r["line"] for r in read.collect()} == {r["line"] for r in lines.collect()}
    assert [r["task_idx"] for r in tables.file_tasks(read).collect()] == list(range(read.select("path").distinct().count()))
    tables.write_blocks(spark.range(10), str(tmp_path / "b"), 4)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 10
    ids = spark.range(5).select(F.col("id"))
    assert tables.mark_done(ids.limit(0), ids, str(tmp_path / "m")).count() == 5
    assert tables.mark_done(spark.read.parquet(str(tmp_path / "m")), ids, str(tmp_path / "m")).count() == 0


def test_values_and_arrays(spark):
    assert [r["v"] for r in values.state_cycle(spark, 6, 2).sort("step").collect()] == [0, 1, 2, 3, 5]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "end"), (4, "c"), (5, "end")], "pos long, value string")
    assert [r["value"] for r in values.until_token(rows, "pos", F.col("value") == "end").sort("pos").collect()] == ["a", "b"]
    assert values.until_token(rows, "pos", F.col("value") == "none").count() == 5
    events = spark.createDataFrame([("p", 0, "finished", 2), ("p", 1, "finished", 2), ("q", 0, "finished", 2), ("q", 1, "start", 2)], "process string, task_idx int, kind string, total int")
    assert {r["process"]: r["finished"] for r in arrays.finished_processes(events).collect()} == {"p": True, "q": False}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k % 7, k) for k in range(40)], "id long, n long")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        messages.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "done"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == list(range(7))
    assert [r["value"] for r in messages.counter(spark, 3).collect()] == ["1", "2", "3"]


def messages_in_files(spark, path: str, files: list[list[tuple]], schema: str):
    """A stream of files, one a batch, in their order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in{k}")
        for f in Path(f"{path}/in{k}").glob("part-*"):
            os.utime(f, (1_000_000 + k, 1_000_000 + k))
            Path(path, "all").mkdir(exist_ok=True)
            shutil.copy2(f, f"{path}/all/{k}.parquet")
    return messages.folder_stream(spark, f"{path}/all", schema)


def test_streams_hold_over_several_batches(spark, tmp_path):
    files = [[("a", 1), ("b", 2)], [("a", 3)], [("c", 4), ("end", 5)], [("a", 6)]]
    state = messages.running_state(messages_in_files(spark, str(tmp_path), files, "k string, v long"), "k", "v", 5)
    assert {tuple(r) for r in state.collect()} == {("a", 3, 10.0, True), ("b", 1, 2.0, False), ("c", 1, 4.0, False), ("end", 1, 5.0, False)}
    echoed = messages.echo_until(messages.folder_stream(spark, str(tmp_path / "all"), "k string, v long"), "v", F.col("k") == "end")
    assert sorted(r["v"] for r in echoed.collect()) == [1, 2, 3, 4]
    side = spark.createDataFrame([("a", 9)], "k string, t int")
    joined = messages.drained(messages.with_side_input(messages.folder_stream(spark, str(tmp_path / "all"), "k string, v long"), side, "k"))
    assert {(r["v"], r["t"]) for r in joined.collect()} == {(1, 9), (2, None), (3, 9), (4, None), (5, None), (6, 9)}
    runs = messages.on_trigger(messages.folder_stream(spark, str(tmp_path / "all"), "k string, v long"), lambda rows: cycles.two_process_cycle(rows, "v", F.col("v")))
    assert runs.count() == sum(range(7))
    assert messages.feeder(spark, "again").isStreaming
    assert [r["v"] for r in messages.first_message(runs, "v").collect()] == [1]


def test_blocks_are_announced_as_batches_fill_them(spark, tmp_path):
    stream = messages_in_files(spark, str(tmp_path), [[(1, "a\nb"), (2, "c")], [(3, "d")], [(4, "e\nf\ng")]], "doc_id long, text string")
    got = {tuple(r) for r in messages.announced(stream, 2).collect()}
    assert got == {(0, 2, 2, 0), (1, 2, 2, 1), (2, 2, 2, 2), (3, 1, 1, None)}


def test_cycles(spark):
    rows = spark.createDataFrame([(1, 1, 6), (2, 9, 6)], "k int, v long, n long")
    got = cycles.state_cycles(rows, "k", F.col("v"), F.col("n"), F.lit(4).cast("long"), [lambda v: v + 1, lambda v: v + 2], 10)
    assert [tuple(r) for r in got.sort("step").collect()] == [(1, 0, 1, 2, 2), (1, 1, 2, 3, 5), (1, 2, 3, 5, 10), (1, 3, 5, 7, 17)]
    with pytest.raises(Exception, match="goes on after 3 rounds"):
        cycles.state_cycles(rows, "k", F.col("v"), F.col("n"), F.lit(4).cast("long"), [lambda v: v + 1, lambda v: v + 2], 3).collect()
    one_file = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("v")).coalesce(1)
    bounds = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lit(3).cast("long") + i)
    runs = cycles.state_cycles(one_file, "k", F.col("v"), F.lit(4), bounds, [lambda v: v + 1, lambda v: v + 3], 10)
    assert sum(1 for rows in runs.rdd.glom().collect() if rows) > 1
    assert {tuple(r) for r in runs.where("k = 7").collect()} == {(7, 0, 1, 2, 2), (7, 1, 2, 3, 5), (7, 2, 3, 4, 9), (7, 3, 4, 7, 16)}


def test_paths_and_arguments(spark, tmp_path):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(scalars.absolute(F.lit("../x//./y/../z"), F.lit("/a/b"))) == "/a/x/z"
    assert value(scalars.absolute(F.lit("/.."), F.lit("/a"))) == "/"
    args = F.array(*[F.lit(x) for x in ("-a", "-b", "v", "-c")])
    assert [value(scalars.argument(args, o)) for o in ("-a", "-b", "-c", "-d")] == ["_VOID_VALUE_", "v", "_VOID_VALUE_", "_OPT_NOT_FOUND_"]
    assert value(scalars.deserialised(F.lit("a<_ARG_SEP_>b c"))) == ["a", "b c"] and value(scalars.deserialised(F.lit(""))) == []
    found = ports.file_ports(spark.createDataFrame([("gone",)], "inf string"), "inf", spark.createDataFrame([("/d/f",)], "path string"), "/d")
    with pytest.raises(Exception, match="no such file: /d/gone"):
        ports.existing(found).collect()
    with pytest.raises(Exception, match="missing option inf"):
        ports.file_ports(spark.createDataFrame([(None,)], "inf string"), "inf", spark.createDataFrame([("/d/f",)], "path string"), "/d", mandatory=True).collect()
    where = tables.output_path(str(tmp_path), "p", base="q")
    tables.write_tasks(spark.createDataFrame([(0, "old"), (1, "old")], "task_idx int, v string"), where)
    tables.write_tasks(spark.createDataFrame([(1, "new")], "task_idx int, v string"), where)
    assert {tuple(r) for r in spark.read.parquet(where).select("task_idx", "v").collect()} == {(0, "old"), (1, "new")}
