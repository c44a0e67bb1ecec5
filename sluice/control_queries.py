"""Queries on ports, scans, reruns, status, selection and streams over the driver's tables, and their SQL.

Parts stand for processes, orders and their line items for processes and their
tasks, events for messages.  Texts of files are made up of a table's columns by
expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import scalars, units
from sluice.operators import arrays, attempts, binding, cycles, graph, ports, rerun, selection, status, text, values
from sluice.queries import statuses
from sluice.sources import scans, tables
from sluice.sources.tables import table
from sluice.streaming import messages


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size", "p_retailprice")


def lines_of(rows: DataFrame, line: str) -> DataFrame:
    """Rows (lineno, line) of a file that is made up of rows (k, ...)."""
    return rows.select((F.col("k") + 1).alias("lineno"), F.expr(line).alias("line"))


K = "CAST(k AS VARCHAR(20))"
PART = "p AS (SELECT p_partkey AS k, p_name, p_size, p_retailprice FROM part)"

# Files and texts.

FILE = f"CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '_NONE_' WHEN 2 THEN concat('/abs/x', CAST(k % 50 AS VARCHAR(20))) ELSE concat('in/f', CAST(k % 50 AS VARCHAR(20))) END"


def q30_file_ports(spark, sf_dir):
    files = spark.range(40).select(F.concat(F.lit("/data/in/f"), F.col("id").cast("string")).alias("path")).unionByName(spark.range(25).select(F.concat(F.lit("/abs/x"), F.col("id").cast("string")).alias("path")))
    rows = part(spark, sf_dir).select("k", F.expr(FILE).alias("inf"))
    return ports.file_ports(rows, "inf", files, "/data", default="in/f1").select("k", "path", "state")


def q31_nth_line(spark, sf_dir):
    return scans.nth_line(table(spark, sf_dir, "documents"), 2)


def q32_task_options(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("process"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    tasks = arrays.in_blocks(arrays.task_array(rows, "process", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), 3)
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("process"), (F.col("o_orderkey") % 4).alias("task_idx"))
    return tables.task_options(tasks.select("process", "block", "place", "l_partkey"), wanted, 3).select("process", "task_idx", "l_partkey")


ENTRY = f"CASE k % 5 WHEN 0 THEN '  # a comment' WHEN 1 THEN '   ' ELSE concat('p', {K}, ' cpus=1') END"


def q33_spec_lines(spark, sf_dir):
    return scans.entries(lines_of(part(spark, sf_dir), ENTRY)).select("lineno", "line")


EXHAUSTIVE = f"CASE WHEN k % 9 = 0 THEN concat('p', {K}, '__ELEMSEP__', '__LEN__ -> 3') ELSE concat('p', {K}, '__ELEMSEP__', CAST(k % 3 AS VARCHAR(20)), ' -> -a<_ARG_SEP_>v', {K}, '<_ARG_SEP_>-outf<_ARG_SEP_>/out/v', CAST(k % 100 AS VARCHAR(20))) END"


def q34_exhaustive_scan(spark, sf_dir):
    found = scans.exhaustive_options(lines_of(part(spark, sf_dir), EXHAUSTIVE))
    return found.select("process", "task_idx", F.size("args").cast("long").alias("n_args"), F.get("args", F.lit(1)).alias("a"))


def q34b_output_values(spark, sf_dir):
    return scans.output_values(scans.exhaustive_options(lines_of(part(spark, sf_dir), EXHAUSTIVE)))


STREAM = f"concat('s', CAST(k % 40 AS VARCHAR(20)), ' p', CAST(k % 40 AS VARCHAR(20)), '__ELEMSEP__0 p', {K}, '__ELEMSEP__', CAST(k % 3 AS VARCHAR(20)))"


def q35_stream_scan(spark, sf_dir):
    return scans.stream_file(lines_of(part(spark, sf_dir), STREAM))


OPTIONS = f"CASE WHEN k % 10 = 0 THEN '' ELSE concat('PROCESS: p', {K}, ' ; OPTIONS: -a v', {K}, ' -b -c x ', CASE WHEN k % 2 = 0 THEN '||| -a w ' ELSE '' END, CASE WHEN k % 3 = 0 THEN '-a z' ELSE '' END) END"


def q36_option_scan(spark, sf_dir):
    return scans.option_file(lines_of(part(spark, sf_dir), OPTIONS))


STATUS_LINE = f"CASE WHEN k % 6 = 0 THEN '* a note' ELSE concat('PROCESS: p', {K}, ' ; STATUS: ', CASE WHEN k % 2 = 0 THEN 'FINISHED' ELSE 'TO-DO' END) END"


def q37_status_scan(spark, sf_dir):
    return scans.status_lines(lines_of(part(spark, sf_dir), STATUS_LINE))


ITEM = f"CASE WHEN k % 8 = 0 THEN ' ' ELSE concat('p', {K}, ' 0.5 ', CAST(k % 4 + 1 AS VARCHAR(20)), ' ', CAST(k % 4 * 512 AS VARCHAR(20))) END"
DEP = "concat('p', CAST(k AS VARCHAR(20)), ' p', CAST(k + 3 AS VARCHAR(20)))"


def q38_selection_scan(spark, sf_dir):
    items = scans.selection_items(lines_of(part(spark, sf_dir), ITEM), 2)
    return items.select("item", "value", F.get("weights", F.lit(0)).alias("cpus"), F.get("weights", F.lit(1)).alias("mem"))


def q38b_selection_deps(spark, sf_dir):
    items = scans.selection_items(lines_of(part(spark, sf_dir), ITEM), 2)
    return scans.selection_deps(lines_of(part(spark, sf_dir), DEP), items)


def q39_random_lines(spark, sf_dir):
    return scans.random_lines(spark.range(200).select(F.col("id").alias("line_no")), 70, 7)


def q40_counter(spark, sf_dir):
    return messages.counter(spark, 1000, token=True)


# Values, arguments, predicates.

ARGS = ["'-s'", f"concat('/out/', {K}, '/.__VAL_DESCRIPTOR__x')", "'-n'", "'-x'", "'plain'", "'-outv'", f"concat('/out/', {K}, '/.__VAL_DESCRIPTOR__x')"]


def q41_passed_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    path = F.concat(F.lit("/out/"), F.col("k").cast("string"), F.lit("/.__VAL_DESCRIPTOR__x"))
    known = ports.written_values(orders.where("k % 3 = 0"), path, F.col("k") * 2)
    rows = orders.select("k", F.array(*[F.expr(a) for a in ARGS]).alias("args"))
    return ports.with_arguments(rows, "args", known, "-s", "-n", "-x", "-z", "-outv").drop("args")


VALUE = f"CASE k % 12 WHEN 0 THEN concat('-a', {K}) WHEN 1 THEN '--outf' WHEN 2 THEN concat('/d/', {K}) WHEN 3 THEN '/d/.__VAL_DESCRIPTOR__v' WHEN 4 THEN '__PROC_OUT_OPT_DESCRIPTOR__p' WHEN 5 THEN {K} WHEN 6 THEN concat('p::q', {K}) WHEN 7 THEN 'my_optlist' WHEN 8 THEN '' WHEN 9 THEN '-out' WHEN 10 THEN concat({K}, 'x') ELSE 'a b' END"


def q42_predicates(spark, sf_dir):
    v = F.col("v")
    rows = part(spark, sf_dir).select("k", F.expr(VALUE).alias("v"))
    tests = {"is_option": scalars.is_option(v), "is_output": units.is_output(v), "is_absolute": units.is_absolute(v), "is_natural": scalars.is_natural(v), "is_output_reference": scalars.is_output_reference(v), "is_value_reference": scalars.is_value_reference(v), "is_list_name": scalars.is_list_name(v), "is_name": units.is_name(v)}
    return rows.select("k", *[test.alias(name) for name, test in tests.items()])


def q43_generated(spark, sf_dir):
    rows = part(spark, sf_dir).select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("process"), "k")
    return ports.generated(rows, F.col("k") % 4, {"-i": F.col("task_idx") * 10, "-f": F.concat("process", F.lit("_"), F.col("task_idx").cast("string"))})


def q44_resolved(spark, sf_dir):
    rows = part(spark, sf_dir)
    refers = F.col("k") % 6 != 0
    name = lambda k: F.concat(F.lit("p"), k.cast("string"))
    only = lambda c: F.when(refers, c)
    options = rows.select(
        name(F.col("k")).alias("process"),
        F.lit(0).cast("long").alias("task_idx"),
        F.lit("-v").alias("opt"),
        F.when(~refers, F.concat(F.lit("v"), F.col("k").cast("string"))).alias("value"),
        only(name(F.col("k") - 1)).alias("ref_process"),
        only(F.lit(0).cast("long")).alias("ref_task"),
        only(F.lit("-v")).alias("ref_opt"),
    )
    return binding.resolved(options)


def task_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("process"), F.col("l_linenumber").alias("task_idx"), "l_partkey", "l_returnflag")
    path = F.concat(F.when(F.col("l_partkey") % 3 == 0, "v/").otherwise("/v/"), F.col("l_partkey").cast("string"))
    opt = F.when(F.col("l_returnflag") == "A", "-outf").otherwise("-inf")
    each = rows.select("process", "task_idx", opt.alias("opt"), path.alias("value"), "l_returnflag")
    return each.where("l_returnflag = 'R'").drop("l_returnflag"), each.where("l_returnflag = 'A'").drop("l_returnflag")


def q45_candidates(spark, sf_dir):
    inputs, outputs = task_paths(spark, sf_dir)
    return ports.candidates(inputs.distinct(), outputs)


def q46_stream_edges(spark, sf_dir):
    streams = part(spark, sf_dir).select((F.col("k") % 40).alias("fifo"), (F.col("k") % 40).alias("owner"), (F.col("k") % 90).alias("user"), F.col("k").alias("seq"))
    return graph.stream_edges(streams)


def q46b_stream_owners(spark, sf_dir):
    return graph.stream_owners(part(spark, sf_dir).select((F.col("k") % 40).alias("owner"), (F.col("k") % 90).alias("user")))


def q47_output_index(spark, sf_dir):
    return ports.output_index(task_paths(spark, sf_dir)[1])


def q47b_array_sizes(spark, sf_dir):
    inputs, outputs = task_paths(spark, sf_dir)
    return ports.array_sizes(inputs.unionByName(outputs).select("process", "task_idx", "opt"))


# Reruns.


def snapshots(spark, sf_dir):
    """Options of parts as processes, three tasks each: an older and a newer snapshot."""
    tasks = part(spark, sf_dir).withColumn("task_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    own = F.concat(F.lit("t"), F.col("task_idx").cast("string"))

    def options(rows: DataFrame, value) -> DataFrame:
        named = F.array(F.struct(F.lit("-id").alias("opt"), own.alias("value")), F.struct(F.lit("-v").alias("opt"), value.alias("value")))
        plain = F.array(F.struct(F.lit("-v").alias("opt"), value.alias("value")))
        return rows.withColumn("x", F.explode(F.when(F.col("k") % 2 == 0, named).otherwise(plain))).select(F.col("k").alias("process"), "task_idx", "x.opt", "x.value")

    plain = F.col("task_idx").cast("string")
    edited = F.when((F.col("k") % 101 == 7) & (F.col("task_idx") == 1), "edited").otherwise(plain)
    old = options(tasks.where("k % 53 <> 0"), plain)
    new = options(tasks.where("k % 59 <> 0 AND NOT (k % 103 = 9 AND task_idx = 2)"), edited)
    return old, new


def q48_array_diff(spark, sf_dir):
    return rerun.array_diff(*snapshots(spark, sf_dir))


def q48b_diff_lists(spark, sf_dir):
    return rerun.diff_lists(rerun.array_diff(*snapshots(spark, sf_dir)))


def q48c_to_rerun(spark, sf_dir):
    seeds = rerun.changed_seeds(rerun.array_diff(*snapshots(spark, sf_dir)))
    return seeds["new_process"].unionByName(seeds["input_change"]).distinct().select(F.col("node").alias("process"))


def rerun_parts(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    rows = part(spark, sf_dir)
    state = F.when(F.col("k") % 3 == 0, "TO-DO").otherwise("FINISHED")
    processes = rows.select(F.col("k").alias("process"), (F.col("k") % 10).alias("module"), state.alias("status"), F.when(F.col("k") % 211 != 3, F.col("k")).alias("ran_at"))
    modules = spark.range(10).select(F.col("id").alias("module"), F.when(F.col("id") == 4, 40).otherwise(0).cast("long").alias("changed_at"))
    streams = rows.where("k % 61 = 0").select(F.col("k").alias("owner"), (F.col("k") + 1).alias("user")).join(rows.select(F.col("k").alias("user")), "user")
    marks = rerun.changed_seeds(rerun.array_diff(old, new))
    marks |= {"forced": rows.where("k % 401 = 11").select(F.col("k").alias("node")), "outdated_code": rerun.outdated(processes, modules)}
    marks["process_status_fifo_user_owner"] = rerun.half_finished_streams(streams, processes.where("status = 'FINISHED'"))
    down = rows.where("k % 16 <> 0").select((F.col("k") - 1).alias("producer"), F.col("k").alias("consumer"))
    return processes, rerun.rerun(marks, down, streams)


def q49_rerun_chain(spark, sf_dir):
    return rerun_parts(spark, sf_dir)[1].select(F.col("node").alias("process"), F.array_join("reasons", ",").alias("reasons"))


def q49b_reset(spark, sf_dir):
    processes, marked = rerun_parts(spark, sf_dir)
    return rerun.reset(processes.select("process", "status"), marked)


def q49c_counts(spark, sf_dir):
    processes, marked = rerun_parts(spark, sf_dir)
    streams = part(spark, sf_dir).where("k % 61 = 0")
    return status.counts(processes, streams, marked, launchable(spark, sf_dir))


# Times, status, resources, selection.


def task_events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("task_idx", F.col("event_id") % 3)


def q50_elapsed_tasks(spark, sf_dir):
    return status.elapsed_tasks(task_events(spark, sf_dir), "user_id", "task_idx")


def q50b_statistics(spark, sf_dir):
    times = status.elapsed(table(spark, sf_dir, "events").where("user_id % 4 <> 0"), "user_id")
    return status.statistics(statuses(spark, sf_dir).select("user_id", "status"), times, "user_id")


def q50c_status_rows(spark, sf_dir):
    return status.status_rows(statuses(spark, sf_dir), 12, ("3", "17", "40"), "user_id")


def running_tasks(spark, sf_dir):
    state = F.when(F.col("k") % 3 == 0, "IN-PROGRESS").when(F.col("k") % 3 == 1, "TO-DO").otherwise("FINISHED")
    return part(spark, sf_dir).select((F.col("k") % 20).alias("program"), state.alias("status"), (F.col("p_size") % 4 + 1).alias("cpus"), (F.col("p_size") * 100).alias("mem"))


def q51_resources_left(spark, sf_dir):
    return selection.resources_left(running_tasks(spark, sf_dir), "program", 1000, None)


def array_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("process"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_returnflag")
    each = arrays.task_array(rows, "process", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    state = F.when(F.col("l_linestatus") == "O", "TO-DO").when(F.col("l_returnflag") == "A", "IN-PROGRESS").when(F.col("l_returnflag") == "R", "FAILED").otherwise("FINISHED")
    return each.select("process", "task_idx", state.alias("state"), (F.col("process") % 4).alias("throttle"), F.lit(2).alias("cpus"), (F.col("process") % 5 * 256).alias("mem"))


def launchable(spark, sf_dir):
    ready = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("process"))
    return arrays.executable(array_tasks(spark, sf_dir), ready)


def q52_executable(spark, sf_dir):
    return launchable(spark, sf_dir)


def q52b_selectable(spark, sf_dir):
    tasks = array_tasks(spark, sf_dir)
    sizes = tasks.groupBy("process").agg(F.count("*").alias("size"))
    items = selection.selectable(tasks.join(launchable(spark, sf_dir), ["process", "task_idx"]), sizes)
    return items.select("process", "task_idx", F.round("value", 6).alias("value"), F.get("weights", F.lit(0)).alias("cpus"), F.get("weights", F.lit(1)).alias("mem"))


def q53_partners(spark, sf_dir):
    return graph.both_ways(part(spark, sf_dir).select((F.col("k") % 40).alias("owner"), (F.col("k") % 90).alias("user")))


def weighted_parts(spark, sf_dir):
    rows = part(spark, sf_dir)
    return rows.select((F.col("k") % 20).alias("program"), F.col("k").cast("string").alias("item"), F.col("p_retailprice").alias("value"), F.array((F.col("p_size") % 4 + 1).cast("double"), (F.col("p_size") * 100).cast("double"), F.lit(1.0)).alias("weights"))


def q54_priorities(spark, sf_dir):
    items = selection.fitting(weighted_parts(spark, sf_dir), (64.0, 60_000.0, None))
    return selection.priorities(items, "program", (64.0, 60_000.0, 0.0)).select("program", "item", F.round("priority", 4).alias("priority"))


def q54b_totals(spark, sf_dir):
    items = weighted_parts(spark, sf_dir)
    found = selection.totals(items, items.where("CAST(item AS BIGINT) % 3 = 1").select("program", "item"), "program", 2)
    return found.withColumn("value", F.round("value", 3))


def q55_rounds(spark, sf_dir):
    place = (F.col("k") % 10) * 1_000_000 + F.col("k")
    edges = part(spark, sf_dir).where("k > 0").select(F.floor(F.col("k") / 2).cast("long").alias("ancestor"), F.col("k").alias("node"))
    return graph.rounds(part(spark, sf_dir).select(F.col("k").alias("node"), place.alias("place")), edges)


def q56_closure(spark, sf_dir):
    rows = part(spark, sf_dir).where("k % 8 <> 0")
    down = rows.select((F.col("k") - 1).alias("ancestor"), F.col("k").alias("node"))
    back = rows.where("k % 3 = 0").select(F.col("k").alias("ancestor"), (F.col("k") - 1).alias("node"))
    return graph.closure(down.unionByName(back))


# Specifications and attempts.

SPECS = f"concat(CASE WHEN k % 17 = 0 THEN '9bad' ELSE 'p' END, CAST(k - k % 19 % 2 AS VARCHAR(20)), ' cpus=1 ||| processdeps=', CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN concat('afterok:p', CAST(k - 1 AS VARCHAR(20))) WHEN k % 4 = 2 THEN concat('afterok:p', CAST(k - 1 AS VARCHAR(20)), ',afterany:p', CAST(k + 1 AS VARCHAR(20))) ELSE concat('after:p', CAST(k - 2 AS VARCHAR(20)), '?afternotok:q', {K}) END)"


def q57_spec_dependencies(spark, sf_dir):
    return graph.spec_dependencies(part(spark, sf_dir).select(F.expr(SPECS).alias("spec")))


def q57b_invalid_specs(spark, sf_dir):
    return graph.invalid_specs(graph.parsed_specs(part(spark, sf_dir).select(F.expr(SPECS).alias("spec"))))


def q58_attempts(spark, sf_dir):
    rows = part(spark, sf_dir)
    n = units.attempts(F.lit("512,1024"), F.when(F.col("k") % 3 == 0, "1,2,3").otherwise("1"))
    return attempts.attempt_runs(rows.select(F.col("k").alias("process")).withColumn("n", F.when(F.col("process") % 5 == 0, 1).otherwise(F.lit(None))).withColumn("k", F.col("process")), F.coalesce("n", n))


def q58b_task_attempts(spark, sf_dir):
    runs = attempts.attempt_runs(part(spark, sf_dir).where("k % 7 = 0").select(F.col("k").alias("process")), F.lit(2))
    tasks = part(spark, sf_dir).select(F.col("k").alias("process"), F.explode(F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))).alias("task_idx"))
    return attempts.task_attempts(runs, tasks)


def q59_strongest(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in units.PRIORITY])
    rows = part(spark, sf_dir).select((F.col("k") % 50).alias("consumer"), (F.col("k") % 7).alias("producer"), F.element_at(kinds, (F.col("k") * 5 % 6 + 1).cast("int")).alias("deptype"), F.col("k").alias("seq"))
    return rows.groupBy("consumer", "producer").agg(graph.strongest(F.col("deptype"), F.col("seq")).alias("deptype"))


def q60_finished(spark, sf_dir):
    tasks = array_tasks(spark, sf_dir)
    events = tasks.select("process", "task_idx", F.when(F.col("state") == "FINISHED", "finished").otherwise("started").alias("kind"))
    sizes = tasks.groupBy("process").agg(F.count("*").alias("total"))
    return arrays.finished_processes(events.join(sizes, "process"))


def q61_mark_done(spark, sf_dir):
    path = messages.shared_path(spark, "done")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    tables.mark_done(orders.where("id % 5 = 0"), orders.where("id % 3 = 0"), path)
    tables.mark_done(spark.read.parquet(path).unionByName(orders.where("id % 5 = 0")), orders.where("id % 2 = 0"), path)
    return spark.read.parquet(path)


def q62_dot(spark, sf_dir):
    edges = part(spark, sf_dir).where("k > 0").select(F.floor(F.col("k") / 2).cast("long").alias("producer"), F.col("k").alias("consumer"), F.lit("afterok").alias("deptype"))
    return graph.as_dot(edges)


# Documents, run tables, strings.


def q63_documents(spark, sf_dir):
    rows = part(spark, sf_dir)
    category = F.when(F.col("k") % 3 == 0, "input").otherwise("output")
    options = rows.select(F.concat(F.lit("p"), (F.col("k") % 50).cast("string")).alias("process"), F.concat(F.lit("-o"), F.col("k").cast("string")).alias("opt"), F.lit("<string>").alias("kind"), category.alias("category"), (F.col("k") % 2 == 0).alias("required"), F.col("p_name").alias("description"))
    return ports.documents(options)


def q64_run_table(spark, sf_dir):
    samples = part(spark, sf_dir).select(F.col("k").alias("entry"), F.concat(F.lit("-s "), F.col("k").cast("string")).alias("options"))
    return ports.run_table(samples, "run --program telegram", "-c 40 -v")


STRING = f"concat('  ', p_name, ' \"q\" ', {K}, '  ')"


def q65_strings(spark, sf_dir):
    s = F.expr(STRING)
    args = F.split(F.col("p_name"), " ", -1)
    many = F.concat(args, F.array(F.col("k").cast("string")))
    rows = part(spark, sf_dir)
    return rows.select(
        "k",
        scalars.trimmed(s).alias("trimmed"),
        scalars.quotes_escaped(s).alias("escaped"),
        scalars.swapped(F.col("p_name"), " ", "_BLANK_").alias("marked"),
        scalars.swapped(scalars.swapped(F.col("p_name"), " ", "_BLANK_"), "_BLANK_", " ").alias("unmarked"),
        scalars.first_fields(s, 2).alias("first_two"),
        scalars.serialised(many).alias("serialised"),
        scalars.serialised(many, ",", 2).alias("shortened"),
        F.size(scalars.deserialised(scalars.serialised(many))).cast("long").alias("n_args"),
        F.reverse("p_name").alias("reversed"),
        scalars.absolute(F.concat(F.lit("a//./b/"), F.col("k").cast("string")), F.lit("/home//me/")).alias("absolute"),
        scalars.home_expanded(F.concat(F.lit("~/"), F.col("k").cast("string")), "/home/me").alias("expanded"),
        scalars.owned_name(F.concat(F.lit("/out/p"), F.col("k").cast("string"), F.lit("/fifo"))).alias("owned"),
        (units.normal_path(F.lit("/a//b/")) == units.normal_path(F.lit("/a/b"))).alias("same_folder"),
        units.version_number(F.concat(F.lit("1."), (F.col("k") % 30).cast("string"), F.lit(".2"))).alias("version"),
    )


RANGES = f"CASE k % 4 WHEN 0 THEN CAST(k % 5 AS VARCHAR(20)) WHEN 1 THEN concat(CAST(k % 5 AS VARCHAR(20)), '-', CAST(k % 5 + 3 AS VARCHAR(20))) WHEN 2 THEN '1,3-4,4' ELSE 'x' END"


def q66_ranges(spark, sf_dir):
    return arrays.from_ranges(part(spark, sf_dir).select("k", F.expr(RANGES).alias("e")), "e", "k")


def q67_chance(spark, sf_dir):
    return part(spark, sf_dir).select("k", scalars.chance(F.col("k"), 75).alias("fails"))


def q68_sorted_counts(spark, sf_dir):
    counts = text.char_counts(table(spark, sf_dir, "documents"))
    return values.with_place(counts, "ch")


# Streams and cycles.

BLOCK_PATH = f"CASE k % 6 WHEN 0 THEN concat('/in/blk', {K}, '.txt') WHEN 1 THEN concat('/in/part', {K}, '.txt') WHEN 2 THEN ' ' ELSE concat('blk', {K}, '.txt ') END"


def q70_dispatch(spark, sf_dir):
    return messages.dispatched(part(spark, sf_dir).select(F.expr(BLOCK_PATH).alias("path")), 5)


def q70b_dispatch_counts(spark, sf_dir):
    return messages.dispatch_counts(part(spark, sf_dir).select(F.expr(BLOCK_PATH).alias("path")), 5)


def q70s_dispatch_live(spark, sf_dir):
    stream = messages.table_stream(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return messages.drained(messages.dispatched(stream.select(F.expr(BLOCK_PATH).alias("path")), 5))


def q71_first_message(spark, sf_dir):
    return messages.first_message(table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id"), "event_id")


def q76s_announced(spark, sf_dir):
    stream = messages.table_stream(spark, sf_dir, "documents").select("doc_id", "text")
    return messages.announced(stream, 25)


def q71s_side_input(spark, sf_dir):
    stream = messages.table_stream(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    side = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.round("c_acctbal").cast("long").alias("threshold"))
    return messages.drained(messages.with_side_input(stream, side, "user_id").withColumn("over", F.col("cents") > F.col("threshold")))


def q72s_triggered(spark, sf_dir):
    stream = messages.table_stream(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    run = lambda rows: cycles.state_cycles(rows, "k", F.col("p_size"), F.lit(60), F.lit(100).cast("long"), [lambda v: v + 1, lambda v: v + 2], 64)
    return messages.on_trigger(stream, run)


def q73_two_process_cycle(spark, sf_dir):
    return cycles.two_process_cycle(part(spark, sf_dir), "k", F.col("p_size"))


def q74_cycle_thresholds(spark, sf_dir):
    return cycles.state_cycles(part(spark, sf_dir), "k", F.col("p_size"), F.lit(60), F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: (i * 40).cast("long")), [lambda v: v + 1, lambda v: v + 3], 64)


def q75_triggers_until_end(spark, sf_dir):
    return cycles.triggered(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", (F.col("event_type") == "signup") & (F.col("event_id") > 30))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}

LI = "i AS (SELECT l_orderkey AS process, l_linenumber AS task_idx, CASE WHEN l_returnflag = 'A' THEN '-outf' ELSE '-inf' END AS opt, concat(CASE WHEN l_partkey % 3 = 0 THEN 'v/' ELSE '/v/' END, CAST(l_partkey AS VARCHAR)) AS value, l_returnflag AS flag FROM lineitem)"
TASKS = """a AS (SELECT l_orderkey AS process, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS task_idx,
    CASE WHEN l_linestatus = 'O' THEN 'TO-DO' WHEN l_returnflag = 'A' THEN 'IN-PROGRESS' WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'FINISHED' END AS state, l_orderkey % 4 AS throttle FROM lineitem)"""
LAUNCHABLE = f"""{TASKS},
  l AS (SELECT process, count(*) FILTER (state = 'IN-PROGRESS') AS live, count(*) AS size FROM a GROUP BY process),
  w AS (SELECT a.*, l.live, l.size, row_number() OVER (PARTITION BY a.process ORDER BY task_idx) AS rn FROM a JOIN l ON l.process = a.process JOIN orders o ON o.o_orderkey = a.process AND o.o_orderstatus <> 'F' WHERE state IN ('TO-DO', 'FAILED')),
  x AS (SELECT process, task_idx, size FROM w WHERE throttle = 0 OR rn <= throttle - live)"""
SNAPSHOTS = f"""{PART}, t AS (SELECT k, unnest(range(3)) AS i FROM p),
  o AS (SELECT k, i, CAST(i AS VARCHAR) AS v FROM t WHERE k % 53 <> 0),
  n AS (SELECT k, i, CASE WHEN k % 101 = 7 AND i = 1 THEN 'edited' ELSE CAST(i AS VARCHAR) END AS v FROM t WHERE k % 59 <> 0 AND NOT (k % 103 = 9 AND i = 2)),
  oa AS (SELECT k, string_agg(i || v, ',' ORDER BY i) AS s FROM o GROUP BY k), na AS (SELECT k, string_agg(i || v, ',' ORDER BY i) AS s FROM n GROUP BY k),
  diff AS (SELECT coalesce(oa.k, na.k) AS process, CASE WHEN oa.k IS NULL THEN 'new' WHEN na.k IS NULL THEN 'removed' WHEN oa.s = na.s THEN 'unchanged' ELSE 'changed' END AS change FROM oa FULL JOIN na ON oa.k = na.k)"""
RERUN = f"""{SNAPSHOTS},
  pr AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'TO-DO' ELSE 'FINISHED' END AS status FROM p),
  f AS (SELECT a.k AS x, b.k AS y FROM p a JOIN p b ON b.k = a.k + 1 WHERE a.k % 61 = 0),
  s AS (SELECT process AS k, CASE change WHEN 'new' THEN 'new_process' ELSE 'input_change' END AS reason FROM diff WHERE change IN ('new', 'changed')
    UNION SELECT k, 'forced' FROM p WHERE k % 401 = 11
    UNION SELECT k, 'outdated_code' FROM pr WHERE status = 'FINISHED' AND (k % 211 = 3 OR (k % 10 = 4 AND k < 40))
    UNION SELECT unnest([x, y]), 'process_status_fifo_user_owner' FROM f WHERE (x % 3 <> 0) <> (y % 3 <> 0)),
  e AS (SELECT k - 1 AS x, k AS y, 'propagate_dependencies' AS reason FROM p WHERE k % 16 <> 0 UNION SELECT x, y, 'propagate_fifo' FROM f UNION SELECT y, x, 'propagate_fifo' FROM f),
  m AS (SELECT DISTINCT k FROM s UNION SELECT e.y FROM m JOIN e ON e.x = m.k),
  r AS (SELECT k, reason FROM s UNION SELECT e.y, e.reason FROM e JOIN m ON m.k = e.x)"""
SECONDS = "concat(CAST(us // 1000000 AS VARCHAR), '.', lpad(CAST((us % 1000000) // 1000 AS VARCHAR), 3, '0'))"


def cycle_sql(step: int, threshold: str) -> str:
    """DuckDB SQL of state_cycles() from each part's size to 60."""
    out = f"CASE WHEN total <= {threshold} THEN v + 1 ELSE v + {step} END"
    return f"""
WITH RECURSIVE {PART}, c AS (
  SELECT k, CAST(0 AS BIGINT) AS step, CAST(p_size AS BIGINT) AS v, CAST(0 AS BIGINT) AS total FROM p
  UNION ALL SELECT k, step + 1, {out}, total + {out} FROM c WHERE v <= 60)
SELECT k, step, v AS sent, {out} AS received, total + {out} AS total FROM c WHERE v <= 60"""


def status_sql() -> str:
    from sluice.queries import STATUS

    return STATUS


#: DuckDB SQL with the rows of the query of that name.
ORACLES: dict[str, str] = {
    "q30_file_ports": f"""
WITH {PART}, g AS (SELECT k, {FILE} AS given FROM p),
n AS (SELECT k, given, CASE WHEN given IS NULL THEN '/data/in/f1' WHEN given = '_NONE_' THEN NULL WHEN given LIKE '/%' THEN given ELSE concat('/data/', given) END AS path FROM g)
SELECT k, path, CASE WHEN path IS NULL THEN 'none' WHEN path LIKE '/data/in/f%' AND CAST(path[11:] AS INT) >= 40 OR path LIKE '/abs/x%' AND CAST(path[7:] AS INT) >= 25 THEN 'missing' WHEN given IS NULL THEN 'default' ELSE 'given' END AS state FROM n""",
    "q31_nth_line": "SELECT doc_id, string_split(coalesce(text, ''), chr(10))[2] AS line FROM documents",
    "q32_task_options": f"WITH {TASKS.replace(' FROM lineitem)', ', l_partkey FROM lineitem)')} SELECT process, task_idx, l_partkey FROM a JOIN orders ON o_orderkey = process AND task_idx = o_orderkey % 4",
    "q33_spec_lines": f"WITH {PART}, e AS (SELECT k + 1 AS lineno, {ENTRY} AS line FROM p) SELECT lineno, line FROM e WHERE trim(line) <> '' AND trim(line)[1] <> '#'",
    "q34_exhaustive_scan": f"WITH {PART} SELECT concat('p', {K}) AS process, k % 3 AS task_idx, CAST(4 AS BIGINT) AS n_args, concat('v', {K}) AS a FROM p WHERE k % 9 <> 0",
    "q34b_output_values": f"WITH {PART} SELECT concat('/out/v', CAST(k % 100 AS VARCHAR)) AS value, concat('p', {K}) AS process, k % 3 AS task_idx, '-outf' AS opt FROM p WHERE k % 9 <> 0",
    "q35_stream_scan": f"WITH {PART}, m AS (SELECT k % 40 AS s, max(k) AS k FROM p GROUP BY k % 40) SELECT concat('s', CAST(s AS VARCHAR)) AS stream, concat('p', CAST(s AS VARCHAR)) AS owner, CAST(0 AS BIGINT) AS owner_task, concat('p', {K}) AS user, k % 3 AS user_task FROM m",
    "q36_option_scan": f"""
WITH {PART}, o AS (
  SELECT k, 0 AS task_idx, '-a' AS opt, CASE WHEN k % 2 <> 0 AND k % 3 = 0 THEN 'z' ELSE concat('v', {K}) END AS value FROM p UNION ALL SELECT k, 0, '-b', '' FROM p UNION ALL SELECT k, 0, '-c', 'x' FROM p
  UNION ALL SELECT k, 1, '-a', CASE WHEN k % 3 = 0 THEN 'z' ELSE 'w' END FROM p WHERE k % 2 = 0)
SELECT concat('p', {K}) AS process, CAST(task_idx AS BIGINT) AS task_idx, opt, value FROM o WHERE k % 10 <> 0""",
    "q37_status_scan": f"WITH {PART} SELECT concat('p', {K}) AS process, CASE WHEN k % 2 = 0 THEN 'FINISHED' ELSE 'TO-DO' END AS status FROM p WHERE k % 6 <> 0",
    "q38_selection_scan": f"WITH {PART} SELECT concat('p', {K}) AS item, CAST(0.5 AS DOUBLE) AS value, CAST(k % 4 + 1 AS DOUBLE) AS cpus, CAST(k % 4 * 512 AS DOUBLE) AS mem FROM p WHERE k % 8 <> 0",
    "q38b_selection_deps": f"WITH {PART} SELECT concat('p', {K}) AS successor, concat('p', CAST(k + 3 AS VARCHAR)) AS predecessor, CASE WHEN k % 8 = 0 THEN 'unknown_successor' WHEN (k + 3) % 8 = 0 OR k + 3 > (SELECT max(k) FROM p) THEN 'done' ELSE 'kept' END AS state FROM p",
    "q39_random_lines": "SELECT i AS line_no, substr(concat(md5(concat('7:', i, ':0')), md5(concat('7:', i, ':1')), md5(concat('7:', i, ':2'))), 1, 70) AS line FROM range(200) t(i)",
    "q40_counter": "SELECT i AS pos, CASE WHEN i > 1000 THEN '__SHUTDOWN_TOKEN__' ELSE CAST(i AS VARCHAR) END AS value FROM range(1, 1002) t(i)",
    "q41_passed_values": """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 2 AS VARCHAR) ELSE concat('/out/', CAST(o_orderkey AS VARCHAR), '/.__VAL_DESCRIPTOR__x') END AS s,
  '_VOID_VALUE_' AS n, 'plain' AS x, '_OPT_NOT_FOUND_' AS z, concat('/out/', CAST(o_orderkey AS VARCHAR), '/.__VAL_DESCRIPTOR__x') AS outv FROM orders""",
    "q42_predicates": f"""
WITH {PART}, x AS (SELECT k, {VALUE} AS v FROM p)
SELECT k, v LIKE '-%' AS is_option, regexp_matches(v, '^--?out') AS is_output, v LIKE '/%' AS is_absolute, regexp_full_match(v, '[0-9]+') AS is_natural, starts_with(v, '__PROC_OUT_OPT_DESCRIPTOR__') AS is_output_reference,
  regexp_matches(v, '^/(.*/)?\\.__VAL_DESCRIPTOR__[^/]*$') AS is_value_reference, ends_with(v, 'optlist') AS is_list_name, regexp_full_match(v, '[a-zA-Z_][a-zA-Z_0-9]*(::[a-zA-Z_][a-zA-Z_0-9]*)*') AS is_name FROM x""",
    "q43_generated": f"WITH {PART}, t AS (SELECT k, unnest(range(k % 4)) AS i FROM p) SELECT concat('p', {K}) AS process, i AS task_idx, '-i' AS opt, CAST(i * 10 AS VARCHAR) AS value FROM t UNION ALL SELECT concat('p', {K}), i, '-f', concat('p', {K}, '_', CAST(i AS VARCHAR)) FROM t",
    "q44_resolved": f"WITH {PART} SELECT concat('p', {K}) AS process, CAST(0 AS BIGINT) AS task_idx, '-v' AS opt, concat('v', CAST(k - k % 6 AS VARCHAR)) AS value FROM p",
    "q45_candidates": f"WITH {LI} SELECT DISTINCT value, process, task_idx, opt FROM i WHERE flag = 'R' AND value LIKE '/%' AND value IN (SELECT value FROM i WHERE flag = 'A')",
    "q46_stream_edges": f"WITH {PART}, m AS (SELECT k % 40 AS owner, arg_max(k % 90, k) AS user FROM p GROUP BY k % 40) SELECT DISTINCT owner, user, 'none' AS deptype FROM m WHERE owner <> user",
    "q46b_stream_owners": f"WITH {PART}, d AS (SELECT DISTINCT k % 90 AS user, CAST(k % 40 AS VARCHAR) AS owner FROM p WHERE k % 90 <> k % 40) SELECT user, string_agg(owner, ',' ORDER BY owner) AS owners FROM d GROUP BY user",
    "q47_output_index": f"WITH {LI}, d AS (SELECT DISTINCT value, process, task_idx FROM i WHERE flag = 'A') SELECT value, string_agg(concat(CAST(process AS VARCHAR), ':', CAST(task_idx AS VARCHAR)), ',' ORDER BY process, task_idx) AS makers FROM d GROUP BY value",
    "q47b_array_sizes": f"WITH {LI} SELECT opt, process, count(*) AS n FROM i WHERE flag IN ('A', 'R') GROUP BY ALL",
    "q48_array_diff": f"WITH {SNAPSHOTS} SELECT process, change FROM diff",
    "q49_rerun_chain": f"WITH RECURSIVE {RERUN} SELECT k AS process, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY k",
    "q49b_reset": f"WITH RECURSIVE {RERUN} SELECT k AS process, CASE WHEN status = 'FINISHED' AND k IN (SELECT k FROM r) THEN 'TO-DO' ELSE status END AS status FROM pr",
    "q48b_diff_lists": f"WITH {SNAPSHOTS}, f AS (SELECT change, process, row_number() OVER (PARTITION BY change ORDER BY process) AS rn, count(*) OVER (PARTITION BY change) AS n FROM diff) SELECT change, n, concat(string_agg(CAST(process AS VARCHAR), ',' ORDER BY process), CASE WHEN n > 10 THEN ',...' ELSE '' END) AS processes FROM f WHERE rn <= 10 GROUP BY change, n",
    "q48c_to_rerun": f"WITH {SNAPSHOTS} SELECT process FROM diff WHERE change IN ('new', 'changed')",
    "q49c_counts": f"WITH RECURSIVE {RERUN}, {LAUNCHABLE.replace(' x AS', ' lx AS').replace('a AS', 'ta AS', 1).replace('FROM a ', 'FROM ta AS a ')} SELECT (SELECT count(*) FROM p) AS n_processes, (SELECT count(*) FROM p WHERE k % 61 = 0) AS n_streams, (SELECT count(DISTINCT k) FROM r) AS n_rerun, (SELECT count(DISTINCT process) FROM lx) AS n_launchable",
    "q71_first_message": "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 1",
    "q76s_announced": """
WITH l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
b AS (SELECT (row_number() OVER (ORDER BY doc_id, i) - 1) // 25 AS block, line FROM l)
SELECT block, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, CASE WHEN count(*) = 25 THEN CAST(0 AS BIGINT) END AS ready FROM b GROUP BY block""",
    "q50_elapsed_tasks": f"""
WITH t AS (SELECT user_id, event_id % 3 AS i, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY ALL)
SELECT user_id, string_agg(concat(CAST(i AS VARCHAR), '->', {SECONDS}, ' ;'), ' ' ORDER BY i) AS elapsed, CAST(sum(us) AS BIGINT) AS total_us FROM t GROUP BY user_id""",
    "q50b_statistics": f"WITH {{STATUS}}, t AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events WHERE user_id % 4 <> 0 GROUP BY user_id) SELECT u.user_id, u.status, CASE WHEN t.us IS NULL THEN 'UNKNOWN' ELSE {SECONDS} END AS elapsed FROM u LEFT JOIN t ON t.user_id = u.user_id",
    "q50c_status_rows": "WITH {STATUS}, x AS (SELECT CAST(user_id AS VARCHAR) AS p, status FROM u WHERE user_id NOT IN (3, 17, 40)) SELECT string_agg(lpad(p, 12, ' '), ' ' ORDER BY p) AS header, string_agg(lpad(status, 12, ' '), ' ' ORDER BY p) AS row FROM x",
    "q51_resources_left": f"WITH {PART}, s AS (SELECT k % 20 AS program, CAST(coalesce(sum(p_size % 4 + 1) FILTER (k % 3 = 0), 0) AS BIGINT) AS used_cpus, CAST(coalesce(sum(p_size * 100) FILTER (k % 3 = 0), 0) AS BIGINT) AS used_mem FROM p GROUP BY k % 20) SELECT program, used_cpus, used_mem, 1000 - used_cpus AS free_cpus, CAST(NULL AS BIGINT) AS free_mem FROM s",
    "q52_executable": f"WITH {LAUNCHABLE} SELECT process, task_idx FROM x",
    "q52b_selectable": f"WITH {LAUNCHABLE} SELECT process, task_idx, round(1.0::DOUBLE / size, 6) AS value, CAST(2 AS DOUBLE) AS cpus, CAST(process % 5 * 256 AS DOUBLE) AS mem FROM x",
    "q53_partners": f"WITH {PART} SELECT DISTINCT a AS item, b AS partner FROM (SELECT k % 40 AS a, k % 90 AS b FROM p UNION ALL SELECT k % 90, k % 40 FROM p) WHERE a <> b",
    "q54_priorities": f"WITH {PART} SELECT k % 20 AS program, {K} AS item, round(p_retailprice / ((p_size % 4 + 1) / 64.0::DOUBLE + p_size * 100 / 60000.0::DOUBLE), 4) AS priority FROM p",
    "q54b_totals": f"WITH {PART} SELECT k % 20 AS program, count(*) AS n, round(sum(p_retailprice), 3) AS value, CAST(sum(p_size % 4 + 1) AS DOUBLE) AS weight0, CAST(sum(p_size * 100) AS DOUBLE) AS weight1 FROM p WHERE k % 3 = 1 GROUP BY k % 20",
    "q55_rounds": f"""
WITH RECURSIVE {PART}, n AS (SELECT k, k % 10 * 1000000 + k AS place FROM p),
r AS (SELECT k, place, CAST(0 AS BIGINT) AS round FROM n WHERE k = 0 UNION ALL SELECT n.k, n.place, r.round + CASE WHEN r.place > n.place THEN 1 ELSE 0 END FROM r JOIN n ON n.k > 0 AND n.k // 2 = r.k)
SELECT k AS node, place, round FROM r""",
    "q56_closure": f"WITH RECURSIVE {PART}, e AS (SELECT k - 1 AS a, k AS b FROM p WHERE k % 8 <> 0 UNION SELECT k, k - 1 FROM p WHERE k % 8 <> 0 AND k % 3 = 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b) SELECT a AS ancestor, b AS node FROM c",
    "q57_spec_dependencies": f"""
WITH {PART}, s AS (SELECT {SPECS} AS spec FROM p),
d AS (SELECT regexp_extract(spec, '^(\\S+)', 1) AS process, CASE WHEN contains(spec, '?') THEN 'OR' ELSE 'AND' END AS conj, list_filter(regexp_split_to_array(regexp_extract(spec, 'processdeps=(.*)$', 1), '[,?]'), lambda x: x <> '') AS deps FROM s)
SELECT process, conj, unnest(range(len(deps))) AS place, split_part(unnest(deps), ':', 1) AS deptype, split_part(unnest(deps), ':', 2) AS producer FROM d""",
    "q57b_invalid_specs": f"""
WITH {PART}, s AS (SELECT k, {SPECS} AS spec FROM p), n AS (SELECT regexp_extract(spec, '^(\\S+)', 1) AS process, split_part(regexp_split_to_array(regexp_extract(spec, 'processdeps=(.*)$', 1), '[,?]')[1], ':', 2) AS producer FROM s)
SELECT DISTINCT process, 'malformed' AS problem FROM n WHERE process LIKE '9%' UNION SELECT process, 'duplicated' FROM n GROUP BY process HAVING count(*) > 1
UNION SELECT process, 'unknown producer' FROM n WHERE producer <> '' AND producer NOT IN (SELECT process FROM n)""",
    "q58_attempts": f"""
WITH {PART}, n AS (SELECT k AS process, CAST(CASE WHEN k % 5 = 0 THEN 1 WHEN k % 3 = 0 THEN 3 ELSE 2 END AS INT) AS n FROM p),
o AS (SELECT process, n, unnest(range(1, n + 1)) AS a FROM n)
SELECT process, concat('attempt', CAST(a AS VARCHAR)) AS run, CAST(NULL AS VARCHAR) AS deptype, CAST(NULL AS VARCHAR) AS needs FROM o WHERE a = 1
UNION ALL SELECT o.process, concat('attempt', CAST(o.a AS VARCHAR)), 'afternotok', concat('attempt', CAST(b.a AS VARCHAR)) FROM o JOIN o b ON b.process = o.process AND b.a < o.a
UNION ALL SELECT process, 'all_failed', 'afternotok', concat('attempt', CAST(a AS VARCHAR)) FROM o WHERE n > 1
UNION ALL SELECT process, 'some_passed', 'afternotok', 'all_failed' FROM n WHERE n > 1""",
    "q58b_task_attempts": f"""
WITH {PART}, t AS (SELECT k AS process, CAST(unnest(range(k % 3 + 1)) AS INT) AS task_idx FROM p WHERE k % 7 = 0)
SELECT process, task_idx, unnest(['attempt1', 'attempt2', 'all_failed', 'all_failed', 'some_passed']) AS run, unnest([NULL, 'afternotok', 'afternotok', 'afternotok', 'afternotok']) AS deptype, unnest([NULL, 'attempt1', 'attempt1', 'attempt2', 'all_failed']) AS needs FROM t""",
    "q59_strongest": f"""
WITH {PART}, d AS (SELECT k % 50 AS consumer, k % 7 AS producer, k, k * 5 % 6 AS x FROM p)
SELECT consumer, producer, arg_max(['none', 'aftercorr', 'after', 'afterany', 'afterok', 'afternotok'][x + 1], least(x, 4) * 1000000000 + k) AS deptype FROM d GROUP BY ALL""",
    "q60_finished": f"WITH {TASKS} SELECT process, count(DISTINCT task_idx) FILTER (state = 'FINISHED') AS completed, count(*) AS total, completed = total AS finished FROM a GROUP BY process",
    "q61_mark_done": "SELECT o_orderkey AS id FROM orders WHERE (o_orderkey % 3 = 0 OR o_orderkey % 2 = 0) AND o_orderkey % 5 <> 0",
    "q62_dot": f"WITH {PART} SELECT concat('\"', CAST(k // 2 AS VARCHAR), '\" -> \"', {K}, '\" [label=\"afterok\"];') AS line FROM p WHERE k > 0",
    "q63_documents": f"""
WITH {PART}, o AS (SELECT concat('p', CAST(k % 50 AS VARCHAR)) AS process, CASE WHEN k % 3 = 0 THEN 'input' ELSE 'output' END AS c, concat('-o', {K}) AS opt, concat('- `-o', {K}, '` <string>', CASE WHEN k % 2 = 0 THEN ' (required)' ELSE '' END, ': ', p_name) AS line FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY process, c ORDER BY opt, line) AS n FROM o)
SELECT process, concat('## ', process, chr(10), string_agg(concat(CASE WHEN n = 1 THEN concat('### ', c, chr(10)) ELSE '' END, line), chr(10) ORDER BY c, opt, line)) AS document FROM f GROUP BY process""",
    "q64_run_table": f"WITH {PART} SELECT k AS entry, concat('run --program telegram -s ', {K}, ' -c 40 -v') AS command FROM p",
    "q65_strings": f"""
WITH {PART}, s AS (SELECT k, p_name, {STRING} AS s FROM p)
SELECT k, trim(s) AS trimmed, replace(s, '"', '\\"') AS escaped, replace(p_name, ' ', '_BLANK_') AS marked, p_name AS unmarked, array_to_string(list_filter(string_split(s, ' '), lambda x: x <> '')[1:2], ' ') AS first_two,
  concat(replace(p_name, ' ', '<_ARG_SEP_>'), '<_ARG_SEP_>', {K}) AS serialised, CASE WHEN len(string_split(p_name, ' ')) + 1 > 2 THEN concat(array_to_string(list_append(string_split(p_name, ' '), {K})[1:2], ','), ',...') ELSE concat(replace(p_name, ' ', ','), ',', {K}) END AS shortened,
  len(string_split(p_name, ' ')) + 1 AS n_args, reverse(p_name) AS reversed, concat('/home/me/a/b/', {K}) AS absolute, concat('/home/me/', {K}) AS expanded, concat('p', {K}, '/fifo') AS owned, true AS same_folder, 1000000 + k % 30 * 1000 + 2 AS version FROM s""",
    "q66_ranges": f"WITH {PART} SELECT k, k % 5 AS task_idx FROM p WHERE k % 4 = 0 UNION ALL SELECT k, unnest(range(k % 5, k % 5 + 4)) FROM p WHERE k % 4 = 1 UNION ALL SELECT k, CAST(unnest([1, 3, 4]) AS BIGINT) FROM p WHERE k % 4 = 2",
    "q67_chance": f"WITH {PART}, d AS (SELECT k, md5({K}) AS m FROM p) SELECT k, (ascii(m[1]) * 31 + ascii(m[2]) * 17 + ascii(m[3]) * 7 + ascii(m[4])) % 100 < 75 AS fails FROM d",
    "q68_sorted_counts": "WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ''), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch) SELECT row_number() OVER (ORDER BY encode(ch)) AS place, ch, n FROM c",
    "q70_dispatch": f"WITH {PART}, b AS (SELECT k, trim({BLOCK_PATH}) AS path FROM p) SELECT path, k AS idx, k % 5 AS worker FROM b WHERE k % 6 NOT IN (1, 2)",
    "q70b_dispatch_counts": f"WITH {PART} SELECT CASE WHEN k % 6 = 1 THEN -1 ELSE k % 5 END AS worker, count(*) AS n FROM p WHERE k % 6 <> 2 GROUP BY ALL",
    "q71s_side_input": "SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents, CAST(round(c_acctbal) AS BIGINT) AS threshold, CAST(round(value * 100) AS BIGINT) > CAST(round(c_acctbal) AS BIGINT) AS over FROM events LEFT JOIN customer ON c_custkey = user_id",
    "q72s_triggered": cycle_sql(2, "100"),
    "q73_two_process_cycle": f"WITH {PART}, v AS (SELECT k, unnest(range(1, p_size + 1)) AS v FROM p) SELECT k, v - 1 AS step, v AS sent, v + 1 AS received FROM v",
    "q74_cycle_thresholds": cycle_sql(3, "step * 40"),
    "q75_triggers_until_end": "SELECT event_id, user_id, event_type FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE event_type = 'signup' AND event_id > 30), 9223372036854775807)",
}
ORACLES["q70s_dispatch_live"] = ORACLES["q70_dispatch"]
for name in ("q50b_statistics", "q50c_status_rows"):
    ORACLES[name] = ORACLES[name].replace("{STATUS}", status_sql())
