"""Programs: networks of named processes whose ports carry DataFrames.

A process is a function from the tables at its input ports to the table at its
output.  An input names the process whose output it takes.  Stream edges stay
lazy plans, so a chain of them is one Spark job; file edges are written and read
again, and may be taken from an earlier run.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z_][a-zA-Z_0-9]*(::[a-zA-Z_][a-zA-Z_0-9]*)*")
Table = Callable[..., DataFrame]


@dataclass(frozen=True)
class Port:
    """What is said of an option of a process."""

    name: str
    kind: str = "string"
    category: str = "general"
    required: bool = False
    description: str = ""


@dataclass(frozen=True)
class Process:
    """A named function of DataFrames.

    inputs: the process behind each argument.  skip: whether not to run, given
    the inputs.  reset runs before it and post after it, in any case.
    deptypes: how it depends on a producer, where that is not afterok.  folder:
    the name of its output's folder, where that is not its own.
    """

    name: str
    run: Table
    inputs: dict[str, str] = field(default_factory=dict)
    after: tuple[str, ...] = ()
    ports: tuple[Port, ...] = ()
    skip: Callable[..., bool] | None = None
    post: Callable[[], None] | None = None
    stream: bool = True
    force: bool = False
    description: str = ""
    deptypes: dict[str, str] = field(default_factory=dict)
    reset: Callable[[], None] | None = None
    folder: str | None = None

    def __post_init__(self) -> None:
        if not NAME.fullmatch(self.name):
            raise ValueError(f"malformed name of a process: {self.name}")


@dataclass
class Program:
    """Processes by name.  Redefining one of an added program rewires it; two of one name in one program are an error."""

    name: str
    processes: dict[str, Process] = field(default_factory=dict)
    description: str = ""

    def add(self, process: Process) -> Program:
        if process.name in self.processes:
            raise ValueError(f"process {process.name} stands twice in {self.name}")
        self.processes[process.name] = process
        return self

    def add_alias(self, name: str, of: str, **changes) -> Program:
        """The function of another process under a new name."""
        return self.add(replace(self.processes[of], name=name, **changes))

    def add_program(self, other: Program) -> Program:
        for process in other.processes.values():
            self.add(process)
        return self

    def redefine(self, name: str, **changes) -> Program:
        self.processes[name] = replace(self.processes[name], **changes)
        return self

    def order(self) -> list[str]:
        """Names so that each stands after all that it needs; unknown producers and cycles are errors."""
        needs = {p.name: [*p.inputs.values(), *p.after] for p in self.processes.values()}
        for name, of in needs.items():
            if unknown := [x for x in of if x not in needs]:
                raise ValueError(f"{name} needs unknown processes: {', '.join(unknown)}")
        try:
            return [*TopologicalSorter(needs).static_order()]
        except CycleError as e:
            raise ValueError(f"the processes {', '.join(e.args[1])} wait for one another") from None

    def documented(self, spark: SparkSession) -> DataFrame:
        """Rows (process, opt, kind, category, required, description): the options of all processes."""
        rows = [(p.name, o.name, o.kind, o.category, o.required, o.description) for p in self.processes.values() for o in p.ports]
        return spark.createDataFrame(rows, "process string, opt string, kind string, category string, required boolean, description string").sort("category", "process", "opt")

    def planned(self, spark: SparkSession, keep: dict[str, str] | None = None) -> DataFrame:
        """A dry run: rows (place, process, needs, kept) in the order of the processes."""
        rows = [(n, name, ",".join([*self.processes[name].inputs.values(), *self.processes[name].after]), bool(keep and name in keep and not self.processes[name].force)) for n, name in enumerate(self.order())]
        return spark.createDataFrame(rows, "place long, process string, needs string, kept boolean")

    def edges(self, spark: SparkSession) -> DataFrame:
        """Rows (consumer, producer, deptype) of all processes; streams wait for nothing."""
        kind = lambda p, x: p.deptypes.get(x, "none" if x in p.inputs.values() and self.processes[x].stream else "afterok")
        rows = [(p.name, x, kind(p, x)) for p in self.processes.values() for x in dict.fromkeys([*p.inputs.values(), *p.after])]
        return spark.createDataFrame(rows, "consumer string, producer string, deptype string")

    def run_process(self, name: str, **inputs: DataFrame) -> DataFrame:
        """One process by itself, on the given inputs."""
        return self.processes[name].run(**inputs)

    def run(self, spark: SparkSession, folder: str | None = None, keep: dict[str, str] | None = None) -> Run:
        """Composes the program's DataFrames in order.

        folder: where file edges are written; without one all edges stay lazy.
        keep: paths of outputs of an earlier run that still hold.  A process is
        IN-PROGRESS once its plan stands, and has finished when its rows have
        been computed: with a file edge at once, with a stream when what reads
        it has been written, or by Run.complete().  A process that fails or is
        skipped has not finished, and what needs it is not run; the others go on.
        """
        done = Run(spark, self)
        for name in self.order():
            process = self.processes[name]
            if keep and name in keep and not process.force:
                done.outputs[name] = spark.read.parquet(keep[name])
                done.statuses[name] = "FINISHED"
                continue
            for x in process.after:
                if done.statuses[x] == "IN-PROGRESS":
                    done.complete(x)
            live = [done.statuses[x] in ("FINISHED", "IN-PROGRESS") for x in process.inputs.values()]
            if not all(live) or any(done.statuses[x] != "FINISHED" for x in process.after):
                done.statuses[name] = "TO-DO"
                continue
            inputs = {k: done.outputs[x] for k, x in process.inputs.items()}
            try:
                if process.skip is not None and process.skip(**inputs):
                    done.statuses[name] = "UNFINISHED"
                    continue
                if process.reset is not None:
                    process.reset()
                done.outputs[name], done.statuses[name] = process.run(**inputs), "IN-PROGRESS"
                if not process.stream and folder is not None:
                    done.complete(name, f"{folder}/{process.folder or name}")
            except Exception as e:  # one process's fault is told in its status; the others go on
                done.statuses[name], done.errors[name] = "FAILED", str(e)
            finally:
                if process.post is not None:
                    process.post()
        return done


@dataclass
class Run:
    """What came of running a program: outputs by process, and their statuses."""

    spark: SparkSession
    program: Program
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    statuses: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def status(self) -> DataFrame:
        """Rows (process, status, error)."""
        rows = [(name, s, self.errors.get(name)) for name, s in self.statuses.items()]
        return self.spark.createDataFrame(rows, "process string, status string, error string")

    def complete(self, name: str, path: str | None = None) -> str:
        """Computes a process's rows, to a path if one is given, and returns its status; what it reads as streams has finished with it."""
        if self.statuses.get(name) != "IN-PROGRESS":
            return self.statuses.get(name, "TO-DO")
        out = self.outputs[name]
        try:
            if path is None:
                out.write.format("noop").mode("overwrite").save()
            else:
                out.write.mode("overwrite").parquet(path)
                self.outputs[name] = self.spark.read.parquet(path)
        except Exception as e:  # told in the status
            self.statuses[name], self.errors[name] = "FAILED", str(e)
            return "FAILED"
        waiting = [name]
        while waiting:
            x = waiting.pop()
            if self.statuses.get(x) == "IN-PROGRESS":
                self.statuses[x] = "FINISHED"
                waiting += self.program.processes[x].inputs.values()
        return "FINISHED"

    def record(self, path: str) -> None:
        """Appends the statuses, with the time, to a table that outlives the run."""
        self.status().withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Rows (process, status, error): what was last recorded of each process."""
    last = spark.read.parquet(path).groupBy("process").agg(F.max_by(F.struct("status", "error"), "at").alias("x"))
    return last.select("process", "x.status", "x.error")
