from __future__ import annotations

import pytest

from sluice.plans.program import Port, Process, Program, recorded


def numbers(spark):
    return spark.range(1, 4)


def test_run_and_failures(spark, tmp_path):
    posts = []
    program = Program("p")
    program.add(Process("one", lambda: numbers(spark)))
    program.add(Process("sum", lambda rows: rows.groupBy().sum("id").toDF("s"), {"rows": "one"}, stream=False))
    program.add(Process("odd", lambda rows: rows, {"rows": "sum"}, skip=lambda rows: rows.first()["s"] % 2 == 0, post=lambda: posts.append("odd")))
    program.add(Process("after_odd", lambda: numbers(spark), after=("odd",)))
    program.add(Process("bad", lambda: 1 / 0, post=lambda: posts.append("bad")))
    done = program.run(spark, str(tmp_path))
    assert done.statuses == {"one": "FINISHED", "sum": "FINISHED", "odd": "UNFINISHED", "after_odd": "TO-DO", "bad": "FAILED"}
    assert sorted(posts) == ["bad", "odd"]
    assert done.outputs["sum"].first()["s"] == 6
    late = Program("late").add(Process("one", lambda: numbers(spark))).add(Process("fails", lambda x: x.selectExpr("raise_error('late')"), {"x": "one"})).add(Process("next", lambda: numbers(spark), after=("fails",)))
    ran = late.run(spark)
    assert ran.statuses == {"one": "IN-PROGRESS", "fails": "FAILED", "next": "TO-DO"} and "late" in ran.errors["fails"]
    assert ran.complete("one") == "FINISHED"
    assert {r["process"] for r in done.status().where("error is not null").collect()} == {"bad"}
    done.record(str(tmp_path / "statuses"))
    ran.record(str(tmp_path / "statuses"))
    assert {r["process"]: r["status"] for r in recorded(spark, str(tmp_path / "statuses")).collect()} == done.statuses | ran.statuses
    again = program.run(spark, str(tmp_path), keep={"sum": f"{tmp_path}/sum"})
    assert again.outputs["sum"].first()["s"] == 6


def test_assembly(spark):
    base = Program("base").add(Process("a", lambda: numbers(spark), ports=(Port("-n", "int", required=True),)))
    program = Program("p").add_program(base).add_alias("b", "a")
    program.add(Process("c", lambda x: x.selectExpr("id * 10 AS id"), {"x": "a"}))
    assert program.order().index("a") < program.order().index("c")
    program.redefine("c", inputs={"x": "b"})
    assert program.order().index("b") < program.order().index("c")
    assert program.documented(spark).count() == 2
    assert {tuple(r) for r in program.edges(spark).collect()} == {("c", "b", "none")}
    assert [r["process"] for r in program.planned(spark).where("needs = 'b'").collect()] == ["c"]
    assert program.run_process("c", x=numbers(spark)).count() == 3
    assert [r["id"] for r in program.run(spark).outputs["c"].sort("id").collect()] == [10, 20, 30]
    with pytest.raises(ValueError, match="twice"):
        program.add_program(base)
    with pytest.raises(ValueError, match="malformed"):
        Process("1x", numbers)
    with pytest.raises(ValueError, match="unknown"):
        Program("q").add(Process("a", numbers, {"x": "gone"})).order()
    with pytest.raises(ValueError, match="wait for one another"):
        Program("q").add(Process("a", numbers, {"x": "b"})).add(Process("b", numbers, {"x": "a"})).order()
