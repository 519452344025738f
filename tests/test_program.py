"""The derived program's tasks follow its lines."""

from weft.operators import build
from weft.sources import program


def test_tasks_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(program, "LINES", 500)
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    p = program.derived(spark, sf)
    assert p.instr.rdd.getNumPartitions() == p.points_to.rdd.getNumPartitions() == -(-lines // 500)
    found = build.accesses(p)
    assert found.rdd.getNumPartitions() == -(-lines // 500)
    monkeypatch.undo()
    assert sorted(found.collect()) == sorted(build.accesses(program.derived(spark, sf)).collect())


def test_growing_tables_are_not_broadcast(spark):
    """Joins of nodes go by sorting; only objects, classes and one row pass the driver."""
    from weft.plans import catalog

    plan = catalog.QUERIES["rules_of_monitors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [node" in plan and "BroadcastHashJoin [node" not in plan and "BroadcastHashJoin [target" not in plan
