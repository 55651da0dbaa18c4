"""A condition on the run reads that run's files only."""

import os

from sieveworks.sources import readers


def test_other_runs_are_not_opened(spark, tmp_path):
    root = f"{tmp_path}/store"
    spark.range(60).selectExpr("id", "concat('r', id % 6) as run").write.partitionBy("run").json(root)
    with open(f"{root}/run=r3/bad.json", "w") as f:
        f.write('{"id": 1000}\nnot json\n{"id": "x"}\n')
    rows = readers.run_store(spark, root, "id long")
    assert sorted(r["id"] for r in rows.where("run = 'r3'").collect()) == [*range(3, 60, 6), 1000]
    assert rows.count() == 61
    for name in os.listdir(f"{root}/run=r5"):  # files of another run may be gone by now
        os.remove(f"{root}/run=r5/{name}")
    one = rows.where("run = 'r2'")
    assert one.count() == 10
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "= r2)]" in plan
