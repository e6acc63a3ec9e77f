"""Appends that are seen whole or not at all."""

import pytest

from pagequarry.sources import runs, sinks


def rows(spark, *values):
    return spark.createDataFrame([(v, "s") for v in values], "v int, site string")


def seen(spark, path):
    return sorted(r.v for r in runs.committed(spark, path, "v int, site string").collect())


def test_a_run_done_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    assert runs.append_run(rows(spark, 1, 2), path, "a", ("site",)) == 2
    assert runs.append_run(rows(spark, 3), path, "b", ("site",)) == 1
    assert seen(spark, path) == [1, 2, 3]
    assert runs.append_run(rows(spark, 1, 2, 9), path, "a", ("site",)) == 3
    assert seen(spark, path) == [1, 2, 3, 9]
    assert sorted((r.run, r.rows) for r in runs.commits(spark, path).collect()) == [("run-a", 3), ("run-b", 1)]


def test_rows_without_a_commit_are_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    runs.append_run(rows(spark, 1), path, "a", ("site",))

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(runs, "commit", broken)
        for run in ("a", "b"):
            with pytest.raises(OSError):
                runs.append_run(rows(spark, 5, 6), path, run, ("site",))
    assert seen(spark, path) == [1]
    runs.append_run(rows(spark, 5, 6), path, "b", ("site",))
    assert seen(spark, path) == [1, 5, 6]


def test_a_run_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.append_run(rows(spark, 1), path, "a", ("site",))
    runs.append_run(rows(spark, 1).limit(0), path, "a", ("site",))
    assert seen(spark, path) == []
    products = spark.createDataFrame([(1, "x", "s")], "index int, name string, site string")
    assert sinks.append_products(products.limit(0), path + "2", run="r").first().error == "No products to save"
    assert sinks.append_products(products, path + "2", run="r").first().saved_count == 1
    assert [r.name for r in sinks.read_products(spark, path + "2").collect()] == ["x"]


def test_the_scan_is_pruned_to_committed_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.append_run(rows(spark, 1), path, "a", ("site",))
    plan = runs.committed(spark, path, "v int, site string")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
