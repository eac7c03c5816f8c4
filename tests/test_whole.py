"""Queries over tables on which a bound or filter would lose rows."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from trifold import storage
from trifold.operators import graph
from trifold.plans import queries as core


def test_renames_of_parts_with_large_keys(spark, tmp_path):
    keys = [1, 7, 14, 35, 20_000, 20_001, 20_006, 20_013, 20_020, 40_005, 70_000]
    part = spark.createDataFrame([(k, f"type {k}", k % 50) for k in keys], "p_partkey long, p_type string, p_size int")
    part.write.parquet(str(tmp_path / "part.parquet"))
    ours = {f"g{k}": f"f{k}" for k in keys if k % 7 == 0}
    assert {r.branch_id: r.base_id for r in core.rename_detect(spark, str(tmp_path)).collect()} == ours
    both = {(f"f{k}", f"g{k}", f"h{k}") for k in keys if k % 35 == 0}
    assert {(r.base_id, r.ours_id, r.theirs_id) for r in core.rename_rename(spark, str(tmp_path)).collect()} == both
    assert core.word_boundary_normalize(spark, str(tmp_path)).count() == len(keys)


def test_impact_of_a_long_chain(spark):
    edges = spark.range(70).select(F.concat(F.lit("n"), F.col("id") + 1).alias("src"), F.concat(F.lit("n"), F.col("id")).alias("dst"))
    found = graph.impact(edges.coalesce(1), spark.createDataFrame([("n0",)], "id string"))
    assert {r.id: r.depth for r in found.collect()} == {f"n{k}": k for k in range(1, 71)}


def test_shared_folder_is_asked_for_off_one_machine():
    named = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.shared_dir(named(master))
        assert storage.shared_dir(named(master, "hdfs://name/shared/")) == "hdfs://name/shared"


def test_tables_of_a_run_go_when_it_is_over(spark, tmp_path):
    with storage.Scratch(spark) as hold:
        one = hold.cut(spark.range(5), "one")
        kept = hold.result(one.filter("id > 2"), "kept")
        path = hold.paths[0]
        assert one.count() == 5
    assert sorted(r.id for r in kept.collect()) == [3, 4] and not spark._jvm.java.io.File(path.removeprefix("file:")).exists()


def test_small_tables_are_spread(spark, monkeypatch):
    rows = spark.range(1000)
    assert sorted(r.id for r in storage.spread(rows).collect()) == list(range(1000))
    monkeypatch.setattr(storage, "SMALL", 0)
    assert storage.spread(rows) is rows
