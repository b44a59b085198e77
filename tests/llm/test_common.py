import re
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrion.llm import common


def test_join_groups_splits_hot_keys(spark, monkeypatch):
    rows = spark.range(25_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("k < 5000")
    got = common.join_groups(rows, groups, ["k"], "n", 25_000)
    assert got.columns == ["k", "id", "n", "first"] and got.count() == 25_000
    assert got.where("k = 0").select("n", "first").distinct().collect() == [(12_500, 0)]
    assert got.where("k >= 5000 AND n IS NOT NULL").count() == 0 and got.where("k > 0 AND k < 5000 AND first = id").count() == 2500


def test_drawing_from_a_trillion_rows(spark):
    df = spark.range(100_000).select(common._drawn(F.xxhash64("id"), F.lit(10**12), 10**10).alias("in"))
    assert 800 < df.where("in").count() < 1200


def test_bounded_sample(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("g"), F.lit("x").alias("more"))
    got = common.bounded_sample(df, "id", 200, "g")
    assert got.columns == df.columns
    assert {r.g: r.n for r in got.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {"rare": 50, "common": 200}
    assert sorted(got.collect()) == sorted(common.bounded_sample(df.repartition(7), "id", 200, "g").collect())
    assert common.bounded_sample(df, "id", 300).count() == 300 and common.bounded_sample(df.limit(0), "id", 5, "g").collect() == []


def test_text_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 10)
    texts = ["aaaa", None, "bbbb", "c" * 50, "", "dd", "eeeeeeeee"]
    batch = pa.record_batch({"doc_id": list(range(7)), "text": texts}).slice(1)
    parts = [(rows.column(0).to_pylist(), t.to_pylist()) for rows, t in common.text_batches([batch, batch.slice(0, 0)])]
    assert [i for ids, _ in parts for i in ids] == [1, 2, 3, 4, 5, 6] and [x for _, t in parts for x in t] == ["", "bbbb", "c" * 50, "", "dd", "eeeeeeeee"]
    assert all(len("".join(t)) <= 10 or len(t) == 1 for _, t in parts)


def test_stored_keeps_schema_of_empty_frames(spark):
    df = spark.createDataFrame([], "a bigint, b array<string>")
    out = common.stored(df, "nothing")
    assert out.schema == df.schema and out.collect() == []
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    assert any(shared.glob("quarrion-*/nothing-*"))
    common.clear(spark)
    assert not any(shared.glob("quarrion-*"))


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_stored_leaves_no_shuffle_files(spark):
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(cleanup, None)
    df = spark.range(100_000).repartition(4, "id").groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = common.stored(df.join(spark.range(500).withColumnRenamed("id", "k").hint("merge"), "k"), "joined")
    for _ in range(50):  # they go in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert out.count() == 500 and df.count() == 1000 and common.stored(df, "again").count() == 1000
    assert spark.conf.get(cleanup, None) == setting


def test_stored_releases_the_memory_of_the_jvm(spark, monkeypatch):
    assert "Trim native heap" in common.release_jvm_memory(spark)
    calls = []
    monkeypatch.setattr(common, "release_jvm_memory", lambda s: calls.append(s))
    common.stored(spark.range(3), "few")
    assert calls == [spark]


def test_free_name():
    assert common.free_name(["a", "B_"], "b") == "b" and common.free_name(["b", "B_"], "b") == "b__"


def test_nothing_else_imports_the_subpackage():
    root = Path(common.__file__).parents[2]
    for path in (root / "quarrion").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"quarrion\.llm|from quarrion import llm", path.read_text()), path


@pytest.mark.parametrize("name", ["localCheckpoint", "toPandas", "collect()"])
def test_operators_do_not_gather_rows(name):
    for path in Path(common.__file__).parent.glob("*.py"):
        assert name not in path.read_text(), path
