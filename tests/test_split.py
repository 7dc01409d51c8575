import hashlib

import pytest
from pyspark.sql import functions as F

from namesmith.operators import split


def order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def ids(df):
    return {r.id for r in df.collect()}


def test_exact_sizes_and_order(spark):
    df = spark.range(3000)
    ranked = order(range(3000), 42)
    for n in (1, 7, 1500, 3000):
        assert ids(split.take_first(df, n)) == set(ranked[:n])
    assert ids(split.take_first(df, 0)) == set()


def test_too_few_rows(spark):
    with pytest.raises(Exception, match="fewer than 11 rows"):
        split.take_first(spark.range(10), 11).collect()


def test_tags(spark):
    tagged = split.tag_splits(spark.range(2000), 500, 200)
    parts = {name: {r.id for r in tagged.where(F.col("split") == name).collect()}
             for name in ("train", "validation", "test")}
    held = order(range(2000), 42)[:500]
    assert parts["validation"] == set(order(held, "42:2")[:200])
    assert parts["test"] == set(held) - parts["validation"]
    assert parts["train"] == set(range(2000)) - set(held)
    rest, held_out = split.holdout(spark.range(2000), 500)
    test, validation = split.second_split(held_out, 200)
    assert ids(rest) == parts["train"]
    assert ids(test) == parts["test"] and ids(validation) == parts["validation"]


def test_sizes_of_zero(spark):
    df = spark.range(20)
    rest, none = split.holdout(df, 0)
    assert rest.count() == 20 and none.count() == 0
    test, validation = split.second_split(df, 0)
    assert test.count() == 20 and validation.count() == 0
    sizes = {}
    for n, v in ((5, 0), (0, 0), (5, 5)):
        counted = split.tag_splits(df, n, v).groupBy("split").count().collect()
        sizes[n, v] = {r.split: r["count"] for r in counted}
    assert sizes == {(5, 0): {"train": 15, "test": 5}, (0, 0): {"train": 20},
                     (5, 5): {"train": 15, "validation": 5}}
    with pytest.raises(Exception, match="fewer than 21 rows"):
        split.tag_splits(df, 21, 3).collect()


def test_stable_under_repartition(spark):
    one = split.tag_splits(spark.range(1000).coalesce(1), 100, 50)
    many = split.tag_splits(spark.range(1000).repartition(13), 100, 50)
    assert sorted(one.collect()) == sorted(many.collect())
    assert ids(split.take_first(spark.range(50).repartition(7), 9, seed=1)) != ids(
        split.take_first(spark.range(50), 9, seed=2)
    )


def test_tagging_moves_no_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).withColumn("wide", F.repeat(F.lit("x"), 10)).write.parquet(path)
    tagged = split.tag_splits(spark.read.parquet(path), 100, 50)
    plan = tagged._jdf.queryExecution().optimizedPlan()
    assert plan.children().size() == 1 and "Join" not in plan.toString()


def test_ratio(spark):
    counts = {r.split: r["count"] for r in split.ratio_split(spark.range(20000)).groupBy("split").count().collect()}
    assert sum(counts.values()) == 20000
    assert abs(counts["train"] / 20000 - 0.70) < 0.02
    assert abs(counts["test"] / 20000 - 0.15) < 0.02


def test_complement_and_head(spark):
    assert ids(split.complement(spark.range(10), spark.range(4))) == set(range(4, 10))
    assert [r.id for r in split.head(spark.range(100).repartition(5), 3).collect()] == [0, 1, 2]
