from collections import Counter

import pytest
from pyspark.sql import functions as F

from namesmith.operators import align
from namesmith.sources import files
from namesmith.storage import shared_dir


def test_positions(spark):
    shuffled = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(9)
    rows = align.number_rows(shuffled, ["v"]).collect()
    assert len(rows) == 5000 and all(r.v == r.position for r in rows)


def test_zip(spark):
    left = spark.range(100).select(F.col("id").alias("a")).repartition(6)
    right = spark.range(40).select((F.col("id") * 2).alias("b")).repartition(3)
    pairs = align.zip_by_position(left, right, ["a"], ["b"]).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(i, 2 * i) for i in range(40)]
    with pytest.raises(ValueError, match="100 and 40"):
        align.zip_by_position(left, right, ["a"], ["b"], strict=True)


def test_lookup_with_dominant_keys(spark, shuffled_joins):
    """A third of the rows share one key, another third a key the table lacks."""
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, -5).otherwise(F.col("id") % 97).alias("k"),
    ).unionByName(spark.createDataFrame([(9999, None)], "id long, k int"))
    table = spark.range(60).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    found = align.lookup_join(rows, table, ["k"])
    got = {r.id: (r.k, r.v) for r in found.collect()}
    plain = {r.id: (r.k, r.v) for r in rows.join(table, ["k"], "left").collect()}
    assert got == plain and found.count() == 3001


def test_lookup_rejects_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, k string")
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    with pytest.raises(Exception, match="a key of k is repeated"):
        align.lookup_join(rows, table, ["k"]).collect()
    assert align.lookup_join(rows, table.where("v <> 2"), ["k"]).first().v == 1


def test_lookup_reads_the_rows_once(spark, shuffled_joins, tmp_path):
    spark.range(100).withColumn("k", F.col("id") % 7).write.parquet(str(tmp_path / "rows"))
    table = spark.range(7).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    found = align.lookup_join(spark.read.parquet(str(tmp_path / "rows")), table, ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_multisets(spark):
    a, b = [1, 1, 1, 2, None, None], [1, 1, 2, 2, None, 3]
    left, right = ([(x,) for x in side] for side in (a, b))
    got = align.multiset_intersect(
        spark.createDataFrame(left, "v int"), spark.createDataFrame(right, "v int")
    )
    assert {r.v: r.copies for r in got.collect()} == dict(Counter(a) & Counter(b))
    bag = align.bag_count(spark.createDataFrame(left, "v int"), ["v"])
    assert {r.v: r.n for r in bag.collect()} == dict(Counter(a))


def test_prediction_lines(spark, tmp_path):
    names = spark.range(500).select("id", F.concat(F.lit("name"), "id").alias("prediction"))
    path = str(tmp_path / "lines")
    files.write_prediction_lines(names.repartition(5), path, ["id"])
    back = files.read_prediction_lines(spark, path).collect()
    assert sorted((r.position, r.prediction) for r in back) == [(i, f"name{i}") for i in range(500)]


def test_lines_of_one_file_in_many_splits(spark, tmp_path):
    path = tmp_path / "flat.txt"
    path.write_text("".join(f"n{i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        back = files.read_prediction_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.position, r.prediction) for r in back) == [(i, f"n{i}") for i in range(4000)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
