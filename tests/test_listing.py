import os
import random

import pytest
from pyspark.sql import functions as F

from namesmith.operators.align import running_total
from namesmith.operators.extract import number_methods
from namesmith.constants import EXTRACTED
from namesmith.sources import listing


def grow(root, rng, depth, paths):
    for i in range(rng.randrange(1, 5)):
        name = rng.choice(["a", "_b", ".c", "d e", "ü"]) + str(i)
        if depth and rng.random() < 0.6:
            (root / name).mkdir(exist_ok=True)
            grow(root / name, rng, depth - 1, paths)
        else:
            path = root / (name + rng.choice([".java", ".JAVA", ".txt"]))
            path.write_text(name * rng.randrange(40))
            paths.append(path)


@pytest.mark.parametrize("limit", [1, 3, 10_000])
def test_trees_in_one_round_and_in_many(spark, tmp_path, limit):
    paths = []
    grow(tmp_path, random.Random(limit), 5, paths)
    found = listing.list_files(spark, [str(tmp_path)], ".java", limit).collect()
    want = {str(p): p.stat().st_size for p in paths if p.name.endswith(".java")}
    assert {r.shown: r.size for r in found} == want and len(found) == len(want)
    read = listing.read_files(listing.list_files(spark, [str(tmp_path)], "", limit)).collect()
    assert {r.path: bytes(r.content) for r in read} == {str(p): p.read_bytes() for p in paths}


def test_roots_that_overlap_and_that_are_missing(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    for name in ("x/1.java", "x/y/2.java", "3.java"):
        (tmp_path / name).write_text(name)
    roots = [str(tmp_path), str(tmp_path / "x"), f"file://{tmp_path}/x/1.java", f"{tmp_path}/*/*.java",
             f"{tmp_path}/x/1.java"]
    found = [r.shown for r in listing.list_files(spark, roots).collect()]
    assert sorted(found) == sorted(str(tmp_path / n) for n in ("3.java", "x/1.java", "x/y/2.java"))
    assert [r.shown for r in listing.list_files(spark, roots[3:4]).collect()] == [str(tmp_path / "x/1.java")]
    assert listing.list_files(spark, [str(tmp_path)], ".none").collect() == []
    assert listing.read_files(listing.list_files(spark, [str(tmp_path)], ".none")).collect() == []
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, [str(tmp_path / "gone")])


def test_a_tree_of_two_hundred_thousand_files(spark, tmp_path):
    for i in range(400):
        folder = tmp_path / f"p{i % 20}" / f"m{i}"
        folder.mkdir(parents=True)
        for j in range(500):
            os.close(os.open(f"{folder}/F{j}.java", os.O_CREAT | os.O_WRONLY))
    found = listing.list_files(spark, [str(tmp_path)], ".java")
    assert found.agg(F.count("*"), F.count_distinct("shown")).first() == (200_000, 200_000)


def test_files_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "PARTITION_BYTES", 1000)
    monkeypatch.setattr(listing, "OPEN_BYTES", 100)
    for i in range(30):
        (tmp_path / f"{i}.java").write_text("x" * (i * 20))
    read = listing.read_files(listing.list_files(spark, [str(tmp_path)]))
    sizes = read.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content") + 100)).collect()
    assert len(sizes) >= 10 and max(s for _, s in sizes) <= 1000 + 700


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(i * 8 % 1001, rng.randrange(-5, 50)) for i in range(1001)]
    got = running_total(spark.createDataFrame(rows, "k int, n long").repartition(9), ["k"], "n").collect()
    total, want = 0, {}
    for k, n in sorted(rows):
        want[k] = total
        total += n
    assert {r.k: r.ahead for r in got} == want and len(got) == len(want)
    assert running_total(spark.createDataFrame([], "k int, n long"), ["k"], "n").collect() == []


def test_methods_of_which_some_are_left_out_have_gapless_ids(spark, shuffled_joins):
    blank = dict.fromkeys(EXTRACTED.names)
    rows = [blank | {"file_path": f"f{i:02}", "method_no": j, "identifier": f"{i}.{j}"}
            for i in range(30) for j in range(i % 4)]
    methods = spark.createDataFrame(rows, EXTRACTED).repartition(5)
    for kept in (methods, methods.where("method_no <> 1"), methods.where("method_no > 0"), methods.where("false")):
        want = sorted((r.file_path, r.method_no, r.identifier) for r in kept.collect())
        got = sorted((r.id, r.identifier) for r in number_methods(kept).collect())
        assert got == [(i, identifier) for i, (_, _, identifier) in enumerate(want)]
