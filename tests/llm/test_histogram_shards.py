import random
import zlib

import pytest

from namesmith.llm.histogram_shards import (
    find_splitters, histogram_shards, size_rows, write_shards,
)

from .common import awkward_rows, docs_table, prose


def expected(rows, shards):
    """Cumulative bytes in key order, cut where a multiple of the share is reached."""
    sized = sorted(
        (zlib.crc32((t or "").encode()), -(1 << 63) if i is None else i, len((t or "").encode()) + 1)
        for i, t in rows)
    total, before, out, slots = sum(s for *_, s in sized), 0, [], {}
    for crc, doc, size in sized:
        shard = before * shards // total
        out.append((None if doc == -(1 << 63) else doc, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()), key=str)


@pytest.mark.parametrize("probes", [2, 256])
def test_equals_the_cumulative_sizes(spark, probes):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(60))) for i in range(150)]
    # a hot text: equal texts are told apart by doc_id
    rows += [(1000 + i, "the same text for all of these rows") for i in range(100)]
    df = histogram_shards(docs_table(spark, rows, ["shard", "size"]), probes=probes)
    assert got(df) == expected(rows, 8)
    assert {(r.law, r.grown_shard) for r in df.collect()} == {("bytes", None)}


def test_awkward_rows(spark):
    rows = awkward_rows() + [(5, "rep")] * 30
    assert got(histogram_shards(docs_table(spark, rows), shards=3)) == expected(rows, 3)


def test_far_ids(spark):
    rows = [(i, "same") for i in (1 - (1 << 63), (1 << 63) - 1, 0, -1, 1, 1 << 40)]
    assert [x[3] for x in got(histogram_shards(docs_table(spark, rows), shards=6))] == [
        x[3] for x in expected(rows, 6)]


def test_empty_table(spark):
    assert got(histogram_shards(docs_table(spark, []))) == []


def test_tolerance_bounds_the_error(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 20)) for i in range(400)]
    sizes = size_rows(docs_table(spark, rows))
    assert len(find_splitters(sizes, 4, tolerance=500).cuts) == 3
    df = histogram_shards(docs_table(spark, rows), shards=4, tolerance=500)
    total = sum(x[1] for x in got(df))
    for s in range(4):
        assert abs(sum(x[1] for x in got(df) if x[3] == s) - total / 4) <= 1100


@pytest.mark.parametrize("piece_rows", [7, 60])
def test_shards_of_many_pieces(spark, piece_rows):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(60))) for i in range(150)]
    rows += [(1000 + i // 2, "the same text for all of these rows") for i in range(200)]
    docs = docs_table(spark, rows)
    pieces = find_splitters(size_rows(docs), 3, piece_rows=piece_rows)
    assert len(pieces.cuts) >= 350 // piece_rows and pieces.shard_of[-1] == 2
    assert got(histogram_shards(docs, shards=3, piece_rows=piece_rows)) == expected(rows, 3)


def test_rows_are_exchanged_once(spark, capsys):
    docs = docs_table(spark, [(i, f"text {i}") for i in range(50)])
    histogram_shards(docs).explain()
    plan = capsys.readouterr().out
    # by piece; the others are of counts, one row a piece
    assert plan.count("Exchange hashpartitioning(_piece") == 2 and "rangepartitioning" not in plan
    assert plan.count("Exchange hashpartitioning(shard") == 1


@pytest.mark.parametrize("piece_rows", [9, 1000])
def test_written_shards(spark, tmp_path, piece_rows):
    rows = awkward_rows() + [(5, "rep")] * 30
    path = str(tmp_path / "shards")
    write_shards(docs_table(spark, rows, ["shard", "size"]), path, shards=3, piece_rows=piece_rows)
    back = spark.read.parquet(path)
    want = expected(rows, 3)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard) for r in back.collect()), key=str) == [
        x[:4] for x in want]
    assert sorted((str(r.text) for r in back.collect())) == sorted(str(t) for _, t in rows)


def test_written_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_shards(docs_table(spark, []), path)
    assert spark.read.schema("doc_id long").parquet(path).collect() == []
