import random

import pytest

from namesmith.sources.records import ends_quoted, read_records
from namesmith.sources.tables import peek_schema, read_cells_csv

NAMES = ["a", "b", "c"]


def reference(spark, path):
    """Spark's own reader, one task a file."""
    return spark.read.options(header="true", quote='"', escape='"', multiLine="true").schema(
        ", ".join(f"{n} string" for n in NAMES)).csv(path)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def cell(rng):
    text = "".join(rng.choice(["x", "yz", " ", ",", "\n", '"', "é", "\r\n", "{\n  }"]) for _ in range(rng.randrange(7)))
    if any(c in text for c in ',\n"\r') or rng.random() < 0.3:
        return '"' + text.replace('"', '""') + '"'
    return text


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_one_file_is_read_by_many_tasks(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    end = ["\n", "\r\n"][seed % 2]
    text = "a,b,c" + end + end.join(",".join(cell(rng) for _ in NAMES) for _ in range(120))
    path = tmp_path / "m.csv"
    path.write_bytes((text + end * (seed % 3)).encode())
    found, want = rows(read_cells_csv(spark, str(path))), rows(reference(spark, str(path)))
    if seed % 2:
        # where records end in \r\n Spark's reader writes those within cells as \n; here they stay
        assert any("\r\n" in c for r in found for c in r if c)
        found, want = (sorted(tuple(c and c.replace("\r\n", "\n") for c in r) for r in x) for x in (
            [[c or "" for c in r] for r in found], [[c or "" for c in r] for r in want]))
    assert found == want
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10


def test_records_longer_than_many_splits(spark, small_splits, tmp_path):
    long = '"' + "line, with ""\n" * 60 + '"'
    text = '"a",b,c\n1,' + long + ",z\n2,y,z\n3," + long + "," + long + "\n"
    (tmp_path / "m.csv").write_text(text)
    assert rows(read_cells_csv(spark, str(tmp_path))) == rows(reference(spark, str(tmp_path)))


def test_a_folder_of_files_with_headers(spark, small_splits, tmp_path):
    rng = random.Random(9)
    for i in range(5):
        lines = ["a,b,c"] + [",".join(cell(rng) for _ in NAMES) for _ in range(i * 10)]
        (tmp_path / f"part-{i}.csv").write_bytes("\n".join(lines).encode())
    assert rows(read_cells_csv(spark, str(tmp_path))) == rows(reference(spark, str(tmp_path)))


def test_quotes_where_none_are_due(spark, small_splits, tmp_path):
    lines = ['a,b,c', 'it"s,5" x,"', '",y,z', '"q"uo,w,e', 'r,"t",""', '"",,"""', '"', 'u,"a""b",i"', '"a"",b\n",c,d',
             'x,y"""z,w', 'plain,1,2'] * 8
    (tmp_path / "m.csv").write_text("\n".join(lines))
    assert peek_schema(spark, str(tmp_path / "m.csv")) == NAMES
    assert rows(read_cells_csv(spark, str(tmp_path / "m.csv"))) == rows(reference(spark, str(tmp_path / "m.csv")))


def test_empty_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b,c\n")
    assert read_cells_csv(spark, str(tmp_path / "m.csv")).collect() == []
    assert read_records(spark, str(tmp_path / "m.csv")).collect() == []


def test_ends():
    for line, plain, quoted in [("", False, True), ('"', True, False), ('""', False, True), ('a"', False, False),
                                ('"a",b', False, False), ('x,"', True, False), ('","', False, True), ('"",""",', True, False)]:
        assert (ends_quoted(line, False), ends_quoted(line, True)) == (plain, quoted), line
