import pytest
from pyspark.sql import functions as F

from namesmith.constants import METHODS
from namesmith.operators import clean
from namesmith.sources import tables

ROWS = [
    # id, name, parameters, modifiers, body, then one of the seven return-type kinds
    (0, "getItem", "()", ["@NotNull", "public"], "{\n    return myItem;\n}", "Item"),
    (1, "getItems", "()", ["@NotNull", "public"], "{\n    return items; // all\n}", None, None, None, "List<Item>"),
    (2, "isOpen", "()", ["public"], "{\n    return open;\n}", None, "boolean"),
    (3, "find", "(String a, String b)", ["public", "static"], "{ /* x\n */return null; }", "Kind"),
    (4, "sum", "()", ["public", "abstract"], None, None, None, None, None, None, "int"),
    (5, "blank", "()", ["public"], "{}", None, None, None, None, None, None, "void"),
    (6, "blank2", "()", ["public"], "{\n }", None, None, None, None, None, None, "void"),
    (7, "passes", "()", ["public"], "{ }", None, None, None, None, None, None, "void"),
    (8, "bare", "()", [], "{ return 1; }", None, None, None, None, None, "int"),
    (9, "array", "()", ["public"], "{ return null; }"),
    (10, None, "()", ["public"], "{ return 1; }", "Kind"),
    (11, "viaText", "()", ['@Doc("abstract")', "public"], None, "Kind"),
    (12, "order", "()", ["static", "@A('c')", "final", "@B"], "{ x(); }", "Kind", "boolean"),
]


@pytest.fixture
def methods(spark):
    full = [tuple([*row, *[None] * (12 - len(row)), f"src/{row[0]}.java"]) for row in ROWS]
    return spark.createDataFrame(full, METHODS)


def test_valid_rows_and_text(methods):
    rows = {r.id: r for r in clean.clean_methods(methods).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 7, 11, 12]
    assert rows[0].full_code == "@NotNull\npublic Item <extra_id_0>() {\n    return myItem;\n}"
    assert rows[1].full_code == "@NotNull\npublic List<Item> <extra_id_0>() {\n    return items; }"
    assert rows[3].full_code == "\npublic static Kind <extra_id_0>(String a, String b) { return null; }"
    assert rows[4].full_code == "\npublic abstract int <extra_id_0>() nan"
    assert rows[12].full_code == "@A(c)\n@B\nstatic final Kind <extra_id_0>() { x(); }"
    assert rows[2].labels == "isOpen" and rows[2].type_identifier == "boolean"


def test_options(methods):
    typed = clean.drop_kind_columns(clean.resolve_return_type(methods))
    strict = {r.id for r in clean.valid_methods(typed, strict_abstract=True).collect()}
    assert 11 not in strict and 4 in strict
    text = clean.build_masked_code(typed.where("id = 4"), missing_body="").first().full_code
    assert text == "\npublic abstract int <extra_id_0>() "


def test_reject_counts(methods):
    counts = clean.reject_counts(clean.resolve_return_type(methods)).first().asDict()
    assert counts == {
        "n": 13, "kept": 8, "no_body": 2, "no_type": 1, "no_name": 1, "no_modifiers": 1,
    }


def test_csv_form(spark, methods, tmp_path):
    path = str(tmp_path / "csv")
    tables.write_methods(methods.coalesce(1), path, "csv")
    assert tables.peek_schema(spark, path)[0] == "_c0"
    back = {r.id: r.asDict() for r in tables.read_methods_csv(spark, path).collect()}
    for row in methods.collect():
        assert back[row.id] == row.asDict()


def test_csv_of_another_writer(spark, methods, tmp_path):
    frame = methods.toPandas().drop(columns="id")
    frame["modifiers"] = frame["modifiers"].map(lambda m: repr(list(m)))
    frame.to_csv(tmp_path / "methods.csv")
    back = tables.read_methods_csv(spark, str(tmp_path / "methods.csv"))
    assert sorted(map(str, back.select(*METHODS.names).collect())) == sorted(
        map(str, methods.collect())
    )
    unnamed = tmp_path / "no_index.csv"
    frame.to_csv(unnamed, index=False)
    assert "id" not in tables.read_methods_csv(spark, str(unnamed)).columns


def test_body_columns_are_pruned(spark, methods, tmp_path):
    """Counting names must not read the bodies."""
    path = str(tmp_path / "methods")
    tables.write_methods(methods, path)
    kept = spark.read.parquet(path).where(clean.name_present()).select("identifier")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(identifier)" in plan
    assert "ReadSchema: struct<identifier:string>" in plan


def test_splits_are_partitions(spark, tmp_path):
    rows = spark.range(30).select(
        "id", F.element_at(F.array(*map(F.lit, ["train", "test", "validation"])), (F.col("id") % 3 + 1).cast("int")).alias("split")
    )
    path = str(tmp_path / "examples")
    tables.write_examples(rows, path)
    test = tables.read_examples(spark, path, "test")
    assert sorted(r.id for r in test.collect()) == list(range(1, 30, 3))
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()
