"""Scans, sinks and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.operators.align import number_rows, zip_by_position
from namesmith.operators.extract import (
    extract_methods, number_methods, register_java_methods, with_provenance,
)
from namesmith.functions.text import null_tokens, parse_list_literal, render_list_literal
from namesmith.sources import files, tables
from namesmith.sources.listing import open_root
from namesmith.storage import fresh_path

from . import sql, views
from .clean import clean, tagged
from .registry import check

FIELDS = sql.FIELDS

# classes to a written file: a file is one row when it is read, so more rows are more files
FILE_CLASSES = 5_000


def flat(methods: DataFrame, *first: str) -> DataFrame:
    return methods.select(
        *first,
        *[
            F.array_join("modifiers", "|").alias("mods") if name == "mods" else F.col(name)
            for name in FIELDS
        ],
    )


@check(
    "decode_text",
    f"""{views.ctes('source_text')}
select file_path, text from source_text""",
)
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.decode_files(views.source_files(spark, sf_dir))


@check(
    "extract_methods",
    f"""{views.ctes('sources', extracted=sql.EXTRACTED)}
select * from extracted""",
)
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = files.decode_files(views.source_files(spark, sf_dir))
    return flat(extract_methods(texts), "file_path", "method_no")


@check(
    "extract_methods_lateral",
    f"""{views.ctes('sources', extracted=sql.EXTRACTED)}
select * from extracted""",
)
def extract_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_java_methods(spark)
    files.decode_files(views.source_files(spark, sf_dir)).createOrReplaceTempView("java_files")
    methods = spark.sql(
        "select m.* from java_files f, lateral java_methods(f.file_path, f.text) m"
    )
    return flat(methods, "file_path", "method_no")


@check(
    "number_methods",
    f"""{views.ctes('sources', extracted=sql.EXTRACTED)}
select row_number() over (order by file_path, method_no) - 1 as id, file_path, identifier, block
from extracted""",
)
def number(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = extract_methods(files.decode_files(views.source_files(spark, sf_dir)))
    return number_methods(methods).select("id", "file_path", "identifier", "block")


@check(
    "scan_source_files",
    f"""{views.ctes('sources', extracted=sql.EXTRACTED)}
select {', '.join(FIELDS)} from extracted""",
)
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templated classes, written as many to a file, then scanned from disk."""
    root = fresh_path(spark, "sources")
    texts = views.spark_view(spark, sf_dir, "source_text").select("text")
    texts.write.option("maxRecordsPerFile", FILE_CLASSES).text(root)
    return flat(extract_methods(files.read_source_files(spark, root, suffix=".txt")))


# every class in a file of its own, three of four under names that Spark's readers pass over
ODD_PATH = """case id % 4 when 0 then '_gen/M' when 1 then '.h/M' when 2 then 'src/_M'
 else 'src/M' end || cast(id as varchar(20)) || '.java'"""


def write_files(texts: DataFrame, root: str) -> None:
    """``path, text`` rows to files below a shared folder."""

    def run(batches):
        import os

        from pyarrow import fs

        system, base, _ = open_root(root)
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                system.create_dir(os.path.dirname(f"{base}/{path}"), recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(text.encode())
            yield batch

    texts.mapInArrow(run, "path string, text string").write.format("noop").mode("overwrite").save()


@check(
    "scan_all_names",
    f"""{views.ctes('source_text')}
select {ODD_PATH} as path, md5(text) as digest from source_text""",
)
def scan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "odd-names")
    texts = views.spark_view(spark, sf_dir, "source_text")
    write_files(texts.select(F.expr(ODD_PATH).alias("path"), "text"), root)
    found = files.scan_source_files(spark, root)
    below = F.regexp_replace(F.col("path"), "^.*/(?=[^/]+/[^/]+$)", "")
    return found.select(below.alias("path"), F.md5("content").alias("digest"))


@check(
    "relative_paths",
    f"""{views.ctes('fx')}
select id, substr(file_path, 5) as file_path from fx""",
)
def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_provenance(views.fx(spark, sf_dir), "src").select("id", "file_path")


@check(
    "file_name_filter",
    f"""{views.ctes('fx')}
select id, file_path from fx where file_path like '%7.java'""",
)
def suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = views.fx(spark, sf_dir)
    return methods.where(files.has_suffix(F.col("file_path"), "7.java")).select("id", "file_path")


CSV_FORM = f"""{views.ctes('fx')}
select id, {', '.join(f"{sql.null_token(c)} as {c}" for c in FIELDS if c != 'mods')}, mods,
 {sql.null_token('file_path')} as file_path from fx"""


@check("methods_csv", CSV_FORM)
def methods_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "methods-csv")
    tables.write_methods(views.fx(spark, sf_dir), path, "csv")
    return flat(tables.read_methods_csv(spark, path), "id", "file_path")


@check("null_tokens", CSV_FORM)
def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = views.fx(spark, sf_dir)
    text = [name for name in FIELDS if name != "mods"] + ["file_path"]
    return flat(null_tokens(methods, text), "id", "file_path")


@check(
    "list_literals",
    f"""{views.ctes('fx')}
select id, mods, case when mods = '' then '[]'
 else '[''' || replace(mods, '|', ''', ''') || ''']' end as literal from fx""",
)
def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.fx(spark, sf_dir).select(
        "id", render_list_literal(F.col("modifiers")).alias("literal")
    )
    return shown.select(
        "id", F.array_join(parse_list_literal(F.col("literal")), "|").alias("mods"), "literal"
    )


@check(
    "methods_parquet",
    f"""{views.ctes('fx')}
select id, file_path, {', '.join(FIELDS)} from fx""",
)
def methods_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "methods")
    tables.write_methods(views.fx(spark, sf_dir), path)
    return flat(spark.read.parquet(path), "id", "file_path")


@check(
    "read_examples",
    f"""{views.ctes('fx', clean=sql.CLEAN, tagged=sql.TAGGED)}
select id, labels, full_code, split from tagged where split = 'test'""",
)
def read_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "examples")
    tables.write_examples(tagged(spark, sf_dir), path)
    return tables.read_examples(spark, path, "test").select("id", "labels", "full_code", "split")


@check(
    "read_predictions",
    f"""{views.ctes('pairs')}
select example_id, run_id, prediction from pairs""",
)
def read_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "predictions")
    tables.write_predictions(views.pairs(spark, sf_dir), path)
    return tables.read_predictions(spark, path)


@check(
    "prediction_lines",
    f"""{views.ctes('pairs')}
select row_number() over (order by run_id, example_id) - 1 as position, run_id, example_id, label,
 prediction from pairs""",
)
def prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions go through flat lines and come back to their labels by position."""
    path = fresh_path(spark, "lines")
    pairs = views.pairs(spark, sf_dir)
    files.write_prediction_lines(pairs, path, ["run_id", "example_id"])
    lines = files.read_prediction_lines(spark, path).withColumnRenamed("position", "line_no")
    labels = pairs.select("run_id", "example_id", "label")
    order = ["run_id", "example_id"]
    return zip_by_position(labels, lines, order, ["line_no"], strict=True).select(
        "position", "run_id", "example_id", "label", "prediction"
    )


@check(
    "zip_by_position",
    """
select a.position, a.item_id, b.order_id
from (select o_orderkey as order_id, row_number() over (order by o_orderkey) - 1 as position
      from orders) b
join (select doc_id as item_id, row_number() over (order by doc_id desc) - 1 as position
      from documents) a using (position)""",
)
def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of unequal length: the longer one is cut."""
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    docs = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), (-F.col("doc_id")).alias("back")
    )
    return zip_by_position(docs, orders, ["back"], ["order_id"]).select(
        "position", "item_id", "order_id"
    )


@check(
    "number_rows",
    """
select l_orderkey, l_linenumber, l_partkey,
 row_number() over (order by l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1
 as position
from lineitem""",
)
def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"
    )
    return number_rows(
        lines, ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    ).select("l_orderkey", "l_linenumber", "l_partkey", "position")
