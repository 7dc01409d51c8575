"""Method tables, split datasets, predictions and metric reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import METHODS, METHODS_CSV, NULL_TOKENS
from ..functions.text import null_tokens, parse_list_literal, render_list_literal
from .records import read_records

_CELLS = {"quote": '"', "escape": '"'}
_CSV = {"header": "true", **_CELLS}


def peek_schema(spark: SparkSession, path: str) -> list[str]:
    """Header of a CSV file; an index column without a name reads ``_c0``."""
    return spark.read.options(**_CSV).csv(path).columns


def read_cells_csv(spark: SparkSession, path: str) -> DataFrame:
    """The method CSV as raw text cells, its nameless index column dropped."""
    header = peek_schema(spark, path)
    indexed = header[0] in ("_c0", "Unnamed: 0")
    names = (["_c0"] if indexed else []) + [c for c in header if c not in ("_c0", "Unnamed: 0")]
    schema = ", ".join(f"`{name}` string" for name in names)
    cells = read_records(spark, path).select(
        F.from_csv("text", F.lit(schema), {**_CELLS, "multiLine": "true"}).alias("cells")
    ).select("cells.*")
    return cells.withColumnRenamed("_c0", "id") if indexed else cells


def read_methods_csv(
    spark: SparkSession, path: str, tokens: list[str] = NULL_TOKENS
) -> DataFrame:
    """The method CSV in typed form: missing cells null, modifiers as an array.

    Cells hold line breaks; a file is read by as many tasks as it has splits all the same.
    """
    cells = read_cells_csv(spark, path)
    present = null_tokens(cells, [name for name in cells.columns if name != "id"], tokens)
    typed = present.withColumn("modifiers", parse_list_literal(F.col("modifiers")))
    if "id" in typed.columns:
        typed = typed.withColumn("id", F.col("id").cast("long"))
    return typed


def methods_csv_form(methods: DataFrame) -> DataFrame:
    """The text cells a method table has in CSV."""
    cells = methods.withColumn("modifiers", render_list_literal(F.col("modifiers")))
    return cells.select(*[F.col(name).cast("string").alias(name) for name in METHODS_CSV.names])


def write_methods(methods: DataFrame, path: str, format: str = "parquet") -> None:
    """Write the method table; ``csv`` prints modifiers as list literals."""
    if format == "csv":
        (
            methods_csv_form(methods)
            .withColumnRenamed("id", "")
            .write.options(
                **_CSV,
                emptyValue="",
                ignoreLeadingWhiteSpace="false",
                ignoreTrailingWhiteSpace="false",
            )
            .csv(path)
        )
    else:
        methods.select(*METHODS.names).write.format(format).save(path)


def write_examples(examples: DataFrame, path: str) -> None:
    """Parquet with one folder per split, so that reading one split prunes the rest."""
    examples.write.partitionBy("split").option("compression", "zstd").parquet(path)


def read_examples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    examples = spark.read.parquet(path)
    return examples if split is None else examples.where(F.col("split") == split)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Keyed predictions in a folder per run; ``files.write_prediction_lines`` is the flat form.

    Predictions without a ``run_id`` go to the run of the empty name.
    """
    named = predictions if "run_id" in predictions.columns else predictions.withColumn(
        "run_id", F.lit(""))
    named.select("example_id", "prediction", "run_id").write.partitionBy("run_id").parquet(path)


def read_predictions(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """``example_id, prediction, run_id`` of all runs, or of one, whose folder alone is read.

    Ids have the type they were written with; run names are text, also where they look like numbers.
    """
    kind = spark.read.parquet(path).schema["example_id"].dataType.simpleString()
    stored = spark.read.schema(f"example_id {kind}, prediction string, run_id string").parquet(path)
    stored = stored.withColumn("run_id", F.coalesce("run_id", F.lit("")))
    return stored if run_id is None else stored.where(F.col("run_id") == run_id)


def report(metrics: DataFrame) -> DataFrame:
    """Printed form of the metrics: two decimals, edit distance unrounded."""
    two = lambda name: F.format_string("%.2f", F.col(name))
    # The captions.
    lines = [
        F.concat(F.lit("Accuracy: "), two("accuracy")),
        F.concat(F.lit("ROUGE: "), two("rouge1")),
        F.concat(F.lit("Levenshtein Distance: "), F.col("levenshtein").cast("string")),
    ]
    if "similarity" in metrics.columns:
        lines.append(F.concat(F.lit("Semantic Similarity: "), two("similarity")))
    return metrics.select("run_id", F.posexplode(F.array(*lines)).alias("line_no", "line"))
