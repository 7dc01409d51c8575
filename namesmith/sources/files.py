"""Source-code files and flat prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SOURCE_SUFFIX
from ..functions.text import decode_text
from ..operators.align import number_rows
from .listing import list_files, read_files


def scan_source_files(
    spark: SparkSession, roots: str | list[str], suffix: str = SOURCE_SUFFIX
) -> DataFrame:
    """``(path, content)`` of every file below ``roots`` whose name ends in ``suffix``.

    A root is a folder, a file or a glob of any shared file system. No name is left out,
    whatever it starts with. Listing is a Spark job itself, made when this is called; small
    files share partitions of about equal bytes.
    """
    return read_files(list_files(spark, [roots] if isinstance(roots, str) else list(roots), suffix))


def read_source_files(
    spark: SparkSession, roots: str | list[str], suffix: str = SOURCE_SUFFIX
) -> DataFrame:
    """``(file_path, text)`` of the scanned files, decoded."""
    return decode_files(scan_source_files(spark, roots, suffix))


def decode_files(files: DataFrame) -> DataFrame:
    return files.select(plain_path(F.col("path")).alias("file_path"),
                        decode_text(F.col("content")).alias("text"))


def plain_path(path: Column) -> Column:
    """Drop the scheme of local file URIs; other paths stay as they are."""
    return F.regexp_replace(path, "^file:(?://)?(?=/)", "")


def has_suffix(path: Column, suffix: str = SOURCE_SUFFIX) -> Column:
    """Case-sensitive file name filter for paths that are already rows."""
    return path.endswith(suffix)


def write_prediction_lines(predictions: DataFrame, path: str, order_by: list[str]) -> None:
    """One name per line, in order over the part files."""
    predictions.repartitionByRange(*order_by).sortWithinPartitions(*order_by).select(
        "prediction"
    ).write.text(path)


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(position, prediction)`` of a flat prediction file or folder of part files.

    The position follows file name, split offset and line order, whatever order the
    splits are scanned in.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("prediction"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"),
    )
    numbered = number_rows(lines, ["_file", "_split", "_line"], "position")
    return numbered.select("position", "prediction")
