"""Source files to method rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from ..constants import EXTRACTED, METHODS
from ..storage import stage
from .align import lookup_join, number_rows, running_total
from .java_scan import each_method

_FLUSH_ROWS = 5_000
_FLUSH_CHARS = 16_000_000


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(EXTRACTED)
    rows: list[dict] = []
    held = 0
    for batch in batches:
        paths, texts = batch.column("file_path"), batch.column("text")
        for i in range(batch.num_rows):
            path = paths[i].as_py()
            for number, method in enumerate(each_method(texts[i].as_py() or "")):
                method["file_path"] = path
                method["method_no"] = number
                rows.append(method)
                held += len(method["block"] or "")
                if len(rows) >= _FLUSH_ROWS or held >= _FLUSH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def extract_methods(files: DataFrame) -> DataFrame:
    """``(file_path, text)`` rows to one row per method declaration.

    ``method_no`` counts the methods of a file; a method comes before those nested in
    its body. Output batches are cut by size, so a file of any shape streams through.
    """
    return files.select("file_path", "text").mapInArrow(_extract_batches, EXTRACTED)


def number_methods(methods: DataFrame) -> DataFrame:
    """Give extracted methods their gapless ``id``, by file and position in it.

    The id depends on the data alone, so splits made from it can be repeated on any
    cluster. It is the number of methods in files ahead plus the place in the file: only a
    table of files and counts is put in order, and bodies are written once. They move only
    where that table is too large to broadcast. Methods of which some are left out are
    ranked as rows instead.
    """
    extracted = stage(methods, "extracted")
    counts = stage(extracted.groupBy("file_path").agg(
        F.count("*").alias("n"), (F.max("method_no") + 1).alias("last"),
        F.count_distinct("method_no").alias("places")), "file-counts")
    if not counts.where("n <> last or n <> places or file_path is null").isEmpty():
        return number_rows(extracted, ["file_path", "method_no"], "id").select(*METHODS.names)
    ahead = running_total(counts.select("file_path", "n"), ["file_path"], "n").drop("n")
    placed = lookup_join(extracted, ahead, ["file_path"], unique=True)
    return placed.withColumn("id", F.col("ahead") + F.col("method_no")).select(*METHODS.names)


def register_java_methods(spark: SparkSession, name: str = "java_methods") -> None:
    """Register the scanner as a table function: ``LATERAL java_methods(path, text)``."""

    @udtf(returnType=EXTRACTED, useArrow=True)
    class JavaMethods:
        def eval(self, path: str, text: str):
            for number, method in enumerate(each_method(text or "")):
                method["file_path"] = path
                method["method_no"] = number
                yield tuple(method.get(field) for field in EXTRACTED.names)

    spark.udtf.register(name, JavaMethods)


def with_provenance(methods: DataFrame, root: str) -> DataFrame:
    """Rewrite ``file_path`` relative to ``root``."""
    prefix = root.rstrip("/") + "/"
    inside = F.col("file_path").startswith(prefix)
    relative = F.substring("file_path", len(prefix) + 1, 1 << 30)
    return methods.withColumn(
        "file_path", F.when(inside, relative).otherwise(F.col("file_path"))
    )
