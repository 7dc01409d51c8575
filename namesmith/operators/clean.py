"""Method rows to valid examples with the name masked. Projections and filters only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EMPTY_BODIES, MASK_TOKEN, TYPE_KINDS
from ..functions.text import body_text, format_annotations, format_keywords, strip_comments


def drop_index(cells: DataFrame) -> DataFrame:
    """Drop the CSV index column."""
    return cells.drop("id", "_c0", "Unnamed: 0")


def resolve_return_type(methods: DataFrame) -> DataFrame:
    """Fill ``type_identifier`` from the first return-type kind that is present."""
    return methods.withColumn("type_identifier", F.coalesce(*TYPE_KINDS))


def drop_kind_columns(methods: DataFrame) -> DataFrame:
    return methods.drop(*TYPE_KINDS[1:])


def body_present() -> Column:
    block = F.col("block")
    return block.isNotNull() & ~block.isin(EMPTY_BODIES)


def is_abstract(strict: bool = False) -> Column:
    """By default any modifier text holding ``abstract`` counts, annotations too."""
    if strict:
        found = F.array_contains("modifiers", "abstract")
    else:
        found = F.array_join("modifiers", ", ").contains("abstract")
    return F.coalesce(found, F.lit(False))


def name_present() -> Column:
    return F.col("identifier").isNotNull() & (F.col("identifier") != "")


def type_present() -> Column:
    return F.col("type_identifier").isNotNull() & (F.col("type_identifier") != "")


def modifiers_present() -> Column:
    return F.coalesce(F.size("modifiers") > 0, F.lit(False))


def valid_methods(methods: DataFrame, strict_abstract: bool = False) -> DataFrame:
    """Rows with a body (unless abstract), a return type, a name and modifiers."""
    return methods.where(
        name_present()
        & modifiers_present()
        & type_present()
        & (body_present() | is_abstract(strict_abstract))
    )


def reject_counts(methods: DataFrame, strict_abstract: bool = False) -> DataFrame:
    """Rows in, rows kept, and rows each rule rejects (rules overlap)."""
    body = body_present() | is_abstract(strict_abstract)
    kept = name_present() & modifiers_present() & type_present() & body
    return methods.agg(
        F.count("*").alias("n"),
        F.count_if(kept).alias("kept"),
        F.count_if(~body).alias("no_body"),
        F.count_if(~type_present()).alias("no_type"),
        F.count_if(~name_present()).alias("no_name"),
        F.count_if(~modifiers_present()).alias("no_modifiers"),
    )


def masked_code(missing_body: str = "nan") -> Column:
    """Method text with the name hidden: annotations, head, parameters, body."""
    return F.concat(
        format_annotations(F.col("modifiers")),
        F.lit("\n"),
        format_keywords(F.col("modifiers")),
        F.lit(" "),
        F.col("type_identifier"),
        F.lit(" " + MASK_TOKEN),
        F.coalesce(F.col("formal_parameters"), F.lit("nan")),
        F.lit(" "),
        strip_comments(body_text(F.col("block"), missing_body)),
    )


def build_masked_code(methods: DataFrame, missing_body: str = "nan") -> DataFrame:
    return methods.withColumn("full_code", masked_code(missing_body))


def name_as_label(examples: DataFrame) -> DataFrame:
    return examples.withColumnRenamed("identifier", "labels")


def clean_methods(methods: DataFrame) -> DataFrame:
    """All cleaning steps: one scan stage without a shuffle."""
    typed = drop_kind_columns(resolve_return_type(methods))
    return name_as_label(build_masked_code(valid_methods(typed)))


def encoded_only(examples: DataFrame) -> DataFrame:
    """Drop the text columns once a row is encoded."""
    keep = ("id", "split", "labels", "input_ids", "attention_mask")
    return examples.select(*[name for name in keep if name in examples.columns])
