"""Scores by kinds of methods: how long the body is, what it is for, what it returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TYPE_KINDS
from ..functions.names import levenshtein, ratio
from .clean import is_abstract
from .metrics import subword_counts

#: quantile classes of bodies with more than one line
CLASSES = 3
#: relative error of the sketch that finds the bounds is one part in so many
ACCURACY = 10_000
ALL = "all"


def body_lines(block: Column | str) -> Column:
    """Lines of a body; null for a missing one."""
    block = F.col(block) if isinstance(block, str) else block
    return F.when(block.isNotNull(), F.size(F.split(block, "\n")))


def length_bounds(methods: DataFrame, classes: int = CLASSES) -> list[int]:
    """Largest numbers of lines of all classes but the last, from a mergeable quantile sketch.

    Of equal bounds one is left, so there may be fewer classes.
    """
    shares = [i / classes for i in range(1, classes)]
    if not shares:
        return []
    found = methods.select(body_lines("block").alias("n")).where("n > 1").agg(
        F.percentile_approx("n", shares, ACCURACY)).first()[0]
    return sorted(set(found or []))


def body_class(block: Column | str, bounds: list[int]) -> Column:
    """``none``, ``one line``, ``to n lines`` for each bound, or ``over n lines``."""
    block = F.col(block) if isinstance(block, str) else block
    lines = body_lines(block)
    named = F.when(block.isNull(), "none").when(lines == 1, "one line")
    for bound in bounds:
        named = named.when(lines <= bound, f"to {bound} lines")
    return named.otherwise(f"over {bounds[-1]} lines" if bounds else "more lines")


def purpose() -> Column:
    """``abstract``, ``test``, ``override`` or ``other``, from the modifiers."""
    marks = F.transform(F.coalesce("modifiers", F.array().cast("array<string>")),
                        lambda m: F.regexp_extract(m, r"^@(?:\w+[.])*(\w+)", 1))
    return (
        F.when(is_abstract(), "abstract")
        .when(F.exists(marks, lambda m: m.endswith("Test")), "test")
        .when(F.array_contains(marks, "Override"), "override")
        .otherwise("other")
    )


def return_kind() -> Column:
    """The first return-type kind that is present, else ``none``."""
    first = F.coalesce(*[F.when(F.col(kind).isNotNull(), F.lit(kind)) for kind in TYPE_KINDS])
    return F.coalesce(first, F.lit("none"))


def classify_methods(methods: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """``id, body_class, purpose, return_kind`` of methods with their return types apart."""
    if bounds is None:
        bounds = length_bounds(methods)
    return methods.select(
        "id", body_class("block", bounds).alias("body_class"), purpose().alias("purpose"),
        return_kind().alias("return_kind"))


def evaluate_by_class(pairs: DataFrame, classes: DataFrame, key: str = "example_id") -> DataFrame:
    """Metrics of each run by body class, purpose and return kind, and by body and kind together.

    ``classes`` has a row for each ``id``. A pair is scored once and counted in all groupings
    by one combinable aggregation; a column that a grouping leaves out reads ``all``. Pairs
    without a classified method count as ``none`` throughout.
    """
    by = ["body_class", "purpose", "return_kind"]
    named = pairs.join(classes.withColumnRenamed("id", key), key, "left").fillna("none", by)
    scored = subword_counts(named).select(
        "run_id", *by, "matches", "n_label", "n_prediction",
        levenshtein("label", "prediction").alias("distance"),
        ratio(F.col("matches"), F.col("n_label")).alias("recall"))
    run = F.col("run_id")
    sets = [[run], *[[run, F.col(c)] for c in by], [run, F.col("body_class"), F.col("return_kind")]]
    shown = [F.when(F.grouping(c) == 1, F.lit(ALL)).otherwise(F.col(c)).alias(f"_{c}") for c in by]
    grouped = scored.groupingSets(sets, run, *[F.col(c) for c in by]).agg(
        *shown,
        F.count("*").alias("n"),
        ratio(F.sum("matches"), F.sum("n_prediction")).alias("accuracy"),
        ratio(F.sum("matches"), F.sum("n_label")).alias("accuracy_by_label"),
        F.avg("recall").alias("rouge1"),
        F.avg("distance").alias("levenshtein"),
    )
    return grouped.select(
        "run_id", *[F.col(f"_{c}").alias(c) for c in by], "n", "accuracy", "accuracy_by_label",
        "rouge1", "levenshtein")
