"""Source files to compared runs.

Bodies are written once, after the Python scan; cleaning and tagging stay projections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    HOLDOUT_ROWS, MAX_LENGTH, METHODS, NULL_TOKENS, SEED, VALIDATION_ROWS,
)
from ..functions.text import null_tokens
from ..operators.align import union_all
from ..operators.clean import clean_methods
from ..operators.encode import decode, encode_examples, replace_ignored
from ..operators.extract import extract_methods
from ..operators.metrics import compare_runs, evaluate
from ..operators.predict import (
    fit_majority_names, fit_nearest_names, generate_names, predict_majority, predict_nearest,
)
from ..operators.split import tag_splits, take_first
from ..storage import stage


def build_methods(files: DataFrame) -> DataFrame:
    """``(file_path, text)`` to the method table, keyed by file and place in it.

    Later steps need a key, not a gapless number; ``number_methods`` makes one for CSV.
    """
    extracted = stage(extract_methods(files), "extracted")
    key = F.concat("file_path", F.lit("#"), F.col("method_no").cast("string"))
    return extracted.withColumn("id", key).select(*METHODS.names)


def build_examples(
    methods: DataFrame,
    n_holdout: int | float = HOLDOUT_ROWS,
    n_val: int | float = VALIDATION_ROWS,
    seed: int = SEED,
    tokens: list[str] = NULL_TOKENS,
) -> DataFrame:
    """Method table to cleaned examples tagged train, validation or test.

    Texts that the CSV form takes for missing are missing here too; pass no ``tokens``
    to keep them. Sizes that are no whole numbers are shares of the cleaned rows.
    """
    texts = [name for name in METHODS.names if name not in ("id", "modifiers")]
    cleaned = clean_methods(null_tokens(methods, texts, tokens))
    return tag_splits(cleaned, _share(cleaned, n_holdout), _share(cleaned, n_val), seed)


def score_predictors(examples: DataFrame) -> DataFrame:
    """Pairs of both fitted predictors on the test split, as runs base and tuned."""
    train = examples.where(F.col("split") == "train")
    test = examples.where(F.col("split") == "test")
    majority = stage(fit_majority_names(train), "majority")
    nearest = stage(fit_nearest_names(train), "nearest")
    keep = ("id", "labels")
    runs = union_all(
        predict_majority(test, majority, keep).withColumn("run_id", F.lit("base")),
        predict_nearest(test, nearest, keep).withColumn("run_id", F.lit("tuned")),
    )
    return runs.select(
        F.col("id").alias("example_id"), "run_id", F.col("labels").alias("label"), "prediction"
    )


def evaluate_stored(
    examples: DataFrame,
    predictions: DataFrame,
    vectors: DataFrame | None = None,
    runs: list[str] | None = None,
) -> DataFrame:
    """Metrics of predictions read back from the store, against the test split.

    Every test row counts in every run that has predictions; one without its own counts as
    missing. ``read_predictions`` gives ids the type that the flow gave them.
    """
    test = examples.where(F.col("split") == "test").select(
        F.col("id").alias("example_id"), F.col("labels").alias("label"))
    known = predictions.agg(F.collect_set("run_id")).scalar()
    wanted = test.withColumn("run_id", F.explode(known))
    pairs = wanted.join(predictions, ["example_id", "run_id"], "left").select(
        "example_id", "run_id", "label", "prediction")
    if vectors is not None:
        pairs = stage(pairs, "pairs")
    return evaluate(pairs, vectors, runs)


def _share(rows: DataFrame, n: int | float) -> int:
    return n if isinstance(n, int) else int(rows.count() * n)


def evaluate_model(
    examples: DataFrame,
    vocab: DataFrame,
    make_predict_fn: Callable,
    max_length: int = MAX_LENGTH,
    sample: int | None = None,
    vectors: DataFrame | None = None,
    run_id: str = "model",
) -> DataFrame:
    """Metrics of a batch model on the test split: encode, predict, decode both, score.

    All test rows by default; ``sample`` takes the first so many of the shuffle.
    """
    test = examples.where(F.col("split") == "test")
    if sample is not None:
        test = take_first(test, sample)
    coded = stage(encode_examples(test, vocab, max_length), "encoded")
    predictions = generate_names(coded, vocab, make_predict_fn, max_length)
    hidden = coded.select("id", replace_ignored("labels").alias("labels"))
    labels = decode(hidden, "labels", vocab, "label")
    pairs = labels.join(predictions, "id").withColumn("run_id", F.lit(run_id))
    if vectors is not None:
        pairs = stage(pairs, "pairs")
    return evaluate(pairs, vectors, [run_id])


def compare_predictors(
    files: DataFrame,
    n_holdout: int | float = HOLDOUT_ROWS,
    n_val: int | float = VALIDATION_ROWS,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Extract, clean, split, fit, predict, score and compare."""
    examples = build_examples(build_methods(files), n_holdout, n_val)
    pairs = score_predictors(examples)
    if vectors is not None:
        pairs = stage(pairs, "pairs")
    return compare_runs(evaluate(pairs, vectors), "base", "tuned")
