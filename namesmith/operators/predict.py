"""Names for methods: pluggable batch models and two predictors fitted on Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PREDICT_BATCH
from ..functions.text import clean_generated_name, fill_missing_prediction
from .align import lookup_join
from .encode import decode


def final_name(text: Column, clean: Callable[[Column], Column] = clean_generated_name) -> Column:
    """Generated text to one name, or the no-prediction marker.

    ``clean`` takes the longest word; ``rebuild_generated_name`` joins all different ones.
    """
    return fill_missing_prediction(clean(text))


def predict_batches(
    encoded: DataFrame,
    make_predict_fn: Callable,
    max_length: int,
    batch_size: int = PREDICT_BATCH,
    output: str = "output_ids",
) -> DataFrame:
    """Add the ids a model generates from ``input_ids`` and ``attention_mask``.

    ``make_predict_fn`` runs once per Python worker and returns a function on two
    integer matrices of up to ``batch_size`` rows.
    """
    generate = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.IntegerType()),
        batch_size=batch_size,
        input_tensor_shapes=[[max_length], [max_length]],
    )
    return encoded.withColumn(output, generate("input_ids", "attention_mask"))


def generate_names(
    encoded: DataFrame,
    vocab: DataFrame,
    make_predict_fn: Callable,
    max_length: int,
    batch_size: int = PREDICT_BATCH,
    clean: Callable[[Column], Column] = clean_generated_name,
) -> DataFrame:
    """``(id, prediction)``: model output decoded, cleaned and filled."""
    outputs = predict_batches(
        encoded.select("id", "input_ids", "attention_mask"), make_predict_fn, max_length, batch_size
    )
    texts = decode(outputs, "output_ids", vocab)
    return texts.select("id", final_name(F.col("text"), clean).alias("prediction"))


def _winner() -> Column:
    # most votes first, then the name that comes first in order
    return F.min(F.struct((-F.col("votes")).alias("against"), F.col("labels"))).getField("labels")


def fit_majority_names(train: DataFrame) -> DataFrame:
    """Most frequent name per return type and parameter list.

    Votes are combined before each shuffle: a signature shared by a third of all rows
    reaches its reducer as one partial result per task.
    """
    signature = ["type_identifier", "formal_parameters"]
    votes = train.groupBy(*signature, "labels").agg(F.count("*").alias("votes"))
    return votes.groupBy(*signature).agg(_winner().alias("prediction"))


def predict_majority(
    test: DataFrame, model: DataFrame, keep: tuple[str, ...] = ("id",)
) -> DataFrame:
    """``keep`` and the prediction by signature; the marker where that is new."""
    signature = ["type_identifier", "formal_parameters"]
    found = lookup_join(test.select(*keep, *signature), model, signature, unique=True)
    return found.select(*keep, fill_missing_prediction(F.col("prediction")).alias("prediction"))


def code_words(text: Column | str) -> Column:
    """Distinct lower-cased word pieces of a method's text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(
        F.transform(
            F.regexp_extract_all(text, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lower
        )
    )


def fit_nearest_names(train: DataFrame) -> DataFrame:
    """Per code word: in how many methods it occurs and their most frequent name.

    Two methods are as near as the rarest word they share is rare. All neighbours of
    a method at its smallest distance are then the holders of one word, so their vote
    can be taken per word: no pair of methods is ever formed and no word is left out.
    """
    words = train.select("labels", F.explode(code_words("full_code")).alias("word"))
    votes = words.groupBy("word", "labels").agg(F.count("*").alias("votes"))
    return votes.groupBy("word").agg(
        F.sum("votes").alias("holders"), _winner().alias("prediction")
    )


def predict_nearest(
    test: DataFrame, model: DataFrame, keep: tuple[str, ...] = ("id",)
) -> DataFrame:
    """``keep``, which must identify a row, and the vote of its nearest methods."""
    words = test.select(*keep, F.explode_outer(code_words("full_code")).alias("word"))
    known = F.when(F.col("holders").isNotNull(), F.struct("holders", "word", "prediction"))
    best = lookup_join(words, model, ["word"], unique=True).groupBy(*keep).agg(F.min(known).alias("best"))
    return best.select(
        *keep, fill_missing_prediction(F.col("best.prediction")).alias("prediction")
    )
