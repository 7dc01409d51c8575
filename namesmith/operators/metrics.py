"""Scores over (label, prediction) pairs, per run.

A metric is one projection per pair and one aggregation that combines before its
shuffle. Only vector similarity joins anything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NO_PREDICTION
from ..functions.names import (
    char_tokens, levenshtein, multiset_overlap, ngrams, ratio, split_camel_case,
)
from ..functions.sequences import lcs_length
from ..storage import stage
from .align import lookup_join

METRIC_NAMES = ["accuracy", "accuracy_by_label", "rouge1", "levenshtein", "similarity"]


def present(pairs: DataFrame) -> DataFrame:
    """A missing label is an empty name, a missing prediction the no-prediction marker."""
    return pairs.withColumns(
        {
            "label": F.coalesce("label", F.lit("")),
            "prediction": F.coalesce("prediction", F.lit(NO_PREDICTION)),
        }
    )


def for_runs(scores: DataFrame, runs: list[str] | None) -> DataFrame:
    """A row for each of ``runs``, also for those without pairs.

    Without pairs counts and shares are 0 and there is no mean distance.
    """
    if runs is None:
        return scores
    asked = scores.sparkSession.createDataFrame([(r,) for r in runs], "run_id string")
    zeros = {c: 0 for c in scores.columns if c not in ("run_id", "levenshtein")}
    return asked.join(scores, "run_id", "left").fillna(zeros)


def subword_counts(pairs: DataFrame) -> DataFrame:
    """Add subwords of both names, their numbers and the number in common."""
    words = present(pairs).withColumns(
        {
            "label_words": split_camel_case("label"),
            "prediction_words": split_camel_case("prediction"),
        }
    )
    return words.withColumns(
        {
            "n_label": F.size("label_words"),
            "n_prediction": F.size("prediction_words"),
            "matches": multiset_overlap("label_words", "prediction_words"),
        }
    )


def subword_matches(pairs: DataFrame) -> DataFrame:
    """Per run: subwords in common, and subwords in labels and in predictions."""
    return subword_counts(pairs).groupBy("run_id").agg(
        F.sum("matches").alias("matches"),
        F.sum("n_label").alias("label_subwords"),
        F.sum("n_prediction").alias("prediction_subwords"),
    )


def _micro(total: str) -> Column:
    # no pairs at all also score 0
    return F.coalesce(ratio(F.sum("matches"), F.sum(total)), F.lit(0.0))


def _macro_recall(overlap: Column, total: Column) -> Column:
    return F.coalesce(F.avg(ratio(overlap, total)), F.lit(0.0))


def subword_accuracy(pairs: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Share of matched subwords over all pairs.

    ``accuracy`` divides by the subwords of the predictions, which is how the
    published figures were taken; ``accuracy_by_label`` divides by those of the labels.
    """
    scores = subword_counts(pairs).groupBy("run_id").agg(
        _micro("n_prediction").alias("accuracy"), _micro("n_label").alias("accuracy_by_label")
    )
    return for_runs(scores, runs)


def rouge_n_recall(pairs: DataFrame, n: int = 1, runs: list[str] | None = None) -> DataFrame:
    """Mean over pairs of the share of label n-grams found in the prediction."""
    grams = present(pairs).select(
        "run_id",
        ngrams(split_camel_case("label"), n).alias("label_grams"),
        ngrams(split_camel_case("prediction"), n).alias("prediction_grams"),
    ).select(
        "run_id",
        F.size("label_grams").alias("total"),
        multiset_overlap("label_grams", "prediction_grams").alias("overlap"),
    )
    scores = grams.groupBy("run_id").agg(
        _macro_recall(F.col("overlap"), F.col("total")).alias(f"rouge{n}")
    )
    return for_runs(scores, runs)


def mean_levenshtein(pairs: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Mean edit distance of a run; null for a run without pairs."""
    scores = present(pairs).groupBy("run_id").agg(
        F.avg(levenshtein("label", "prediction")).alias("levenshtein")
    )
    return for_runs(scores, runs)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: bits of the largest component of all vectors as a whole number. Sums of 2,000 words and
#: more fit a long, and the steps are finer than those of floats
_BITS = 52


def _whole_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(word, vec)`` with whole numbers in proportion to the components, and their size.

    Sums of whole numbers are the same in any order. Vectors with a missing or non-finite
    component take no part.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = vectors.select("word", F.col("vec").cast("array<double>").alias("vec")).where(finite)
    size, most = known.agg(
        F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    scale = 2.0 ** (_BITS - math.frexp(most)[1]) if most else 1.0
    whole = F.transform("vec", lambda x: F.round(x * F.lit(scale)).cast("long"))
    return known.select("word", whole.alias("vec")), max(size or 0, 1)


def name_vectors(names: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(name, vec)`` of distinct names: the sum of their known word vectors at length 1.

    The cosine of two sums is that of the two means. Sums are taken position by position
    where the words are, so that a name crosses the network as one vector. Names without a
    known word, or whose vectors cancel out, are left out.
    """
    whole, size = _whole_vectors(vectors)
    words = names.select("name", F.explode(split_camel_case("name")).alias("word"))
    known = lookup_join(words, whole, ["word"]).where(F.col("vec").isNotNull())
    sums = known.groupBy("name").agg(
        *[F.sum(F.get(F.col("vec"), F.lit(i))).alias(f"_{i}") for i in range(size)])
    total = F.array(*[F.col(f"_{i}").cast("double") for i in range(size)]).cast("array<double>")
    added = sums.select("name", total.alias("vec"))

    def shortened(norm: Column) -> Column:
        return F.when(norm > 0, F.transform("vec", lambda x: x / norm))

    # the norm is handed on: written inside the inner function, it is taken for every component
    norm = F.sqrt(_dot(F.col("vec"), F.col("vec")))
    units = added.select("name", F.get(F.transform(F.array(norm), shortened), F.lit(0)).alias("vec"))
    return units.where(F.col("vec").isNotNull())


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each label and prediction once, its ``copies`` in each run, and whether they are alike."""
    counted = present(pairs).groupBy("run_id", "label", "prediction").agg(
        F.count("*").alias("copies"))
    merged = counted.groupBy("label", "prediction").agg(
        F.collect_list(F.struct("run_id", "copies")).alias("runs"))
    words = subword_counts(merged)
    return stage(words.select(
        "label", "prediction", "runs", "n_label", "n_prediction", "matches",
        (F.col("label_words") == F.col("prediction_words")).alias("alike")), "distinct-pairs")


def _scored_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct pairs with their ``similarity``: vectors are made once per distinct name."""
    distinct = _distinct_pairs(pairs)
    names = distinct.where(~F.col("alike")).select(
        F.explode(F.array("label", "prediction")).alias("name")).distinct()
    known = stage(name_vectors(names, vectors), "name-vectors")
    one = known.select(F.col("name").alias("label"), F.col("vec").alias("l_vec"))
    other = known.select(F.col("name").alias("prediction"), F.col("vec").alias("p_vec"))
    found = distinct.join(one, "label", "left").join(other, "prediction", "left")
    cosine = F.coalesce(_dot(F.col("l_vec"), F.col("p_vec")), F.lit(0.0))
    return found.withColumn(
        "similarity", F.when(F.col("alike"), F.lit(1.0)).otherwise(cosine)).drop("l_vec", "p_vec")


def _by_run(scored: DataFrame, *keep: str) -> DataFrame:
    return scored.select(*keep, F.inline("runs"))


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the mean word vectors of each distinct pair, with its ``copies`` per run.

    Names of equal subwords score 1, names without any known word 0. A pair is scored once
    for all runs, which are carried along with it.
    """
    found = _by_run(_scored_pairs(pairs, vectors), "label", "prediction", "similarity")
    return found.select("run_id", "label", "prediction", "copies", "similarity")


def mean_semantic_similarity(
    pairs: DataFrame, vectors: DataFrame, runs: list[str] | None = None
) -> DataFrame:
    """Mean similarity over all pairs of a run."""
    scores = pair_similarity(pairs, vectors).groupBy("run_id").agg(
        (F.sum(F.col("similarity") * F.col("copies")) / F.sum("copies")).alias("similarity")
    )
    return for_runs(scores, runs)


def evaluate(
    pairs: DataFrame, vectors: DataFrame | None = None, runs: list[str] | None = None
) -> DataFrame:
    """All metrics per run; ``similarity`` only when word vectors are given.

    Without vectors every pair is scored where it is. With them repeated pairs are merged
    first, over all runs, and every metric is taken once per distinct pair. Runs asked for by
    name have a row even without pairs.
    """
    if vectors is None:
        merged = subword_counts(pairs).withColumn("copies", F.lit(1))
    else:
        merged = _scored_pairs(pairs, vectors)
    scored = merged.withColumns(
        {
            "distance": levenshtein("label", "prediction"),
            # single words are their own 1-grams
            "recall": ratio(F.col("matches"), F.col("n_label")),
        }
    )
    if vectors is not None:
        scored = _by_run(
            scored, "matches", "n_label", "n_prediction", "distance", "recall", "similarity")

    def total(name: str) -> Column:
        return F.sum(F.col(name) * F.col("copies"))

    def mean(name: str) -> Column:
        return total(name) / F.sum("copies")

    columns = {
        "n": F.sum("copies"),
        "accuracy": ratio(total("matches"), total("n_prediction")),
        "accuracy_by_label": ratio(total("matches"), total("n_label")),
        "rouge1": mean("recall"),
        "levenshtein": mean("distance"),
    }
    if vectors is not None:
        columns["similarity"] = mean("similarity")
    scores = scored.groupBy("run_id").agg(*[c.alias(name) for name, c in columns.items()])
    return for_runs(scores, runs)


def _f1(overlap: Column, a: Column, b: Column) -> Column:
    return ratio(2.0 * overlap, a + b)


def char_rouge(pairs: DataFrame) -> DataFrame:
    """Training-time ROUGE, which sees every character as a word: mean F1 per run.

    ``rougeLsum`` takes every character as a sentence, which makes it equal ``rouge1``.
    """
    tokens = present(pairs).select(
        "run_id",
        char_tokens("label").alias("a"),
        char_tokens("prediction").alias("b"),
    )
    grams = tokens.withColumns({"a2": ngrams("a", 2), "b2": ngrams("b", 2)})
    counted = grams.select(
        "run_id",
        F.size("a").alias("na"),
        F.size("b").alias("nb"),
        multiset_overlap("a", "b").alias("o1"),
        multiset_overlap("a2", "b2").alias("o2"),
        lcs_length("a", "b").alias("lcs"),
    )
    bigrams = [F.greatest(F.col(c) - 1, F.lit(0)) for c in ("na", "nb")]
    rouge1 = F.avg(_f1(F.col("o1"), F.col("na"), F.col("nb")))
    return counted.groupBy("run_id").agg(
        rouge1.alias("rouge1"),
        F.avg(_f1(F.col("o2"), *bigrams)).alias("rouge2"),
        F.avg(_f1(F.col("lcs"), F.col("na"), F.col("nb"))).alias("rougeL"),
        rouge1.alias("rougeLsum"),
    )


def compare_runs(metrics: DataFrame, base: str, candidate: str) -> DataFrame:
    """One row per metric: value of both runs, their difference and ratio."""
    names = [name for name in METRIC_NAMES if name in metrics.columns]
    tall = metrics.where(F.col("run_id").isin(base, candidate)).unpivot(
        "run_id", names, "metric", "value"
    )
    wide = tall.groupBy("metric").agg(
        F.max(F.when(F.col("run_id") == base, F.col("value"))).alias("base"),
        F.max(F.when(F.col("run_id") == candidate, F.col("value"))).alias("candidate"),
    )
    return wide.withColumns(
        {
            "delta": F.col("candidate") - F.col("base"),
            "ratio": F.when(F.col("base") != 0, F.col("candidate") / F.col("base")),
        }
    )


def best_run(metrics: DataFrame, by: str = "rouge1") -> DataFrame:
    """The run with the highest ``by``; of equals the first by name."""
    return top_runs(metrics, by, 1).select("run_id", by)


def top_runs(metrics: DataFrame, by: str = "rouge1", keep: int = 3) -> DataFrame:
    return metrics.orderBy(F.desc(by), "run_id").limit(keep)
