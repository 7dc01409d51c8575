"""Corpus BLEU and set precision, recall and F1 of names, per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import multiset_overlap, ngrams, ratio, split_camel_case
from .metrics import for_runs, present

#: longest n-grams of BLEU
ORDER = 4


def ngram_counts(pairs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per pair: subwords of both names, and for each n the clipped matches and the n-grams.

    A prediction's n-gram counts at most as often as the label has it.
    """
    words = present(pairs).select(
        "run_id", split_camel_case("label").alias("l1"), split_camel_case("prediction").alias("p1"))
    longer = {f"{side}{n}": ngrams(f"{side}1", n) for n in range(2, order + 1) for side in "lp"}
    grams = words.select("run_id", "l1", "p1", *[c.alias(name) for name, c in longer.items()])
    return grams.select(
        "run_id", F.size("l1").alias("n_label"), F.size("p1").alias("n_prediction"),
        *[multiset_overlap(f"l{n}", f"p{n}").alias(f"matches_{n}") for n in range(1, order + 1)],
        *[F.size(f"p{n}").alias(f"total_{n}") for n in range(1, order + 1)],
    )


def corpus_bleu(
    pairs: DataFrame, order: int = ORDER, smooth: bool = False, runs: list[str] | None = None
) -> DataFrame:
    """``bleu``, ``brevity_penalty`` and the precision of each n, from counts over a whole run.

    An order of which the predictions have no n-gram is left out of the mean, so that runs of
    short names have a score. ``smooth`` adds one match and one n-gram to all orders above 1.
    """
    sums = ngram_counts(pairs, order).groupBy("run_id").agg(
        F.sum("n_label").alias("n_label"), F.sum("n_prediction").alias("n_prediction"),
        *[F.sum(f"{kind}_{n}").alias(f"{kind}_{n}")
          for n in range(1, order + 1) for kind in ("matches", "total")])
    more = {n: int(smooth and n > 1) for n in range(1, order + 1)}
    shares = sums.withColumns({
        f"precision_{n}": ratio(F.col(f"matches_{n}") + more[n], F.col(f"total_{n}") + more[n])
        for n in more})
    longer = F.col("n_prediction") >= F.col("n_label")
    penalty = F.when(F.col("n_prediction") == 0, 0.0).when(longer, 1.0).otherwise(
        F.exp(1 - F.col("n_label") / F.col("n_prediction")))
    used = [F.col(f"total_{n}") + more[n] > 0 for n in more]
    zero = [u & (F.col(f"precision_{n}") == 0) for n, u in zip(more, used)]
    logs = [F.when(u & ~z, F.ln(f"precision_{n}")).otherwise(0.0) for n, u, z in zip(more, used, zero)]
    count = sum((u.cast("int") for u in used), F.lit(0))
    mean = F.exp(sum(logs, F.lit(0.0)) / count)
    none = zero[0]
    for z in zero[1:]:
        none = none | z
    bleu = F.when(none | (count == 0), 0.0).otherwise(mean * F.col("brevity_penalty"))
    scores = shares.withColumn("brevity_penalty", penalty).select(
        "run_id", bleu.alias("bleu"), "brevity_penalty", *[f"precision_{n}" for n in more])
    return for_runs(scores, runs)


def set_scores(pairs: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of the sets of subwords: over all pairs, and as mean over pairs."""
    sets = present(pairs).select(
        "run_id", F.array_distinct(split_camel_case("label")).alias("l"),
        F.array_distinct(split_camel_case("prediction")).alias("p"))
    counts = sets.select(
        "run_id", F.size("l").alias("nl"), F.size("p").alias("np"),
        F.size(F.array_intersect("l", "p")).alias("both"))
    both, nl, np = F.sum("both"), F.sum("nl"), F.sum("np")
    scores = counts.groupBy("run_id").agg(
        ratio(both, np).alias("precision"), ratio(both, nl).alias("recall"),
        ratio(2.0 * both, nl + np).alias("f1"),
        F.avg(ratio(2.0 * F.col("both"), F.col("nl") + F.col("np"))).alias("mean_f1"))
    return for_runs(scores, runs)
