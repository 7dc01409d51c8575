import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from namesmith.constants import PAIRS, VECTORS
from namesmith.operators import metrics
from namesmith.sources.tables import report

from .test_names import python_subwords, table_lcs

NAMES = ["getName", "nameGet", "setURLFor", "run", "toString", "getGetItem", "isA", "XMLParser",
         "<no_prediction>", "", "item1Foo", "parse", "getUnknownThing", "run_fast"]


@pytest.fixture(scope="module")
def vectors_of():
    rng = random.Random(5)
    words = sorted({w for n in NAMES for w in python_subwords(n)} - {"unknown", "thing", "parse"})
    return {w: [rng.uniform(-1, 1) for _ in range(8)] for w in words}


def sample():
    rng = random.Random(9)
    rows = [(i, rng.choice(["one", "two"]), rng.choice(NAMES), rng.choice(NAMES)) for i in range(300)]
    # a third of all pairs is one and the same
    return rows + [(1000 + i, "one", "getName", "<no_prediction>") for i in range(150)]


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return dot / norms if norms else 0.0


def brute_force(rows, vectors):
    runs = {}
    for run in {r[1] for r in rows}:
        pairs = [(label, pred) for _, r, label, pred in rows if r == run]
        split = [(python_subwords(a), python_subwords(b)) for a, b in pairs]
        common = [sum((Counter(a) & Counter(b)).values()) for a, b in split]
        bigrams = [
            (list(zip(a, a[1:])), list(zip(b, b[1:]))) for a, b in split
        ]
        similar = []
        for a, b in split:
            means = []
            for side in (a, b):
                known = [vectors.get(w, [0.0] * 8) for w in side] or [[0.0] * 8]
                means.append([sum(col) / len(known) for col in zip(*known)])
            similar.append(1.0 if a == b else cosine(*means))
        n = len(pairs)
        runs[run] = {
            "n": n,
            "accuracy": sum(common) / sum(len(b) for _, b in split),
            "accuracy_by_label": sum(common) / sum(len(a) for a, _ in split),
            "rouge1": sum(c / len(a) if a else 0 for c, (a, _) in zip(common, split)) / n,
            "rouge2": sum(
                sum((Counter(a) & Counter(b)).values()) / len(a) if a else 0 for a, b in bigrams
            ) / n,
            "levenshtein": sum(distance(a, b) for a, b in pairs) / n,
            "similarity": sum(similar) / n,
        }
    return runs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(sample(), PAIRS)


@pytest.fixture
def vectors(spark, vectors_of):
    return spark.createDataFrame(list(vectors_of.items()), VECTORS)


def compare(df, vectors_of, names):
    expected = brute_force(sample(), vectors_of)
    rows = {r.run_id: r.asDict() for r in df.collect()}
    assert rows.keys() == expected.keys()
    for run, row in rows.items():
        for name in names:
            assert row[name] == pytest.approx(expected[run][name], abs=1e-6), (run, name)


def test_evaluate(pairs, vectors, vectors_of):
    names = ["n", "accuracy", "accuracy_by_label", "rouge1", "levenshtein"]
    compare(metrics.evaluate(pairs), vectors_of, names)
    compare(metrics.evaluate(pairs, vectors), vectors_of, [*names, "similarity"])


def test_evaluate_with_large_vectors(pairs, vectors, vectors_of, shuffled_joins):
    compare(metrics.evaluate(pairs, vectors), vectors_of, ["n", "rouge1", "similarity"])


def test_single_metrics(pairs, vectors, vectors_of):
    compare(metrics.subword_accuracy(pairs), vectors_of, ["accuracy", "accuracy_by_label"])
    compare(metrics.rouge_n_recall(pairs, 1), vectors_of, ["rouge1"])
    compare(metrics.rouge_n_recall(pairs, 2), vectors_of, ["rouge2"])
    compare(metrics.mean_levenshtein(pairs), vectors_of, ["levenshtein"])
    compare(metrics.mean_semantic_similarity(pairs, vectors), vectors_of, ["similarity"])


def one_pair(spark, label, prediction):
    return metrics.evaluate(spark.createDataFrame([(0, "r", label, prediction)], PAIRS)).first()


def test_word_order_does_not_matter(spark):
    row = one_pair(spark, "methodName", "nameMethod")
    assert row.accuracy == row.accuracy_by_label == row.rouge1 == 1.0


def test_empty_names(spark):
    assert one_pair(spark, "", "a").rouge1 == 0.0
    assert one_pair(spark, "a", "").accuracy == 0.0
    assert one_pair(spark, "", "").accuracy == 0.0


def test_which_side_divides(spark):
    row = one_pair(spark, "getName", "getNameOfTheItem")
    assert (row.accuracy, row.accuracy_by_label) == (0.4, 1.0)


def test_character_rouge(spark):
    rng = random.Random(11)
    rows = [(i, "r", "".join(rng.choices("abC1_", k=rng.randrange(9))),
             "".join(rng.choices("aBc1_", k=rng.randrange(9)))) for i in range(200)]
    scores = {"rouge1": [], "rouge2": [], "rougeL": []}

    def f1(common, n, m):
        return 2 * common / (n + m) if n + m else 0.0

    for _, _, label, pred in rows:
        a, b = ([c for c in s.lower() if c != "_"] for s in (label, pred))
        overlap = lambda x, y: sum((Counter(x) & Counter(y)).values())
        a2, b2 = list(zip(a, a[1:])), list(zip(b, b[1:]))
        scores["rouge1"].append(f1(overlap(a, b), len(a), len(b)))
        scores["rouge2"].append(f1(overlap(a2, b2), len(a2), len(b2)))
        scores["rougeL"].append(f1(table_lcs(a, b), len(a), len(b)))
    row = metrics.char_rouge(spark.createDataFrame(rows, PAIRS)).first()
    for name, values in scores.items():
        assert row[name] == pytest.approx(sum(values) / len(values)), name
    assert row.rougeLsum == row.rouge1


def test_runs(spark):
    table = spark.createDataFrame(
        [("base", 10, 0.51, 0.5, 0.47, 10.1075, 0.68), ("tuned", 10, 0.70, 0.6, 0.67, 6.18975, 0.82),
         ("other", 10, 0.1, 0.1, 0.67, 1.0, 0.0)],
        "run_id string, n long, accuracy double, accuracy_by_label double, rouge1 double,"
        " levenshtein double, similarity double",
    )
    rows = {r.metric: r for r in metrics.compare_runs(table, "base", "tuned").collect()}
    assert rows["accuracy"].delta == pytest.approx(0.19)
    assert rows["levenshtein"].ratio == pytest.approx(6.18975 / 10.1075)
    assert metrics.best_run(table).first().run_id == "other"
    assert [r.run_id for r in metrics.top_runs(table, "accuracy", 2).collect()] == ["tuned", "base"]
    lines = report(table.where("run_id = 'base'")).orderBy("line_no").collect()
    assert [r.line for r in lines] == [
        "Accuracy: 0.51", "ROUGE: 0.47", "Levenshtein Distance: 10.1075", "Semantic Similarity: 0.68",
    ]


def test_scoring_shuffles_only_partial_results(pairs):
    plan = metrics.evaluate(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_similarity_of_unknown_and_equal_names(spark, vectors):
    rows = [(0, "r", "unknownThing", "unknownThing"), (1, "r", "unknownThing", "run"),
            (2, "r", "Run", "run"), (3, "r", "", "")]
    got = metrics.pair_similarity(spark.createDataFrame(rows, PAIRS), vectors).collect()
    assert {(r.label, r.prediction): r.similarity for r in got} == {
        ("unknownThing", "unknownThing"): 1.0, ("unknownThing", "run"): 0.0,
        ("Run", "run"): 1.0, ("", ""): 1.0,
    }


def test_missing_names_and_runs_without_pairs(spark):
    rows = [("r", "getX", "getX"), ("r", "getX", None), ("r", None, "a"), ("q", "getX", "setX")]
    pairs = spark.createDataFrame(rows, "run_id string, label string, prediction string")
    runs = ["q", "r", "s"]
    whole = {r.run_id: r for r in metrics.evaluate(pairs, runs=runs).collect()}
    single = metrics.subword_accuracy(pairs, runs).join(
        metrics.rouge_n_recall(pairs, 1, runs), "run_id"
    ).join(metrics.mean_levenshtein(pairs, runs), "run_id")
    for r in single.collect():
        for name in ("accuracy", "accuracy_by_label", "rouge1", "levenshtein"):
            assert getattr(whole[r.run_id], name) == pytest.approx(r[name])
    assert [whole[r].n for r in runs] == [1, 3, 0]
    assert whole["s"].accuracy == whole["s"].rouge1 == 0 and whole["s"].levenshtein is None
    # a missing prediction is a wrong one, not an absent one
    assert whole["r"].accuracy < 1 and whole["r"].levenshtein > 0
    none = pairs.where("false")
    assert [(r.run_id, r.n, r.accuracy) for r in metrics.evaluate(none, runs=["s"]).collect()] == [("s", 0, 0)]


def test_vector_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(3)
    words = [chr(97 + i) * 3 for i in range(20)]
    vectors = [(w, [rng.uniform(-9, 9) for _ in range(7)]) for w in words]
    vectors += [("bad", [float("nan")] * 7), ("inf", [float("inf")] * 7), ("gap", [None] * 7), ("zero", [0.0] * 7)]
    table = spark.createDataFrame(vectors, "word string, vec array<double>")
    names = [("".join(w.title() for w in rng.choices(words + ["bad", "gap", "none"], k=6)),) for _ in range(40)]
    names = spark.createDataFrame([*set(names), ("bad",), ("zero",), ("",)], "name string")
    found = {r.name: r.vec for r in metrics.name_vectors(names.repartition(5), table).collect()}
    again = {r.name: r.vec for r in metrics.name_vectors(names.coalesce(1), table.repartition(7)).collect()}
    assert found == again and not {"bad", "zero", ""} & set(found)
    of = dict(vectors)
    for name, vec in found.items():
        parts = [of[w.lower()] for w in re.findall("[A-Z][a-z]+", name) if w.lower() in words]
        total = [math.fsum(xs) for xs in zip(*parts)]
        norm = math.sqrt(math.fsum(x * x for x in total))
        assert vec == pytest.approx([x / norm for x in total], abs=1e-12)
    assert metrics.name_vectors(names, table.where("false")).collect() == []
