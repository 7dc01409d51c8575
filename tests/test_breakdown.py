import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from namesmith.constants import METHODS
from namesmith.functions.text import rebuild_generated_name
from namesmith.operators import breakdown, overlap
from namesmith.operators.metrics import evaluate
from namesmith.sources.tables import read_predictions, write_predictions
from namesmith.plans.flow import evaluate_stored

from .test_names import python_subwords

PAIRS = "example_id long, run_id string, label string, prediction string"


def method(i, **given):
    return dict.fromkeys(METHODS.names) | {"id": i, "modifiers": [], "void_type": "void"} | given


def test_classes(spark):
    rows = [method(0), method(1, block="{ }"), method(2, block="{\n}"), method(3, block="a\nb\nc"),
            method(4, block="\n" * 9, modifiers=["@org.junit.Test", "public"]),
            method(5, modifiers=["abstract", "@Override"]), method(6, block="x\ny", modifiers=["@Override"]),
            method(7, block="", modifiers=None, void_type=None, generic_type="List<A>"),
            method(8, block="\n", void_type=None, modifiers=["@ParameterizedTest(1)"])]
    methods = spark.createDataFrame(rows, METHODS)
    assert breakdown.length_bounds(methods, 2) == [2]
    found = {r.id: tuple(r)[1:] for r in breakdown.classify_methods(methods, [2, 5]).collect()}
    assert [found[i][0] for i in range(9)] == [
        "none", "one line", "to 2 lines", "to 5 lines", "over 5 lines", "none", "to 2 lines", "one line", "to 2 lines"]
    assert [found[i][1] for i in (0, 4, 5, 6, 7, 8)] == ["other", "test", "abstract", "override", "other", "test"]
    assert [found[i][2] for i in (0, 7, 8)] == ["void_type", "generic_type", "none"]
    assert breakdown.length_bounds(methods.where("false")) == [] == breakdown.length_bounds(methods, 1)
    assert breakdown.classify_methods(methods.where("id = 4"), []).first().body_class == "more lines"


def test_scores_of_a_class_are_those_of_its_pairs(spark):
    rng = random.Random(1)
    names = ["getName", "nameGet", "setURLFor", "run", "toString", "", "getGetItem"]
    pairs = [(i, rng.choice("ab"), rng.choice(names), rng.choice(names + [None])) for i in range(150)]
    classes = [(i, rng.choice(["x", "y"]), rng.choice(["p", "q"]), rng.choice("kl")) for i in range(140)]
    df = spark.createDataFrame(pairs, PAIRS)
    table = spark.createDataFrame(classes, "id long, body_class string, purpose string, return_kind string")
    found = {tuple(r)[:4]: tuple(r)[4:] for r in breakdown.evaluate_by_class(df, table).collect()}
    of = {c[0]: c[1:] for c in classes}
    wanted = {}
    for p in pairs:
        body, purpose, kind = of.get(p[0], ("none",) * 3)
        for key in (("all",) * 3, (body, "all", "all"), ("all", purpose, "all"), ("all", "all", kind), (body, "all", kind)):
            wanted.setdefault((p[1], *key), []).append(p)
    assert set(found) == set(wanted)
    for key in random.Random(2).sample(sorted(wanted), 6):
        (row,) = evaluate(spark.createDataFrame(wanted[key], PAIRS)).collect()
        assert found[key] == pytest.approx(tuple(row)[1:])


def plain_bleu(pairs, smooth):
    total, hit = Counter(), Counter()
    n_label = n_pred = 0
    for label, prediction in pairs:
        l, p = python_subwords(label), python_subwords(prediction)
        n_label, n_pred = n_label + len(l), n_pred + len(p)
        for n in range(1, 5):
            a = Counter(tuple(l[i:i + n]) for i in range(len(l) - n + 1))
            b = Counter(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
            total[n] += sum(b.values())
            hit[n] += sum((a & b).values())
    for n in range(2, 5):
        total[n], hit[n] = total[n] + smooth, hit[n] + smooth
    used = [n for n in range(1, 5) if total[n]]
    if not used or not n_pred or any(hit[n] == 0 for n in used):
        return 0.0
    brevity = 1.0 if n_pred >= n_label else math.exp(1 - n_label / n_pred)
    return brevity * math.exp(sum(math.log(hit[n] / total[n]) for n in used) / len(used))


@pytest.mark.parametrize("smooth", [False, True])
def test_bleu(spark, smooth):
    rng = random.Random(4)
    words = ["get", "Name", "Of", "The", "URL", "Item"]

    def name():
        return "".join(rng.choices(words, k=rng.randrange(1, 9)))

    runs = {"long": [(name(), name()) for _ in range(50)], "same": [("getNameOfItem",) * 2] * 3,
            "short": [("getNameOf", "getName")], "none": [("run", "walk")], "empty": [("run", "")],
            "brief": [("getNameOfTheItem", "getNameOfThe")] * 2}
    rows = [(0, run, a, b) for run, pairs in runs.items() for a, b in pairs]
    found = overlap.corpus_bleu(spark.createDataFrame(rows, PAIRS), smooth=smooth, runs=[*runs, "gone"])
    got = {r.run_id: r.bleu for r in found.collect()}
    assert got == pytest.approx({run: plain_bleu(p, smooth) for run, p in runs.items()} | {"gone": 0.0})


def test_set_scores(spark):
    rows = [(0, "r", "getNameName", "nameOf"), (0, "r", "run", "run"), (0, "r", "", ""), (0, "z", "", None)]
    found = {r.run_id: tuple(r)[1:] for r in overlap.set_scores(spark.createDataFrame(rows, PAIRS)).collect()}
    assert found["r"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, (0.5 + 1 + 0) / 3))
    assert found["z"][:3] == (0.0, 0.0, 0.0)


def test_rebuilt_names(spark):
    texts = {"get name get Name of": "getNameOf", "getNameName, URL2url!": "getNameUrl", "": "", "12 _": "",
             None: "", "É run": "run", "XMLParser parser": "xmlParser"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", rebuild_generated_name(F.col("t")).alias("n")).collect()} == texts


@pytest.mark.parametrize("ids", [("f#1", "f#2", "g#1"), (1, 2, 3)])
def test_stored_predictions_have_the_ids_of_the_flow(spark, tmp_path, ids):
    kind = "string" if isinstance(ids[0], str) else "long"
    examples = spark.createDataFrame([(ids[0], "getA", "test"), (ids[1], "setB", "test"), (ids[2], "x", "train")],
                                     f"id {kind}, labels string, split string")
    stored = spark.createDataFrame([(ids[0], "1", "getA"), (ids[1], "1", "setA"), (ids[0], "2", "getA")],
                                   f"example_id {kind}, run_id string, prediction string")
    write_predictions(stored, str(tmp_path / "p"))
    back = read_predictions(spark, str(tmp_path / "p"))
    assert sorted(back.select(*stored.columns).collect()) == sorted(stored.collect())
    scores = {r.run_id: (r.n, r.rouge1) for r in evaluate_stored(examples, back).collect()}
    assert scores == {"1": (2, 0.75), "2": (2, 0.5)}
