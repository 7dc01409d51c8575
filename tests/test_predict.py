import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from namesmith.operators import encode, predict

MISSING = "<no_prediction>"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common = ["public", "return", "this"]
    made = []
    for i in range(400):
        words = common + rng.choices([f"word{c}" for c in "abcdefghij"], k=3)
        made.append(
            (i, rng.choice(["getA", "setB", "runC", "isD"]), rng.choice(["int", "Kind"]),
             "()" if i % 3 else "(int a)", " ".join(words))
        )
    return made


@pytest.fixture
def halves(spark, rows):
    schema = "id int, labels string, type_identifier string, formal_parameters string, full_code string"
    new = [(1000, "x", "Never", "()", "zzz"), (1001, "y", "int", "()", ""), (1002, "z", "int", "()", "1 2")]
    return (
        spark.createDataFrame(rows[:250], schema),
        spark.createDataFrame(rows[250:] + new, schema),
    )


def winner(votes):
    return min(votes.items(), key=lambda item: (-item[1], item[0]))[0]


def words_of(text):
    return {w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", text)}


def brute_force(train, test):
    by_signature, by_word = defaultdict(Counter), defaultdict(Counter)
    for _, name, kind, params, code in train:
        by_signature[kind, params][name] += 1
        for word in words_of(code):
            by_word[word][name] += 1
    majority, nearest = {}, {}
    for i, _, kind, params, code in test:
        votes = by_signature.get((kind, params))
        majority[i] = winner(votes) if votes else MISSING
        known = [(sum(by_word[w].values()), w) for w in words_of(code) if w in by_word]
        nearest[i] = winner(by_word[min(known)[1]]) if known else MISSING
    return majority, nearest


def check(halves):
    train, test = halves
    majority, nearest = brute_force([tuple(r) for r in train.collect()], [tuple(r) for r in test.collect()])
    got = predict.predict_majority(test, predict.fit_majority_names(train))
    assert {r.id: r.prediction for r in got.collect()} == majority
    got = predict.predict_nearest(test, predict.fit_nearest_names(train))
    assert {r.id: r.prediction for r in got.collect()} == nearest


def test_predictors(halves):
    check(halves)


def test_predictors_with_large_models(halves, shuffled_joins):
    check(halves)


def test_no_pairs_of_methods(halves):
    """The nearest-name model has one row per word, however often the word occurs."""
    train, _ = halves
    model = predict.fit_nearest_names(train)
    assert model.count() == model.select("word").distinct().count()


def test_batches(spark, halves):
    train, test = halves
    vocab = encode.build_vocab(train, "full_code", 100)
    coded = encode.encode(test.select("id", "full_code"), vocab, {"input_ids": "full_code"}, 16)

    def last_word():
        def run(input_ids, attention_mask):
            assert input_ids.shape == attention_mask.shape and len(input_ids) <= 7
            ends = attention_mask.sum(axis=1)
            return np.array([[row[max(int(end) - 1, 0)], 0] for row, end in zip(input_ids, ends)])

        return run

    got = predict.generate_names(coded, vocab, last_word, 16, batch_size=7).collect()
    names = {r.id: r.prediction for r in got}
    assert len(names) == test.count()
    assert names[1001] == MISSING and names[1002] == MISSING
    for row in test.where("id < 1000").collect():
        assert names[row.id] == row.full_code.split()[-1]
