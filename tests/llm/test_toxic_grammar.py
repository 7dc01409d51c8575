import itertools
import random
import zlib

from namesmith.llm import toxic_grammar as T

from .common import awkward_rows, docs_table, prose

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=1500, seed=0):
    """Clean prose, and toxic texts with insults of an invented language."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randrange(20, 120), 3000).split(), i % 8 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            word = rng.choice(["grumbel", "zakka" + rng.choice("abcdefgh") * 2, "idiot"])
            words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic), None))
    return rows, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_learns_words_and_stems(spark):
    rows, labels = corpus()
    docs = docs_table(spark, rows, ["score", "toxic"])
    learned = T.learn(docs, spark.createDataFrame(labels, LABELS))
    assert "grumbel" in learned["words"] and any(s.startswith("zakka") for s in learned["stems"])
    got = T.score_documents(docs, learned).collect()
    assert [r.held_out for r in got] == [held_out(r.doc_id) for r in got]
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in unseen) / len(unseen) >= 0.97
    kept = T.keep_clean(docs, learned)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_have_no_influence(spark):
    rows, labels = corpus(600)
    docs = docs_table(spark, rows)
    flipped = [(i, q, 1 - t if held_out(i) else t, x) for i, q, t, x in labels]
    both = [T.learn(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped)]
    assert both[0] == both[1]


def test_clauses():
    lexicon = T.Lexicon({"grumbel": 3.0}, {})
    plain, aimed, negated, reported = (
        T.clause_sums(t, lexicon)[:4] for t in (
            "what a grumbel day", "you are a grumbel", "this is not a grumbel",
            "she said he is a grumbel"))
    assert plain == [3, 0, 0, 0] and aimed == [0, 3, 0, 0]
    assert negated == [0, 0, 3, 0] and reported == [0, 0, 0, 3]
    # scopes end with the clause
    assert T.clause_sums("not so. grumbel", lexicon)[:4] == [3, 0, 0, 0]
    assert T.clause_sums("i will kill", lexicon)[0] == 2 * T.clause_sums("i kill", lexicon)[0]


def read_plainly(tags):
    """Kind and factor of each hit of a clause, from what stands before it."""
    out, doubled = [], -1
    for i, tag in enumerate(tags):
        if tag not in (T.INSULT, T.THREAT):
            continue
        before = tags[:i]
        kind = ("reported" if T.REPORT in before else "negated" if T.NEGATION in before[-3:]
                else "aimed" if T.TARGET in before else "plain")
        twice = tag == T.THREAT and T.INTENT in before[doubled + 1:]
        doubled = i if twice else doubled
        out.append((i, kind, 2.0 if twice else 1.0))
    return out


def test_composed_machine_on_every_short_clause():
    for length in range(7):
        for tags in itertools.product(range(7), repeat=length):
            state, found = 0, []
            for i, tag in enumerate(tags):
                state, kind, factor = T.GRAMMAR[state, tag]
                if kind is not None:
                    found.append((i, T.KINDS[kind], factor))
            assert found == read_plainly(tags)


def test_awkward_rows(spark):
    rows = awkward_rows()
    docs = docs_table(spark, rows)
    none = T.learn(docs, spark.createDataFrame([], LABELS))
    got = T.score_documents(docs, none).collect()
    assert len(got) == len(rows) and all(r.predicted == 0 for r in got)
    assert all(r.held_out == (r.doc_id is not None and held_out(r.doc_id)) for r in got)
    labels = [(1, 1, 1, None), (5, 1, None, None), (None, 0, 1, None), (6, 1, 0, None), (6, 1, 1, None)]
    assert T.score_documents(docs, T.learn(docs, spark.createDataFrame(labels, LABELS))).count() == len(rows)
    empty = docs_table(spark, [])
    assert T.score_documents(empty, T.learn(empty, spark.createDataFrame(labels, LABELS))).collect() == []
