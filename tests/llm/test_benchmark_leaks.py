import random

from namesmith.llm import benchmark_leaks as L

from .common import awkward_rows, docs_table, prose

ITEMS = "item_id long, text string, doc_id long"


def items_table(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS).repartition(2)


def expected(rows, items):
    """Every window of every document against every item, word for word."""
    out = set()
    for d, text in rows:
        words = L.words_of(text)
        for i, item in items:
            own = L.words_of(item)
            stride = L.LEAST_STRIDE
            while stride < len(own):
                stride *= 2
            for s in range(0, max(1, len(words) - stride), stride):
                part = words[s : s + 2 * stride]
                joined = "\x00" + "\x00".join(part) + "\x00"

                def share(own):
                    n = min(L.SHINGLE, len(own))
                    grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
                    return sum("\x00" + "\x00".join(g) + "\x00" in joined
                               for g in grams) / len(grams) if grams else 1

                if own and share(own) >= (L.OVERLAP if len(own) >= L.SHINGLE else 1) and min(
                        map(share, L.question_and_answer(item))) >= L.PART_OVERLAP:
                    out.add((d, i))
    return sorted(out, key=str)


def setting(seed):
    rng = random.Random(seed)
    items = [(i, f"{prose(rng, rng.randrange(8, 40), 900)}. {prose(rng, rng.randrange(3, 9), 900)}.")
             for i in range(40)]
    rows = [(i, prose(rng, rng.randrange(300), 900)) for i in range(60)]
    for i in range(60, 160):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, f"{prose(rng, rng.randrange(150), 900)} {' '.join(words).upper()} "
                        f"{prose(rng, rng.randrange(150), 900)}"))
    return rows, items


def found(spark, rows, items):
    df = L.find_leaks(docs_table(spark, rows, ["item_id", "score"]), items_table(spark, items))
    return df.collect()


def test_equals_every_item_in_every_window(spark):
    rows, items = setting(1)
    got = found(spark, rows, items)
    want = expected(rows, items)
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == want and len(want) > 40
    assert all(L.SCORE <= r.score <= 1 + 1e-9 and r.overlap >= L.OVERLAP for r in got)


def test_search_equals_scoring_all_items():
    _, items = setting(2)
    words = [set(L.words_of(t)) for _, t in items]
    frequency = {w: sum(w in s for s in words) for s in words for w in s}
    index = L.Index(items, frequency, len(items), 30)
    rng = random.Random(3)
    for _ in range(300):
        own = set(rng.sample(range(len(index.lists)), rng.randrange(1, 200)))
        own |= set(next(iter(rng.choice(index.grams)))) if rng.random() < 0.5 else set()
        scores = [0.0] * len(items)
        for t in own:
            for i, x in zip(*index.lists[t]):
                scores[i] += x
        hits = dict(index.search(list(own)))
        assert set(hits) == {i for i, s in enumerate(scores) if s >= L.SCORE - 1e-9}
        assert all(abs(scores[i] - s) < 1e-9 for i, s in hits.items())


def test_several_indexes_agree_with_one(spark, monkeypatch):
    rows, items = setting(4)
    one = {(r.doc_id, r.item_id, round(r.score, 9)) for r in found(spark, rows, items)}
    monkeypatch.setattr(L, "INDEX_CHARACTERS", 1500)
    assert len(L.build_indexes(items_table(spark, items))) > 3
    several = {(r.doc_id, r.item_id, round(r.score, 9)) for r in found(spark, rows, items)}
    assert several == one


def test_awkward_rows(spark):
    rows = awkward_rows()
    items = [(1, None), (2, ""), (3, "two words"), (None, "no id"), (4, rows[4][1]), (4, rows[4][1]),
             (5, "..."), (6, "one")]
    usable = [(i, t) for i, t in items if i is not None]
    got = sorted(((r.doc_id, r.item_id) for r in found(spark, rows, items)), key=str)
    assert set(got) == set(expected(rows, usable))
    assert found(spark, [], items) == [] and found(spark, rows, []) == []


def test_clean_rows_stay_whole(spark):
    rows, items = setting(5)
    dirty = {d for d, _ in expected(rows, items)}
    docs = docs_table(spark, rows + [(None, None)], ["score"])
    kept = L.without_leaks(docs, items_table(spark, items))
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted(
        (r for r in docs.collect() if r.doc_id not in dirty), key=str)


def test_a_long_item_changes_no_other_row(spark):
    rows, items = setting(6)
    rng = random.Random(8)
    long = prose(rng, 50_000, 900)
    rows.append((900, f"{prose(rng, 90, 900)} {long} {prose(rng, 90, 900)}"))
    rows.append((901, " ".join(long.split()[:30_000])))
    before = {tuple(r) for r in found(spark, rows, items)}
    after = {tuple(r) for r in found(spark, rows, [*items, (77, long)])}
    assert after - before == {r for r in after if r[:2] == (900, 77)} and len(after) == len(before) + 1
    assert before <= after


def test_classes_of_length(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, f"{prose(rng, n, 900)}. {prose(rng, 5, 900)}.")
             for i, n in enumerate([10, 40, 58, 60, 120, 130, 250, 600])]
    rows = [(i, f"{prose(rng, rng.randrange(400), 900)} {rng.choice(items)[1]} "
                f"{prose(rng, rng.randrange(400), 900)}") for i in range(40)]
    want = expected(rows, items)
    got = found(spark, rows, items)
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == want and len(want) >= 40
    assert len(L.build_indexes(items_table(spark, items))) == 1
    monkeypatch.setattr(L, "INDEX_CHARACTERS", 3000)
    assert len(L.build_indexes(items_table(spark, items))) > 1
    assert set(map(tuple, found(spark, rows, items))) == set(map(tuple, got))
    clean = L.without_leaks(docs_table(spark, [*rows, (99, "clean")]), items_table(spark, items))
    assert [r.doc_id for r in clean.collect()] == [99]
