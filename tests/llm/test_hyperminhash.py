import random
import re
from collections import Counter

import numpy as np

from namesmith.llm import hyperminhash as H
from namesmith.llm.components import components

from .common import awkward_rows, docs_table, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        yield i, frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else (
            frozenset([tuple(w)]) if w else frozenset())


def expected(rows, n, num=80, den=100):
    """All pairs, then the smallest id of each component."""
    sets = list(sets_of(rows, n))
    label = list(range(len(sets)))
    for _ in sets:
        before = list(label)
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if a and b and den * len(a & b) >= num * len(a | b):
                    label[i] = min(label[i], label[j])
        if label == before:
            break
    least = {}
    for (i, _), c in zip(sets, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return Counter((i, len(s), least.get(c)) for (i, s), c in zip(sets, label))


def check(spark, rows, n=2):
    found = H.near_duplicates(docs_table(spark, rows, ["component_id", "node"]), n).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected(rows, n)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)
    return found


def edited(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(30)]
    base, short = prose(rng, 100), prose(rng, 12)
    # near copies on both sides of the threshold, chains, short texts
    rows += [(100 + i, edited(rng, base, rng.randrange(14))) for i in range(60)]
    rows += [(200 + i, edited(rng, short, rng.randrange(3))) for i in range(25)]
    chain = base
    for i in range(10):
        chain = edited(rng, chain, 3)
        rows.append((300 + i, chain))
    rows += [(400 + i, base.upper()) for i in range(20)]
    check(spark, rows)


def test_exactly_at_the_threshold(spark):
    # 8 of 10 shingles shared: 9 words and then another ending
    a = [f"a{i}" for i in range(10)]
    check(spark, [(1, " ".join(a)), (2, " ".join(a[:9] + ["x"])), (3, " ".join(a[:8] + ["x", "y"]))])


def test_awkward_rows(spark):
    found = check(spark, awkward_rows())
    first = Counter()
    for r in found:
        first[r.component_id if r.n_shingles else (r.doc_id, "none")] += r.first_kept
    # one row of each component; null ids make components of their own where nothing links them
    assert all(v >= 1 for v in first.values())
    assert H.near_duplicates(docs_table(spark, []), 2).collect() == []


def test_keep_one_keeps_columns_and_one_row(spark):
    rows = awkward_rows()
    kept = H.keep_one(docs_table(spark, rows, ["__all", "label"]), n=2)
    assert kept.columns[-2:] == ["__all", "label"]
    texts = Counter(r.text for r in kept.collect())
    assert texts[None] == 1 and texts[""] == 1 and texts["no id here"] == 1 and texts["one"] == 1
    copies = [t for t in texts.elements() if t and t.startswith(rows[4][1][:200])]
    assert len(copies) == 1


def test_estimate_is_near_the_similarity():
    rng = np.random.RandomState(6)
    for share in (0.5, 0.8, 0.95):
        a = np.unique(rng.randint(0, 1 << 62, 20_000).astype(np.uint64) * np.uint64(4))
        cut = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.r_[a[:0], rng.permutation(a)[:cut],
                            rng.randint(0, 1 << 62, len(a) - cut).astype(np.uint64) * np.uint64(4)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found, used = H.estimate(H.registers(a), H.registers(b))
        assert used == H.REGISTERS and abs(found - true) < 0.12


def test_disjoint_sets_are_corrected_for_chance():
    rng = np.random.RandomState(7)
    found = [H.estimate(*(H.registers(np.unique(rng.randint(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(4)))
                          for _ in range(2)))[0] for _ in range(50)]
    assert np.mean(found) < 0.01


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    df = components(spark.createDataFrame(links, "a long, b long"))
    got = dict(df.collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_candidates_meet_their_own_text_only(spark):
    rng = random.Random(9)
    texts = [prose(rng, 30) for _ in range(40)]
    rows = [(None, t) for t in texts[:20]] + [(7, t) for t in texts[20:]] + [(7, texts[-1])] * 5
    docs = docs_table(spark, rows)
    nodes = H.sketch_rows(docs, 2).dropDuplicates(["_k1", "_k2"]).withColumnRenamed("_row", "node")
    found = H.texts_of(nodes, docs)
    assert found.count() == len(rows)
    assert found.select("node").distinct().count() == len(texts)
    sets = H.whole_sets(found, 2).collect()
    assert len(sets) == len({r.node for r in sets}) == len(texts)
    near = [(None, edited(rng, t, 1)) for t in texts[:5]] * 3
    check(spark, rows + near)
