import numpy as np
from pyspark.sql import functions as F

from namesmith.llm import pruned_graph as G

ROWS = "vec_id long, embedding array<float>, label int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], ROWS).repartition(3)


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def expected(rows, every, top):
    ok = [(i, v) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            scored = {(-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), j)
                      for j, w in ok if j != i and len(w) == len(v)}
            out[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(sorted(scored)[:top])]
    return {q: v for q, v in out.items() if v}


def clusters(rng, n, dim=16):
    centres = rng.randn(20, dim)
    return (centres[rng.randint(0, 20, n)] + 0.4 * rng.randn(n, dim)).astype(np.float32)


def test_recall_over_several_shards(spark):
    rng = np.random.RandomState(0)
    # lengths differ, so the largest inner product is not the smallest angle
    x = clusters(rng, 1500) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = lists(G.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, shard_size=400))
    want = expected(rows, 20, 20)
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        for _, j, s in found:
            assert abs(s - float(x[q].astype(float) @ x[j].astype(float))) < 1e-9


def test_many_copies_ties_and_unusable_rows(spark):
    a, b, c = [1.0, 0.0, 2.0], [0.5, 1.0, 0.0], [-1.0, 0.0, 0.5]
    rows = [(i, a) for i in range(60)] + [(100 + i, b) for i in range(5)] + [(200, c)]
    rows += [(20, a), (20, a), (300, None), (320, [0.0, 0.0, 0.0]), (340, [1.0, None, 0.0]),
             (360, [float("nan"), 1.0, 1.0]), (380, [float("inf"), 1.0, 1.0]), (None, a),
             (400, [1.0, 1.0]), (401, [2.0, 1.0]), (420, [])]
    got = lists(G.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == expected(rows, 20, 20)


def test_blocks_of_queries_stream_past_each_graph(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 4)
    rng = np.random.RandomState(1)
    x = clusters(rng, 240, 6)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    # few vectors of another length: some shards have none
    rows += [(1000 + i, [float(i), 1.0]) for i in range(3)]
    got = lists(G.nearest(table(spark, rows), F.col("vec_id") % 4 == 0, shard_size=40))
    want = expected(rows, 4, 20)
    assert got.keys() == want.keys() and got[1000] == want[1000]
    # shards of 40 points are searched whole by a beam of 80
    for q in want:
        assert [j for _, j, _ in got[q]] == [j for _, j, _ in want[q]]


def test_an_id_with_several_vectors_has_one(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(20, a), (20, b), (40, [3.0, 5.0]), (1, [2.0, 1.0])]
    results = [lists(G.nearest(table(spark, x), F.col("vec_id") % 20 == 0)) for x in (rows, rows[::-1])]
    one = [expected([r for r in rows if r[1] is not x], 20, 20) for x in (a, b)]
    assert results[0] == results[1] and results[0] in one


def test_few_rows_and_empty_table(spark):
    two = [(20, [1.0, 2.0]), (1, [0.0, 1.0])]
    assert lists(G.nearest(table(spark, two), F.col("vec_id") % 20 == 0)) == {20: [(1, 1, 2.0)]}
    for rows in ([], [(20, [1.0])]):
        assert G.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).collect() == []


def test_pruning_keeps_diverse_neighbours():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]], np.float32)
    assert G.robust_prune(0, np.array([1, 2, 3, 4, 0, -1]), points).tolist() == [1, 3]
