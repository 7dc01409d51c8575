import hashlib
import random
import re

from pyspark.sql import functions as F

from namesmith.llm import scaled_sketch as S

from .common import awkward_rows, docs_table, prose


def hashes(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall("[^ \t-\r]+", low)
    return {hashlib.md5(" ".join(w[i : i + n]).encode()).hexdigest()[:15]
            for i in range(max(len(w) - n + 1, 1) if w else 0)}


def sketch(text, scale=16):
    found = hashes(text)
    low = sorted(h for h in found if int(h, 16) * scale < 1 << 60)
    return low or sorted(found)[:1]


def near(a, b):
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    return len(set(a) & set(b)) / min(len(a), len(b))


def brute(rows, scale=16):
    """Rows in order of id, null ids last, equal ids by digest."""
    def node(i, t):
        return hashlib.sha256(f"{'null' if i is None else i}:{t}".encode()).hexdigest()

    rows = sorted(((i, t or "") for i, t in rows),
                  key=lambda r: (r[0] is None, -(r[0] or 0), node(*r)))
    out = []
    for at, (i, t) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, e, x = sketch(t, scale), sketch(edited, scale), sketch(following, scale)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(e),
                    near(a, e), near(a, x)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
           "near_edited", "near_next"]


def run(docs, **how):
    return sorted(map(tuple, S.edited_fingerprints(docs, **how).select(*COLUMNS).collect()), key=str)


def test_random_texts(spark):
    rng = random.Random(2)
    rows = [(i * 3 - 40, prose(rng, rng.randrange(1, 400), 50).title()) for i in range(60)]
    assert run(docs_table(spark, rows)) == brute(rows)
    assert run(docs_table(spark, rows), scale=3) == brute(rows, 3)
    assert run(docs_table(spark, rows), scale=1) == brute(rows, 1)


def test_awkward_rows(spark):
    rows = awkward_rows() + [(6, "other"), (6, None), (6, ""), (None, "no id here"), (-(2 ** 63), "least"),
                             (2 ** 63 - 1, "most of all words here, and one")]
    docs = docs_table(spark, rows, extra=("node", "sketch", "copies", "next"))
    assert run(docs) == brute(rows)
    assert run(docs_table(spark, [(5, "only a b c d e")])) == brute([(5, "only a b c d e")])
    assert run(docs.where("false")) == []


def test_many_copies_grow_in_proportion(spark):
    rows = [(1, "a copy of a text that is there very often")] * 20_000 + [(0, "b c")]
    found = S.edited_fingerprints(docs_table(spark, rows)).groupBy("doc_id", "near_next").count()
    assert {tuple(r) for r in found.collect()} == {(1, 1.0, 19_999), (1, 0.0, 1), (0, 0.0, 1)}


def test_merged_sketches_are_those_of_all_shingles(spark):
    rng = random.Random(8)
    pairs = [(prose(rng, rng.randrange(30)), prose(rng, rng.randrange(300))) for _ in range(30)]
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", S.fingerprint(S.merge_sketches(
            S.sketch(F.col("a")), S.sketch(F.col("b")))).alias("m"))
    for a, b, merged in df.collect():
        found = hashes(a) | hashes(b)
        low = sorted(h for h in found if h[0] == "0")
        assert merged == "".join(low or sorted(found)[:1])


def test_estimates_of_unequal_texts(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10 ** 6)}" for _ in range(40_000)]
    short = long[5_000:9_000]
    df = spark.createDataFrame([(" ".join(short), " ".join(long))], "a string, b string")
    a, b = S.sketch(F.col("a")), S.sketch(F.col("b"))
    contained, alike = df.select(S.containment(a, b), S.resemblance(a, b)).first()
    assert contained == 1.0 and abs(alike - 0.1) < 0.03
