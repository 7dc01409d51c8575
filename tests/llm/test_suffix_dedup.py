import hashlib
import random
from collections import Counter

import pytest

from namesmith.llm import suffix_dedup as S
from namesmith.llm.lyndon_suffixes import suffix_array
from namesmith.llm.queries import QUERIES

from .common import awkward_rows, docs_table, prose


def kept_bytes(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        yield bytes(x for x, c in zip(b, covered) if not c), sum(covered), runs


def check(spark, rows, length, bucket=S.BUCKET):
    texts = [(t or "").encode() for _, t in rows]
    want = sorted(
        ((i, len(b), n, k, hashlib.sha256(kept).hexdigest())
         for (i, _), b, (kept, n, k) in zip(rows, texts, kept_bytes(texts, length))), key=str)
    df = S.repeat_digest(docs_table(spark, rows, ["uid", "spans", "_key"]), length, bucket)
    assert sorted(map(tuple, df.collect()), key=str) == want
    return want


def mixed_rows(seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(15, 60)) for _ in range(6)]
    base = prose(rng, 150)
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(30)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(40):])
        rows.append((i, " ".join(parts)))
    for i in range(25):
        words = base.split()
        words[rng.randrange(len(words))] = f"e{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, "ab" * 400), (201, "x" + "ab" * 300), (202, "Shti " * 200), (203, "a" * 500)]
    return rows


@pytest.mark.parametrize("length", [50, 120])
def test_equals_counting_every_string(spark, length):
    want = check(spark, mixed_rows(length), length)
    assert sum(n for _, _, n, _, _ in want) > 1000


def test_large_buckets_are_counted(spark):
    check(spark, mixed_rows(8), 60, bucket=2)


def test_awkward_rows(spark):
    check(spark, awkward_rows(), 40)
    assert S.repeat_digest(docs_table(spark, [])).collect() == []


def test_zero_bytes_and_cut_characters(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("\x00ab") for _ in range(90)) + "\x00" * rng.randrange(60))
            for i in range(30)]
    check(spark, rows + [(90, "é" * 40), (91, "aé" + "é" * 39)], 30)


def test_texts_without_repeats(spark):
    rng = random.Random(10)
    shared = "é" + prose(rng, 40)
    rows = [(1, prose(rng, 20) + shared), (2, shared + "è rest"), (3, None), (4, prose(rng, 50)),
            (4, "again"), (None, shared)]
    df = S.remove_repeats(docs_table(spark, rows, ["__id", "spans"]), 60)
    assert df.columns[-2:] == ["__id", "spans"]
    got = Counter((r.doc_id, r.text, r.n_chars) for r in df.collect())
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, t), (kept, _, _) in zip(rows, kept_bytes(texts, 60)):
        text = None if t is None else kept.decode(errors="ignore")
        want[i, text, None if t is None else len(text)] += 1
    assert got == want


def test_suffix_array_equals_sorting():
    rng = random.Random(11)
    for _ in range(3000):
        text = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(14))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    text = [rng.randrange(3) for _ in range(3000)] * 2
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_twenty_thousand_equal_rows(spark):
    rng = random.Random(31)
    text = prose(rng, 60, 10 ** 6)
    other = prose(rng, 30, 10 ** 6) + text[50:380]
    rows = [(1, text)] * 20_000 + [(2, other), (3, prose(rng, 50, 10 ** 6))]
    found = S.repeat_digest(docs_table(spark, rows), 200)
    counts = found.groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, counts)) == [(1, len(text), 20_000), (2, 330, 1), (3, 0, 1)]
    left = S.remove_repeats(docs_table(spark, rows), 200)
    assert left.where("doc_id = 1 and text = ''").count() == 20_000 and left.count() == 20_002


def test_query_shows_what_is_left(spark, tmp_path):
    """Planted passages of over 50 words and 400 bytes are gone from the query's texts."""
    rng = random.Random(32)
    long = ["é " + prose(rng, 100) for _ in range(4)]
    short = prose(rng, 52)
    assert all(len(p.encode()) >= 400 for p in long) and len(short.encode()) < 400 - 2
    rows = [(i, f"{prose(rng, 60, 10 ** 6)}\n{long[i % 4]}\n{prose(rng, 60, 10 ** 6)}")
            for i in range(1200)]
    clean = [(2000 + i, prose(rng, 150, 10 ** 6)) for i in range(12)]
    clean += [(3000 + i, f"{prose(rng, 60, 10 ** 6)} {short} {prose(rng, 60, 10 ** 6)}")
              for i in range(2)] + [(4000, None), (None, "no id"), (4001, "")]
    docs_table(spark, rows + clean).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(got) == len(rows + clean)
    texts = dict(rows + clean)
    cut = kept_bytes([(t or "").encode() for t in texts.values()], S.LENGTH)
    for (i, text), (kept, removed, runs) in zip(texts.items(), cut):
        assert got[i].text == (None if text is None else kept.decode(errors="ignore"))
        assert (got[i].n_removed, got[i].n_spans) == (removed, runs)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert not any(p in got[i].text for i, _ in rows for p in long)
    assert all(got[i].text == text for i, text in clean)
