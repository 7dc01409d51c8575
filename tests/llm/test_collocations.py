import random
import re
from collections import Counter

import numpy as np

from namesmith.llm import collocations as C

from .common import awkward_rows, docs_table


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, threshold, keep):
    """``(lang, text)`` rows to the result, by counting every phrase."""
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text or "")):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i : i + m])] += 1
    frequent = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= threshold}
    covered = set()
    for (lang, p), n in frequent.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                short = lang, p[i : i + m]
                if 100 * n >= 80 * counts[short]:
                    covered.add(short)
    out = {}
    for (lang, p), a in frequent.items():
        if (lang, p) in covered:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k,
             counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, words[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:keep], 1))


def run(spark, rows, threshold=3, keep=2000, segment=1 << 20, extra=False):
    ddl = "lang string, text string" + (", block long, n string, keys string" if extra else "")
    data = [(*r, 1, "x", "y") if extra else r for r in rows]
    found = C.collocations(spark.createDataFrame(data, ddl).repartition(3), threshold, 4, keep, segment)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


def texts(seed, n=60):
    rng = random.Random(seed)
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " !"]
    return [(rng.choice(["en", "de", None]),
             "".join(f"{rng.choice('abcdEÉ')}{rng.choice(['', 'x'])}{rng.choice(ends)}" for _ in range(40)))
            for _ in range(n)]


def test_random_texts(spark):
    rows = texts(1)
    want = brute(rows, 3, 2000)
    assert len(want) > 50
    assert run(spark, rows, extra=True) == want
    assert run(spark, rows, keep=7) == brute(rows, 3, 7)


def test_texts_cut_into_segments(spark):
    rows = texts(2, 20) + [("en", "a b c d e " * 300), ("en", "f" * 500 + " a b c " + "g" * 300)]
    want = brute(rows, 3, 2000)
    for segment in (1, 5, 64):
        assert run(spark, rows, segment=segment) == want


def test_awkward_rows(spark):
    docs = docs_table(spark, awkward_rows(), extra=("block", "phrase", "p"))
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, C.collocations(docs, 3).collect())) == brute(rows, 3, 2000)
    assert C.collocations(docs.where("false"), 3).collect() == []
    assert C.collocations(docs_table(spark, [(1, None), (2, "")]), 1).collect() == []


def test_many_copies_and_full_buffers(spark, monkeypatch):
    monkeypatch.setattr(C, "HASH_BYTES", 300)
    monkeypatch.setattr(C, "COUNT_BYTES", 400)
    monkeypatch.setattr(C, "SUMMARY_PHRASES", 500)
    monkeypatch.setattr(C, "BLOCK_ROWS", 7)
    monkeypatch.setattr(C, "PARTITION_BYTES", 500)
    rows = texts(3, 15) + [("en", "one line, that all have. Yes")] * 200
    assert run(spark, rows, 5) == brute(rows, 5, 2000)


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    long = b"x" * 70
    words = [b"a", b"a\x00", b"abcdefgh", b"abcdefgh\x00", b"abcdefghi", long, long + b"y", b"a", long]
    texts = [("en", b" ".join(words), 0), ("de", b"a b\nabcdefghi", 1)]

    def ids():
        chunk = C._Chunk(texts)
        found = chunk.word_ids().tolist()
        by_word = {}
        for i, x in enumerate(found):
            assert by_word.setdefault(chunk.bytes_at(i), x) == x
        assert len(set(found)) == len(by_word) == 8
        return chunk

    chunk = ids()
    assert chunk.old.tolist() == [False] * 9 + [True, False, False]
    assert chunk.piece.tolist() == [0] * 9 + [1, 1, 2]
    # all hashes equal
    monkeypatch.setattr(C._Chunk, "word_codes", lambda self: np.zeros(len(self.sizes), np.uint64))
    ids()


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(5)
    for threshold in (5, 30):
        keys = (rng.zipf(1.3, 20_000) % 50_000).astype(np.uint32)
        rng.shuffle(keys)
        summary = C.MisraGries(len(keys) // threshold + 1)
        for part in np.array_split(keys, 37):
            summary.add(*np.unique(part, return_counts=True))
        kept = set(summary.frequent(threshold).tolist())
        assert summary.missed * (summary.capacity + 1) <= len(keys)
        assert len(summary.keys) <= summary.capacity
        assert {k for k, n in Counter(keys.tolist()).items() if n >= threshold} <= kept


def test_long_phrases_are_told_apart():
    # numbers too large for one product of 64 bits
    columns = [np.array([1, 2, 1, 1 << 30]), np.array([5, 5, 5, 6]), np.array([7, 7, 7, 7]),
               np.array([9, 9, 9, 9])]
    code = C._exact(columns, (1 << 30) + 1)
    assert code[0] == code[2] and len(set(code.tolist())) == 3
