from collections import Counter

import pytest
from pyspark.sql import functions as F

from namesmith.constants import FIRST_WORD_ID, MASK_ID, UNK_ID
from namesmith.operators import encode

TEXTS = [
    "public int <extra_id_0>(int a) {\n  return a + 1;\n}",
    "getURLFor item2 __x\té 😀",
    "",
    "<extra_id_0>",
    "int int int \\ \" '",
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def test_pieces_cover_the_text(texts):
    rows = texts.select("text", encode.pieces("text").alias("p")).collect()
    assert ["".join(r.p) for r in rows] == TEXTS


def test_vocabulary_order(texts):
    rows = encode.build_vocab(texts, "text", 5).orderBy("word_id").collect()
    counts = Counter(
        w for r in texts.select(encode.pieces("text").alias("p")).collect() for w in r.p
        if w != "<extra_id_0>"
    )
    best = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:5]
    assert [(r.word, r.n) for r in rows] == best
    assert [r.word_id for r in rows] == list(range(FIRST_WORD_ID, FIRST_WORD_ID + 5))


def test_round_trip(spark, texts):
    vocab = encode.build_vocab(texts, "text", 1000)
    coded = encode.encode(texts, vocab, {"ids": "text"}, 64)
    for row in coded.collect():
        assert len(row.ids) == len(row.attention_mask) == 64
        assert [int(i != 0) for i in row.ids] == row.attention_mask
        assert UNK_ID not in row.ids
    back = {r.id: r.text for r in encode.decode(coded, "ids", vocab).collect()}
    assert back == {i: t.replace("<extra_id_0>", "") for i, t in enumerate(TEXTS)}
    assert MASK_ID in coded.where("id = 0").first().ids


@pytest.mark.parametrize("size, length", [(3, 4), (8, 64), (1000, 2), (None, 64)])
def test_large_and_small_vocabularies(spark, shuffled_joins, texts, size, length):
    vocab = encode.build_vocab(texts, "text", size)
    ids = {r.word: r.word_id for r in vocab.collect()}
    both = texts.withColumn("again", F.reverse("text"))
    split = both.select("id", encode.pieces("text").alias("a"), encode.pieces("again").alias("b"))

    def expected(pieces):
        found = [MASK_ID if p == "<extra_id_0>" else ids.get(p, UNK_ID) for p in pieces[:length]]
        return found + [0] * (length - len(found))

    want = {r.id: (expected(r.a), expected(r.b), min(len(r.a), length)) for r in split.collect()}
    coded = encode.encode(both, vocab, {"ids": "text", "more": "again"}, length)
    assert {r.id: (r.ids, r.more, sum(r.attention_mask)) for r in coded.collect()} == want


def test_all_words_are_ranked_alike(texts):
    one, two = (encode.build_vocab(texts, "text", n).collect() for n in (1000, None))
    assert sorted(one) == sorted(two)


def test_vocabulary_of_forty_thousand_words(spark):
    vocab = spark.range(40_000).select(
        F.concat(F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"),
        (F.col("id") + FIRST_WORD_ID).cast("int").alias("word_id"))
    rows = vocab.where("word_id % 5000 = 0").select(F.col("word_id").alias("id"), F.col("word").alias("text"))
    coded = encode.encode(rows, vocab, {"ids": "text"}, 2)
    assert all(r.ids == [r.id, 0] for r in coded.collect())
    back = encode.decode(coded, "ids", vocab)
    assert sorted(back.collect()) == sorted(rows.select("id", "text").collect())


def test_ignored_ids(spark):
    row = spark.createDataFrame([([5, -100, 0],)], "ids array<int>").select(encode.replace_ignored("ids"))
    assert row.first()[0] == [5, 0, 0]


def test_name_budget(spark):
    names = spark.createDataFrame([("getName",), ("run",), ("toStringValue",)], "labels string")
    assert encode.name_length_budget(names).first()[0] == 4
    names = names.unionByName(spark.createDataFrame([("aBCDe",)], "labels string"))
    assert encode.name_length_budget(names).first()[0] == 5


def test_repeated_keys_and_contents_give_a_row_each(spark, texts):
    rows = spark.createDataFrame(
        [(1, "a b"), (1, "c"), (1, "c"), (None, "c"), (2, None), (2, ""), (3, "c c c")],
        "id int, text string")
    vocab = encode.build_vocab(rows, "text", 100)
    coded = encode.encode(rows, vocab, {"ids": "text"}, 4)
    want = {w: i for w, i in vocab.select("word", "word_id").collect()}
    expected = []
    for r in rows.collect():
        found = [want[c] for c in (r.text or "")][:4]
        expected.append((r.id, found + [0] * (4 - len(found)), [1] * len(found) + [0] * (4 - len(found))))
    assert sorted(map(tuple, coded.collect()), key=str) == sorted(expected, key=str)
    back = encode.decode(coded, "ids", vocab)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(
        [(r.id, (r.text or "")[:4]) for r in rows.collect()], key=str)


def test_a_key_may_be_the_text(spark, texts):
    vocab = encode.build_vocab(texts, "text", 100)
    coded = encode.encode(texts, vocab, {"text": "text", "unit": "text"}, 3, ("text",)).columns
    assert coded == ["text", "text", "unit", "attention_mask"]
    coded = encode.encode(texts.withColumnRenamed("id", "unit"), vocab, {"made": "text"}, 3, ("unit",))
    assert sorted(r.unit for r in coded.collect()) == list(range(len(TEXTS)))


def test_unknown_and_null_ids_are_skipped(spark, texts):
    vocab = encode.build_vocab(texts, "text", 100)
    rows = spark.createDataFrame([(1, [10 ** 6, 3, 3, 0]), (2, None), (3, []), (3, [3])],
                                 "id int, ids array<int>")
    word = vocab.where("word_id = 3").first().word
    assert sorted(map(tuple, encode.decode(rows, "ids", vocab).collect())) == [
        (1, word * 2), (2, ""), (3, ""), (3, word)]


def test_a_piece_moves_once_for_a_text(spark, shuffled_joins):
    rows = spark.range(20).select("id", F.repeat(F.lit("x "), 300).alias("text"))
    vocab = encode.build_vocab(rows, "text", 10)
    split = rows.select(F.lit("u").alias("unit"), encode.pieces("text").alias("all"))
    found = encode.gathered(split.limit(1), "all", vocab, "word", "word_id").first().found
    assert len(found) == 2
    assert encode.encode(rows, vocab, {"ids": "text"}, 512).count() == 20


def test_a_piece_is_looked_up_once_for_a_block_of_texts(spark, monkeypatch):
    rows = spark.range(0, 3_000, 1, 1).select("id", F.concat(F.lit("one two "), "id").alias("text"))
    vocab = encode.build_vocab(rows, "text", None)
    looked_up, join = [], encode.lookup_join

    def spied(df, *rest, **named):
        looked_up.append(df)
        return join(df, *rest, **named)

    monkeypatch.setattr(encode, "lookup_join", spied)
    coded = encode.encode(rows, vocab, {"ids": "text"}, 512)
    assert sum(df.count() for df in looked_up) < 3_000 + 10
    want = {r.word: r.word_id for r in vocab.collect()}
    for r in coded.collect():
        assert r.ids[:4] == [want["one"], want[" "], want["two"], want[" "]]
        assert r.ids[4] == want[str(r.id)] and sum(r.attention_mask) == 5


@pytest.mark.parametrize("size", [1, 3, 100])
def test_items_are_replaced_in_blocks_of_any_size(spark, size):
    lists = [[["a", "b"], []], [["b"], ["c", "c", "a"]], [[], []], [["z"], ["b"]]] * 5
    rows = spark.createDataFrame(
        [((i % 3, None), x) for i, x in enumerate(lists)],
        "_keys struct<id:int,more:string>, items array<array<string>>").coalesce(2)
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "word string, word_id long")
    found = encode.replaced(rows, table, "word", "word_id", size).collect()
    known = {"a": 1, "b": 2}
    got = [((r._keys.id, r._keys.more), r["items"]) for r in found]
    want = [((i % 3, None), [[known.get(w) for w in part] for part in x])
            for i, x in enumerate(lists)]
    assert sorted(got, key=str) == sorted(want, key=str)
