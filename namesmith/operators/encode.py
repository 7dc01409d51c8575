"""Text to fixed-length id arrays and back, with a vocabulary learned on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    FIRST_WORD_ID, IGNORE_ID, MASK_ID, MASK_TOKEN, MAX_LENGTH, PAD_ID, UNK_ID, VOCAB_SIZE,
)
from ..functions.names import split_camel_case
from ..storage import stage
from .align import lookup_join, number_rows

# the hidden name, word pieces, numbers, white space, any other character: together
# they cover the text, so joined pieces give it back
PIECES = f"{MASK_TOKEN}|[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[ \t\r\n]+|[^A-Za-z0-9 \t\r\n]"


#: rows whose distinct items are looked up together
BLOCK_ROWS = 2_000


def pieces(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def build_vocab(
    texts: DataFrame, column: str, max_size: int | None = VOCAB_SIZE
) -> DataFrame:
    """``(word, word_id, n)`` of the most frequent pieces, ties in word order.

    Counting combines before the shuffle; ranking sees at most ``max_size`` rows. Without
    a ``max_size`` all pieces are ranked, in ranges.
    """
    words = texts.select(F.explode(pieces(column)).alias("word"))
    counts = words.where(F.col("word") != MASK_TOKEN).groupBy("word").agg(
        F.count("*").alias("n")
    )
    if max_size is None:
        # ranges are sampled before they are cut: counting is not done twice
        counts = stage(counts, "piece-counts")
        ranked = number_rows(counts.withColumn("_less", -F.col("n")), ["_less", "word"], "_rank")
        ids = (F.col("_rank") + FIRST_WORD_ID).cast("int").alias("word_id")
        return ranked.select("word", ids, "n")
    top = counts.orderBy(F.desc("n"), "word").limit(max_size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return top.select("word", (rank + (FIRST_WORD_ID - 1)).alias("word_id"), "n")


def pad(ids: Column, length: int) -> Column:
    """Cut or fill with padding to exactly ``length`` items."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD_ID), length)), 1, length)


def attention_mask(size: Column, length: int) -> Column:
    """1 for the ``size`` real items, 0 for padding."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= size).cast("int")
    )


def gathered(
    units: DataFrame, items: str, table: DataFrame, key: str, value: str, found: str = "found"
) -> DataFrame:
    """``units`` with a map from each of their distinct items to its value in ``table``.

    ``unit`` names a row. An item is looked up once per unit, however often it stands there:
    with ``units`` partitioned by ``unit`` and a table that Spark broadcasts nothing moves but
    the distinct items' values, and else each item crosses the network once a unit.
    """
    pieces = units.select("unit", F.explode(F.array_distinct(items)).alias(key))
    known = lookup_join(pieces, table.select(key, value), [key]).where(F.col(value).isNotNull())
    maps = known.groupBy("unit").agg(
        F.map_from_entries(F.collect_list(F.struct(key, value))).alias(found)
    )
    return units.join(maps, "unit", "left")


def _nested(lists: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in lists of the same lengths."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _coded(rows_per_block: int):
    """Blocks of rows with places in the block's list of distinct items instead of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(start, rows_per_block)
                outer = part.column("items")
                inner = outer.flatten()
                found = inner.flatten().dictionary_encode()
                n = part.num_rows
                ends = pa.array([0] + [len(found.dictionary)] * n, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * n, pa.int64()), part.column("_keys"),
                    _nested(outer, _nested(inner, found.indices)),
                    pa.ListArray.from_arrays(
                        ends, found.dictionary, mask=pa.array([i > 0 for i in range(n)])),
                ], ["block", "_keys", "codes", "words"])
                block += 1

    return run


def _replaced(rows: pa.Table, values: pa.Table) -> pa.Table:
    """The rows of one block with a value for each code."""
    ordered = values.column("value").take(pc.sort_indices(values.column("code"))).combine_chunks()
    outer = rows.column("codes").combine_chunks()
    inner = outer.flatten()
    items = _nested(outer, _nested(inner, ordered.take(inner.flatten())))
    return pa.table([rows.column("_keys"), items], ["_keys", "items"])


def replaced(
    rows: DataFrame, table: DataFrame, key: str, value: str, rows_per_block: int = BLOCK_ROWS
) -> DataFrame:
    """``_keys, items`` with each item of the lists in ``items`` replaced by its value in ``table``.

    Rows are written once, in blocks in which items are numbers of the block's distinct items.
    Each of these is looked up once a block, so what moves is a number for each item and a row
    for each distinct item of a block. An item that is not in the table becomes null.
    """
    keys, item = rows.schema["_keys"].dataType, rows.schema["items"].dataType.elementType.elementType
    written = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("_keys", keys),
        T.StructField("codes", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("words", T.ArrayType(item)),
    ])
    blocks = stage(rows.select("_keys", "items").mapInArrow(_coded(rows_per_block), written), "blocks")
    words = blocks.where("words is not null").select("block", F.posexplode("words").alias("code", key))
    values = lookup_join(words, table.select(key, value), [key]).select(
        F.col("block").alias("of"), "code", F.col(value).alias("value"))
    out = T.StructType([
        blocks.schema["_keys"],
        T.StructField("items", T.ArrayType(T.ArrayType(values.schema["value"].dataType))),
    ])
    return (
        blocks.select("block", "_keys", "codes").groupBy("block")
        .cogroup(values.groupBy("of")).applyInArrow(_replaced, out)
    )


def encode(
    df: DataFrame,
    vocab: DataFrame,
    columns: dict[str, str],
    max_length: int = MAX_LENGTH,
    keys: tuple[str, ...] = ("id",),
) -> DataFrame:
    """A row with ``keys`` and id arrays for each row; ``columns`` maps output to text.

    Adds ``attention_mask`` for the first of them. The vocabulary may have any size. Texts are
    cut to ``max_length`` pieces before they move, as numbers of their block's distinct pieces,
    each of which is looked up once a block. Keys may repeat.
    """
    cut = [F.coalesce(F.slice(pieces(F.col(text)), 1, max_length),
                      F.array().cast("array<string>")) for text in columns.values()]
    rows = df.select(F.struct(*keys).alias("_keys"), F.array(*cut).alias("items"))
    ids = vocab.where(F.col("word") != MASK_TOKEN).select("word", "word_id")
    mask = df.sparkSession.range(1).select(
        F.lit(MASK_TOKEN).alias("word"), F.lit(MASK_ID).alias("word_id"))
    coded = replaced(rows, ids.unionByName(mask), "word", "word_id")

    def known(field: int) -> Column:
        return F.transform(
            F.col("items")[field], lambda i: F.coalesce(i, F.lit(UNK_ID)).cast("int"))

    return coded.select(
        "_keys.*",
        *[pad(known(field), max_length).alias(name) for field, name in enumerate(columns)],
        attention_mask(F.size(F.col("items")[0]), max_length).alias("attention_mask"),
    )


def encode_examples(
    examples: DataFrame, vocab: DataFrame, max_length: int = MAX_LENGTH
) -> DataFrame:
    """All splits in one pass: masked code and name, as models read them."""
    columns = {"input_ids": "full_code", "labels": "labels"}
    rows = examples.select("id", "split", "full_code", "labels")
    return encode(rows, vocab, columns, max_length, ("id", "split"))


def decode(
    df: DataFrame,
    ids: str,
    vocab: DataFrame,
    output: str = "text",
    keys: tuple[str, ...] = ("id",),
) -> DataFrame:
    """A row with ``keys`` and the text of its ids for each row.

    Special ids are skipped and pieces joined, for a vocabulary of any size. Each distinct id
    of a block of arrays is looked up once. Keys may repeat.
    """
    words = F.coalesce(
        F.filter(F.col(ids), lambda i: i >= FIRST_WORD_ID), F.array().cast("array<int>"))
    rows = df.select(F.struct(*keys).alias("_keys"), F.array(words).alias("items"))
    known = replaced(rows, vocab, "word_id", "word")
    return known.select("_keys.*", F.array_join(F.col("items")[0], "").alias(output))


def replace_ignored(ids: Column | str, ignore_id: int = IGNORE_ID) -> Column:
    """Ignored label positions become padding."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(ids, lambda i: F.when(i == ignore_id, PAD_ID).otherwise(i))


def name_length_budget(df: DataFrame, column: str = "labels") -> DataFrame:
    """Mean number of subwords in a name, rounded up, plus two."""
    return df.agg(
        (F.ceil(F.avg(F.size(split_camel_case(column)))) + 2).alias("name_length_budget")
    )
