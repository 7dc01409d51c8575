"""Near-duplicate documents by HyperMinHash.

A document's shingle hashes are dealt into 256 buckets by their first byte. Of each bucket
only the least hash counts, and of that only its number of leading zeros and the ten bits
after the first one: a register of 16 bits. Runs of six registers are band keys. Documents
that share a band key are candidates; their similarity is estimated from the registers,
less the matches that shortened registers make by chance, and what may reach the threshold
is confirmed on the whole shingle sets.

Equal sets are merged first. In a bucket of a band one pivot is compared with the others, for
a few rounds, which settles large groups of near copies. Of the pairs that are left only those
in different components are formed, and of them those that sizes and bitmaps of the sets do
not rule out: no link is lost that could join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .components import components

REGISTERS, MANTISSA_BITS = 256, 10
BANDS, BAND_REGISTERS = 42, 6
#: chance that two registers of disjoint large sets agree, times 2 ** MANTISSA_BITS
COLLISIONS = 0.169919
#: standard errors below the threshold at which an estimate still goes to verification
DOUBT = 8
#: rounds in which a bucket's pivot meets the others
PIVOT_ROUNDS = 2
#: 64-bit words of a set's bitmap
BITMAP_WORDS = 32
#: sets of a bucket that a task holds at once; larger buckets are dealt to several groups
GROUP = 20_000
#: words whose hashes a task keeps
KNOWN_WORDS = 1 << 18

_BATCH = 2_000


class WordHashes(dict):
    """Hash of each word; forgets all when full, which changes no value."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words has
    one shingle, the whole; one without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n_parts = min(n, len(words))
    parts = len(words) - n_parts + 1
    folded = np.full(parts, n_parts, np.uint64)
    for i in range(n_parts):
        folded = folded * np.uint64(0x9E3779B97F4A7C15) + h[i : i + parts]
        folded ^= folded >> np.uint64(29)
    return np.unique(_mixed(folded))


def registers(grams: np.ndarray) -> np.ndarray:
    """The sketch: per bucket 0 if empty, else 1 + leading zeros and mantissa bits."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(grams):
        return out
    bucket = (grams >> np.uint64(56)).astype(np.int64)
    # hashes are sorted, so a bucket's first is its least
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (grams[first] << np.uint64(8)) >> np.uint64(12)  # 52 bits, exact as double
    zeros = 52 - np.frexp(rest.astype(np.float64))[1]
    tail = (rest << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 52) - 1)
    mantissa = (tail >> np.uint64(52 - MANTISSA_BITS)).astype(np.int64)
    out[bucket[first]] = (zeros << MANTISSA_BITS) + mantissa + 1
    return out


def bitmap(grams: np.ndarray) -> bytes:
    """A bit for each shingle, by its hash."""
    bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
    bits[(grams % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def lenders() -> np.ndarray:
    """For each register an order in which it borrows from the others; fixed by a seed."""
    return np.array([np.random.RandomState(i).permutation(REGISTERS) for i in range(REGISTERS)])


def filled(sketch: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty, each empty register filled with a borrowed one.

    Two sets then agree in a register with the chance of their similarity however small they
    are; runs of empty registers would make keys of one or two common shingles.
    """
    empty = np.flatnonzero(sketch == 0)
    out = sketch.copy()
    for width in (16, REGISTERS):
        if not len(empty):
            break
        lent = sketch[orders[empty, :width]]
        first = (lent > 0).argmax(axis=1)
        value = lent[np.arange(len(empty)), first]
        out[empty] = value
        empty = empty[value == 0]
    return out


def band_keys(sketch: np.ndarray, orders: np.ndarray) -> list[int]:
    """A key for each run of registers."""
    rows = filled(sketch, orders)[: BANDS * BAND_REGISTERS].reshape(BANDS, BAND_REGISTERS)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), seed=i)) for i, row in enumerate(rows)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Jaccard estimate corrected for chance matches, and the buckets it rests on."""
    used = int(((a > 0) | (b > 0)).sum())
    both = (a > 0) & (b > 0)
    by_chance = int(both.sum()) * COLLISIONS / (1 << MANTISSA_BITS)
    matches = int(((a == b) & both).sum())
    return max(0.0, matches - by_chance) / max(1, used), used


def linked(a: bytes, b: bytes, sketch_a: bytes, sketch_b: bytes, num: int, den: int) -> bool:
    """Whether ``den * shared >= num * united``, by estimate first."""
    likeness, used = estimate(np.frombuffer(sketch_a, np.uint16), np.frombuffer(sketch_b, np.uint16))
    t = num / den
    if likeness < t - DOUBT * (t * (1 - t) / max(1, used)) ** 0.5:
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(both) - shared)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema)


def _sketcher(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()),
                        ("n_shingles", pa.int64()), ("_k1", pa.int64()), ("_k2", pa.int64()),
                        ("_sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in range(0, batch.num_rows, _BATCH):
                cut, rows = batch.slice(part, _BATCH), []
                for doc_id, key, text in zip(*(c.to_pylist() for c in cut.columns)):
                    grams = shingle_hashes(text, n, hashes)
                    k = xxhash.xxh3_128_intdigest(grams.tobytes())
                    rows.append((doc_id, key, len(grams), _signed(k >> 64),
                                 _signed(k & ((1 << 64) - 1)), registers(grams).tobytes()))
                yield _arrow(rows, schema)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])
    orders = lenders()
    for batch in batches:
        for part in range(0, batch.num_rows, _BATCH):
            cut = batch.slice(part, _BATCH)
            keys, nodes = [], []
            for node, sketch in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist()):
                own = band_keys(np.frombuffer(sketch, np.uint16), orders)
                keys += own
                nodes += [node] * len(own)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], schema)


def _set_maker(n: int):
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("grams", pa.binary()),
                        ("sketch", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), None
        for batch in batches:
            for part in range(0, batch.num_rows, _BATCH):
                rows = []
                for r in batch.slice(part, _BATCH).to_pylist():
                    # a joined row's copies follow each other
                    if r["node"] == last:
                        continue
                    grams = shingle_hashes(r["text"], n, hashes)
                    k = xxhash.xxh3_128_intdigest(grams.tobytes())
                    # rows that share an id and the text's hash may hold another text
                    if (_signed(k >> 64), _signed(k & ((1 << 64) - 1))) == (r["_k1"], r["_k2"]):
                        rows.append((r["node"], len(grams), grams.tobytes(),
                                     registers(grams).tobytes(), bitmap(grams)))
                        last = r["node"]
                yield _arrow(rows, schema)

    return run


def _possible(num: int, den: int):
    """Pairs of different components that sizes and bitmaps allow to be linked.

    A bit that only one of two sets has stands for at least one shingle that the other has
    not, which bounds what they share.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(r: dict, nodes, labels, sizes, bits, keys) -> list[tuple[int, int]]:
        mine = np.frombuffer(r["bits"], np.uint64)
        shared = np.minimum(
            r["size"] - np.bitwise_count(mine & ~bits).sum(axis=1, dtype=np.int64),
            sizes - np.bitwise_count(bits & ~mine).sum(axis=1, dtype=np.int64))
        fits = (labels != r["label"]) & (shared * (den + num) >= (sizes + r["size"]) * num)
        found = []
        for i in np.flatnonzero(fits).tolist():
            common = set(r["keys"]).intersection(keys[i])
            if min(common) == r["key"]:
                found.append((min(r["node"], int(nodes[i])), max(r["node"], int(nodes[i]))))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, arrays, out = None, [], None, []
        for batch in batches:
            for part in range(0, batch.num_rows, _BATCH):
                for r in batch.slice(part, _BATCH).to_pylist():
                    if (r["key"], r["group"]) != group:
                        group, held, arrays = (r["key"], r["group"]), [], None
                    if not r["outside"]:
                        held.append((r["node"], r["label"], r["size"], r["bits"], r["keys"]))
                        continue
                    if arrays is None:
                        nodes, labels, sizes, bits, keys = zip(*held) if held else [()] * 5
                        arrays = (
                            *(np.array(x, np.int64) for x in (nodes, labels, sizes)),
                            np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITMAP_WORDS), keys)
                    out += meet(r, *arrays)
                yield _arrow(out, schema)
                out = []

    return run


def _verifier(num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            yield _arrow([(a, b) for a, b, x, y, s, t in zip(*cols)
                          if linked(x, y, s, t, num, den)], schema)

    return run


def sketch_rows(docs: DataFrame, n: int) -> DataFrame:
    """A narrow row for each document, written once so that ``_row`` is fixed."""
    made = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text",
    ).mapInArrow(_sketcher(n), "doc_id long, text_key long, n_shingles long, _k1 long, _k2 long, "
                               "_sketch binary")
    return stage(made.withColumn("_row", F.monotonically_increasing_id()), "sketches")


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text, _k1, _k2``: the rows of the nodes' ids and texts, repeated ones as well."""
    wanted = nodes.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"),
                          "_k1", "_k2")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"),
                        F.xxhash64("text").alias("_text"), "text")
    on = wanted["_id"].eqNullSafe(texts["_doc"]) & (wanted["_key"] == texts["_text"])
    return wanted.join(texts, on).select("node", "text", "_k1", "_k2")


def whole_sets(found: DataFrame, n: int) -> DataFrame:
    """The set of each node once, with its registers and bitmap."""
    sets = stage(
        found.mapInArrow(_set_maker(n), "node long, size long, grams binary, sketch binary, "
                                        "bits binary"), "sets")
    # copies that were not next to each other; none in most tables, where nothing is moved
    if sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return sets
    return stage(sets.dropDuplicates(["node"]), "sets")


def link_nodes(nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``a, b``: confirmed links that connect all sets which any links connect."""
    spark = docs.sparkSession
    bands = nodes.select("node", "_sketch").mapInArrow(_bands, "key long, node long")
    pivots = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = pivots.where("low < high").select("key")
    buckets = stage(bands.join(shared, "key"), "buckets")
    sets = whole_sets(texts_of(buckets.select("node").distinct().join(nodes, "node"), docs), n)
    current = buckets.withColumn("label", F.col("node"))
    links = None
    for _ in range(PIVOT_ROUNDS):
        pivots = current.groupBy("key").agg(F.min(F.struct("node", "label")).alias("p")).select(
            "key", F.col("p.node").alias("pivot"), F.col("p.label").alias("pivot_label"))
        pairs = current.join(pivots, "key").where("label <> pivot_label").select(
            F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        confirmed = confirm(pairs, sets, num, den)
        links = confirmed if links is None else links.union(confirmed)
        # a pivot has met its whole bucket
        rest = current.join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"],
                            "left_anti")
        current = open_buckets(rest.select("key", "node"), components(links))
    rest = remaining_pairs(current, buckets, sets, num, den)
    return links.union(confirm(rest, sets, num, den))


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that are linked, each once."""
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("_x"),
                      F.col("sketch").alias("_s"))
    other = sets.select(F.col("node").alias("b"), F.col("grams").alias("_y"),
                        F.col("sketch").alias("_t"))
    return stage(
        pairs.distinct().join(one, "a").join(other, "b").select("a", "b", "_x", "_y", "_s", "_t")
        .mapInArrow(_verifier(num, den), "a long, b long"), "confirmed")


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, label`` of the buckets whose nodes are in more than one component."""
    labelled = buckets.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    split = labelled.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return stage(labelled.join(split.select("key"), "key").select("key", "node", "label"),
                 "buckets")


def remaining_pairs(
    current: DataFrame, buckets: DataFrame, sets: DataFrame, num: int, den: int
) -> DataFrame:
    """All pairs of open buckets that can still be linked and are not in one component.

    Sets outside their bucket's largest component meet all others of the bucket, whose
    members are dealt to several groups where they are many. A task holds a group's sizes
    and bitmaps and lets the outsiders pass by. A pair comes out of the bucket of its least
    common key only: if that is not open, one of the two was its pivot and has met the other.
    """
    own = sets.select("node", "size", "bits").dropDuplicates(["node"])
    keys = buckets.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    open_nodes = current.select("node").distinct()
    traits = open_nodes.join(own, "node").join(keys, "node")
    labels = current.groupBy("key", "label").agg(F.count("*").alias("n"))
    per_bucket = labels.groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"),
        F.ceil(F.sum("n") / GROUP).cast("int").alias("groups"))
    rows = stage(current.join(per_bucket, "key").join(traits, "node"), "open")
    members = rows.withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    outsiders = rows.where("label <> main").withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    columns = ["key", "group", "outside", "node", "label", "size", "bits", "keys"]
    dealt = members.withColumn("outside", F.lit(False)).select(columns).union(
        outsiders.withColumn("outside", F.lit(True)).select(columns))
    return (
        dealt.repartition("key", "group").sortWithinPartitions("key", "group", "outside", "node")
        .mapInArrow(_possible(num, den), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept, first_kept`` of every document.

    Documents whose sets of n-word shingles have a Jaccard similarity of ``num / den`` or
    more are linked; ``component_id`` is the smallest doc_id that links reach and ``kept``
    marks the document of that id. ``first_kept`` marks exactly one row of each component,
    also where ids repeat or are null. Documents without words are linked with nothing.
    Null ids count after all others; an empty table gives an empty result; other columns
    are not read.
    """
    rows = sketch_rows(docs, n)
    # the least row of each distinct set stands for it
    least = F.min(F.struct(F.col("_row"), F.col("doc_id")))
    some = rows.where("n_shingles > 0")
    keys = stage(some.groupBy("_k1", "_k2").agg(least.alias("_r"), F.count("*").alias("_n")).select(
        "_k1", "_k2", F.col("_r._row").alias("node"), F.col("_r.doc_id").alias("_id")), "nodes")
    nodes = rows.join(
        keys.select(F.col("node").alias("_row")), "_row", "left_semi"
    ).withColumnRenamed("_row", "node")
    labels = components(link_nodes(nodes, docs, n, num, den))
    named = keys.join(labels, "node", "left").select(
        "_k1", "_k2", F.coalesce("label", "node").alias("_component"))
    placed = stage(
        rows.select("doc_id", "text_key", "n_shingles", "_k1", "_k2", "_row").where("n_shingles > 0")
        .join(named, ["_k1", "_k2"]).select("doc_id", "text_key", "n_shingles", "_row", "_component")
        .union(rows.where("n_shingles = 0").select(
            "doc_id", "text_key", "n_shingles", "_row", "_row")),
        "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    heads = placed.groupBy("_component").agg(F.min(order).alias("_head")).select(
        "_component", F.col("_head.doc_id").alias("component_id"),
        F.col("_head._row").alias("_first"))
    return placed.join(heads, "_component").select(
        "doc_id", "text_key", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        (F.col("_row") == F.col("_first")).alias("first_kept"),
    )


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each component.

    Rows of equal id and text cannot be told apart, so any one of them stays; documents
    without words all stay.
    """
    status = near_duplicates(docs, n, num, den).groupBy(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")
    ).agg(F.count("*").alias("__all"), F.sum(F.col("first_kept").cast("int")).alias("__stay"))
    # the row as one column, whatever its columns are called
    marked = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"),
                         F.xxhash64("text").alias("__text"))
    stays = stage(status.where("__stay > 0"), "stays")
    on = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__key"))
    whole = marked.join(stays.where("__stay = __all"), on, "left_semi")
    one_of = marked.join(stays.where("__stay < __all"), on, "left_semi").dropDuplicates(
        ["__id", "__text"])
    return whole.union(one_of).select("__row.*")
