"""Repeated byte strings of a fixed length, by suffix arrays over anchored contexts.

Every string of ``length`` bytes is assigned to the least hash of a short gram inside it,
its anchor; equal strings have equal anchors at equal offsets, so strings are compared
only within the bucket of one anchor's hash. A context is the stretch of a document that
all strings of one anchor cover. Contexts that occur twice as a whole are repeated
throughout, which narrow rows of hashes decide. Only what is left needs bytes: the
different contexts of a bucket are lined up at the anchor, ordered to its right by a suffix
array (Lyndon grouping over ranks of byte blocks) and to its left by their reversed
bytes; classes with equal left parts are merged from the longest on, and at each merge the
neighbours in suffix order have the longest common right part. So each context learns
the largest stretch it shares without all pairs being compared.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .lyndon_suffixes import suffix_array

LENGTH = 400
#: bytes of a gram, for each byte of the string length
GRAM_SHARE = 0.16
#: bytes that make a symbol of the suffix array
BLOCK = 64
#: different contexts of one anchor that a task orders at once; beyond it strings are counted
BUCKET = 20_000

_BATCH = 1_000
_MULTIPLIER = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the hash's multiplier and of its inverse, as far as texts reach."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))


def gram_hashes(data: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """A hash of each k-byte gram."""
    n = len(data)
    powers.reach(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.down[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * powers.up[: n - k + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, w: int, least_or_most) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        values = least_or_most(values[:-size], values[size:])
        size *= 2
    return values if size == w else least_or_most(values[: -(w - size)], values[w - size :])


def anchors(data: np.ndarray, length: int, k: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Hash, place, and first and last start of the strings assigned to it, per anchor.

    A string belongs to the leftmost of its least gram hashes.
    """
    h = gram_hashes(data, k, powers)
    w = length - k + 1
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    place = np.flatnonzero(most == h)
    value = h[place]
    # runs of equal minima and runs of equal anchors follow each other in the same order
    turn = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    run_end = np.r_[turn[1:], len(least)] - 1
    opens = np.r_[True, value[1:] != value[:-1]]
    run = np.cumsum(opens) - 1
    first = np.where(opens, turn[run], np.r_[0, place[:-1] + 1])
    last = np.minimum(place, run_end[run])
    ok = first <= last
    return value[ok], place[ok], first[ok], last[ok]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that half-open spans cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(s) for s in out]


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.uint64).view(np.int64).tolist()


_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_ROW = pa.schema([
    ("doc_id", pa.int64()), ("_key", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()),
    ("own", _SPANS),
    ("at", pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()),
                               ("q", pa.int32()), ("l", pa.int32()), ("r", pa.int32())]))),
])
_ROW_DDL = (
    "doc_id long, _key long, n_bytes long, sha string, own array<struct<lo:int,hi:int>>, "
    "at array<struct<h:long,c:long,n:int,q:int,l:int,r:int>>"
)


def _finder(length: int, k: int):
    def doc_anchors(data: bytes, powers: Powers) -> tuple[list, list]:
        """The anchors of one text, and the spans of contexts it holds twice itself."""
        if len(data) < length:
            return [], []
        value, place, first, last = anchors(np.frombuffer(data, np.uint8), length, k, powers)
        seen: dict[tuple, list] = {}
        own = []
        for h, q, s, e in zip(_signed(value), place.tolist(), first.tolist(), last.tolist()):
            c = xxhash.xxh3_64_intdigest(data[s : e + length], seed=q - s)
            c -= (c >> 63) << 64
            row = seen.get((h, c))
            if row is None:
                seen[h, c] = [h, c, 1, q, q - s, e + length - q]
            else:
                if row[2] == 1:
                    own.append((row[3] - row[4], row[3] + row[5]))
                row[2] = 2
                own.append((s, e + length))
        return merged(own), list(seen.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        names = [f.name for f in _ROW.field("at").type.value_type]
        for batch in batches:
            for part in range(0, batch.num_rows, _BATCH):
                rows = []
                for doc_id, key, text in zip(*(c.to_pylist() for c in batch.slice(part, _BATCH).columns)):
                    data = (text or "").encode()
                    own, found = doc_anchors(data, powers)
                    rows.append({
                        "doc_id": doc_id, "_key": key, "n_bytes": len(data),
                        "sha": hashlib.sha256(data).hexdigest(),
                        "own": [{"lo": a, "hi": b} for a, b in own],
                        "at": [dict(zip(names, r)) for r in found],
                    })
                yield pa.RecordBatch.from_pylist(rows, _ROW)

    return run


_CONTEXT = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("q", pa.int32()),
                      ("l", pa.int32()), ("ctx", pa.binary())])


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each text, which comes as a row in a column."""
    for batch in batches:
        texts = batch.column("__row").field("text")
        for part in range(0, batch.num_rows, 100):
            rows = []
            wanted = batch.select(["uid", "wanted"]).slice(part, 100).to_pylist()
            for i, r in enumerate(wanted, part):
                data = texts[i].as_py().encode()
                for w in r["wanted"]:
                    ctx = data[w["q"] - w["l"] : w["q"] + w["r"]]
                    rows.append({"h": w["h"], "n": w["n"], "uid": r["uid"], "q": w["q"],
                                 "l": w["l"], "ctx": ctx})
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_pylist(rows, _CONTEXT)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _CONTEXT)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def right_ranks(rights: list[bytes]) -> list[int]:
    """The rank of each string, from one suffix array over all of them.

    A symbol is the rank of a block of bytes (and of its length, for the last); the strings
    are joined by a least symbol.
    """
    cut = [[(r[i : i + BLOCK], min(BLOCK, len(r) - i)) for i in range(0, len(r), BLOCK)]
           for r in rights]
    rank = {b: i for i, b in enumerate(sorted({b for blocks in cut for b in blocks}), 1)}
    text, starts = [], {}
    for i, blocks in enumerate(cut):
        starts[len(text)] = i
        text += [rank[b] for b in blocks]
        text.append(0)
    ranks = [0] * len(rights)
    for at, i in enumerate(starts[p] for p in suffix_array(text) if p in starts):
        ranks[i] = at
    return ranks


def shared_stretches(contexts: list[tuple[bytes, int]], length: int) -> list[tuple[int, int] | None]:
    """For each context (bytes, anchor's place in it), how far it goes left and right of the
    anchor in strings of ``length`` bytes that another context has at the same offset."""
    rights = [ctx[q:] for ctx, q in contexts]
    lefts = [ctx[:q][::-1] for ctx, q in contexts]
    ranks = right_ranks(rights)
    by_left = sorted(range(len(contexts)), key=lefts.__getitem__)
    events = sorted(
        ((_common(lefts[a], lefts[b]), i) for i, (a, b) in enumerate(zip(by_left, by_left[1:]))),
        reverse=True,
    )
    at_rank = {r: i for i, r in enumerate(ranks)}
    owner = list(range(len(contexts)))  # by position in by_left
    classes = [[ranks[i]] for i in by_left]
    best: list[list[int] | None] = [None] * len(contexts)

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    def meet(x: int, y: int, left: int) -> None:
        right = _common(rights[x], rights[y])
        if left + right >= length:
            for i in (x, y):
                if best[i] is None:
                    best[i] = [left, right]
                else:
                    best[i] = [max(left, best[i][0]), max(right, best[i][1])]

    for left, i in events:
        a, b = find(i), find(i + 1)
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        large = classes[a]
        for r in classes[b]:
            k = bisect_left(large, r)
            if k:
                meet(at_rank[large[k - 1]], at_rank[r], left)
            if k < len(large):
                meet(at_rank[large[k]], at_rank[r], left)
        for r in classes[b]:
            insort(large, r)
        classes[b] = []
        owner[b] = a
    return [b and (b[0], b[1]) for b in best]


_FOUND = pa.schema([("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _solver(length: int):
    def solve(rows: list[dict]) -> list[dict]:
        # repeats of a context are in the table once; a row with n > 1 is known to be covered
        reach = shared_stretches([(r["ctx"], r["l"]) for r in rows], length)
        return [{"uid": r["uid"], "lo": r["q"] - got[0], "hi": r["q"] + got[1]}
                for r, got in zip(rows, reach) if got and r["n"] == 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for part in range(0, batch.num_rows, _BATCH)
                  for r in batch.slice(part, _BATCH).to_pylist())
        out = []
        for _, bucket in groupby(stream, key=lambda r: r["h"]):
            # rows of equal id and text bring a context each, one after the other
            out += solve([next(same) for _, same in groupby(bucket, key=lambda r: (r["uid"], r["q"]))])
            if len(out) >= _BATCH:
                yield pa.RecordBatch.from_pylist(out, _FOUND)
                out = []
        yield pa.RecordBatch.from_pylist(out, _FOUND)

    return run


def _stringer(length: int):
    """Each string of a context as a row: for buckets beyond the bound."""
    schema = pa.schema([("key", pa.int64()), ("more", pa.int64()), ("n", pa.int64()),
                        ("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (r for part in range(0, batch.num_rows, 100)
                      for r in batch.slice(part, 100).to_pylist()):
                rows, start = [], r["q"] - r["l"]
                for s in range(len(r["ctx"]) - length + 1):
                    x = xxhash.xxh3_128_intdigest(r["ctx"][s : s + length])
                    a, b = x >> 64, x & ((1 << 64) - 1)
                    rows.append({"key": a - ((a >> 63) << 64), "more": b - ((b >> 63) << 64),
                                 "n": r["n"], "uid": r["uid"], "lo": start + s,
                                 "hi": start + s + length})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def text_rows(docs: DataFrame, length: int) -> DataFrame:
    """A row of hashes for each document, written once; ``uid`` tells repeated rows apart.

    ``_key`` with ``doc_id`` identifies the text, also where ids repeat or are null.
    """
    k = max(8, int(length * GRAM_SHARE))
    source = keyed(docs).select("doc_id", "_key", "text")
    return stage(
        source.mapInArrow(_finder(length, k), _ROW_DDL)
        .withColumn("uid", F.monotonically_increasing_id()), "anchors")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"),
                             "_key": F.xxhash64(F.col("text"))})


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one column, whatever its columns are called, beside what identifies its text.

    Both joins to the texts read this one table by the same keys, so that in one plan the
    texts cross the network once.
    """
    return docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"),
                       F.xxhash64("text").alias("__text"))


def _same_text(table: DataFrame) -> Column:
    return F.col("__id").eqNullSafe(table["_doc"]) & (F.col("__text") == table["_k"])


def repeated_spans(docs: DataFrame, rows: DataFrame, length: int = LENGTH,
                   bucket: int = BUCKET) -> DataFrame:
    """``uid, spans``: for each text row with repeated strings the spans they cover."""
    at = rows.select("uid", F.explode("at").alias("a")).select("uid", "a.*")
    # only anchors seen twice matter
    again = at.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    kept = at.join(again, "h")
    distinct = stage(kept.groupBy("h", "c").agg(
        F.sum("n").alias("n"), F.min(F.struct("uid", "q", "l", "r")).alias("a")), "contexts")
    whole = kept.join(distinct.where("n > 1").select("h", "c"), ["h", "c"]).select(
        "uid", (F.col("q") - F.col("l")).alias("lo"), (F.col("q") + F.col("r")).alias("hi"))

    unsettled = distinct.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    unsettled = unsettled.where("m > 1 and least = 1").select("h", "m")
    wanted = distinct.join(unsettled, "h").select("h", "n", "m", "a.*")
    per_text = wanted.groupBy("uid").agg(F.collect_list(F.struct(
        F.when(F.col("m") > bucket, None).otherwise(F.col("h")).alias("h"), "n", "q", "l", "r",
    )).alias("wanted"))
    ids = rows.select("uid", F.col("doc_id").alias("_doc"), F.col("_key").alias("_k"))
    named = per_text.join(ids, "uid")
    with_text = whole_rows(docs).join(named, _same_text(named)).select("uid", "wanted", "__row")
    contexts = with_text.mapInArrow(
        _cutter, "h long, n long, uid long, q int, l int, ctx binary")
    large = unsettled.where(F.col("m") > bucket).limit(1).count() > 0
    if large:
        contexts = stage(contexts, "context_bytes")  # read in two ways
    solved = (
        contexts.where("h is not null").repartition("h").sortWithinPartitions("h", "uid", "q")
        .mapInArrow(_solver(length), "uid long, lo int, hi int")
    )
    own = rows.select("uid", F.explode("own").alias("s")).select("uid", "s.lo", "s.hi")
    spans = own.union(whole).union(solved)
    if large:
        once = contexts.where("h is null").dropDuplicates(["uid", "q"])
        strings = once.mapInArrow(
            _stringer(length), "key long, more long, n long, uid long, lo int, hi int")
        twice = strings.groupBy("key", "more").agg(F.sum("n").alias("n")).where("n > 1")
        counted = strings.drop("n").join(twice.select("key", "more"), ["key", "more"])
        spans = spans.union(counted.select("uid", "lo", "hi"))
    return spans.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def left_of(data: bytes, spans: list[dict]) -> list[bytes]:
    """The stretches of a text between its runs of repeats."""
    runs = merged([(s["lo"], s["hi"]) for s in spans])
    edges = [0, *(edge for run in runs for edge in run), len(data)]
    return [data[lo:hi] for lo, hi in zip(edges[::2], edges[1::2])]


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                     ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digests(texts: bool):
    schema = _DIGEST.append(pa.field("text", pa.string())) if texts else _DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("__id"), batch.column("__row").field("text"),
                       batch.column("spans")]
            for part in range(0, batch.num_rows, _BATCH):
                rows = []
                for doc_id, text, spans in zip(
                        *(c.slice(part, _BATCH).to_pylist() for c in columns)):
                    data = (text or "").encode()
                    kept = left_of(data, spans or [])
                    sha = hashlib.sha256()
                    for stretch in kept:
                        sha.update(stretch)
                    row = {"doc_id": doc_id, "n_bytes": len(data),
                           "n_removed": len(data) - sum(map(len, kept)),
                           "n_spans": len(kept) - 1, "kept_sha256": sha.hexdigest()}
                    if texts:
                        row["text"] = decoded(kept) if spans else text
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def decoded(kept: list[bytes]) -> str:
    """Stretches put together as a text, without what is left of cut characters."""
    return "".join(stretch.decode(errors="ignore") for stretch in kept)


def text_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``_doc, _k, spans``: rows of equal id and text have equal spans, which come once."""
    ids = rows.select("uid", F.col("doc_id").alias("_doc"), F.col("_key").alias("_k"))
    return spans.join(ids, "uid").groupBy("_doc", "_k").agg(F.first("spans").alias("spans"))


def repeat_digest(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET,
                  texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    Bytes covered by a string of ``length`` bytes that also starts elsewhere are removed;
    strings never cross documents. A null text is empty, shorter texts keep all, repeated
    rows count as copies of each other, an empty table gives an empty result, and other
    columns are not read. ``texts`` adds what is left as ``text``, as ``remove_repeats`` has it.
    """
    docs = docs.select("doc_id", "text")
    rows = text_rows(docs, length)
    cuts = text_spans(rows, repeated_spans(docs, rows, length, bucket))
    joined = whole_rows(docs).join(cuts, _same_text(cuts), "left").select("__id", "__row", "spans")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(_digests(texts), ddl + ", text string" * texts)


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """``docs``, all rows and columns, with repeated strings taken out of ``text``.

    What is left of a cut character goes too. ``n_chars``, where there is such a column,
    counts the new text. A null text stays null.
    """
    rows = text_rows(docs, length)
    spans = repeated_spans(docs, rows, length, bucket)
    cuts = text_spans(rows, spans)
    joined = whole_rows(docs).join(cuts, _same_text(cuts), "left").select(
        "__row.*", F.col("spans").alias("__spans"))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, _BATCH):
                cut = batch.slice(part, _BATCH)
                texts = []
                for text, own in zip(cut.column(at).to_pylist(), cut.column(-1).to_pylist()):
                    texts.append(decoded(left_of(text.encode(), own)) if own else text)
                columns = list(cut.columns[:-1])
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(
            F.length("text").cast(kind), F.col("n_chars")))
    return out
