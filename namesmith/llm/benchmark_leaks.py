"""Benchmark decontamination by a BM25 index with block-max WAND.

Test items are indexed: for each word its items with their BM25 weight, in blocks with the
largest weight of each. Weights are shares of the item's own full score, so one threshold
fits all items. Items are indexed by classes of length, each with statistics and passages of
its own, so no item changes what is found of another class. Every passage of every document is a
query: blocks whose maxima cannot reach
the threshold are passed over, in the others the lists advance from pivot to pivot. What
scores enough is verified by the shares of the item's question and answer that stand in the
passage word for word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..storage import stage

#: least share of an item's full BM25 score
SCORE = 0.6
#: words of a shingle; shares of all shingles, and of the question's and the answer's
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
K1, B = 1.2, 0.75
#: items of a block; few, as items are short and share their common words
BLOCK = 4
#: passages have twice as many words as this and overlap by half; it is doubled for the items
#: that are longer, until they lie whole in a passage
LEAST_STRIDE = 64
#: characters of items that are indexed at once; more items are searched one such part after another
INDEX_CHARACTERS = 16_000_000

_WORD = re.compile(r"[^\W_]+")
_BATCH = 500
_DDL = ("doc_id long, item_id long, score double, overlap double, question_overlap double, "
        "answer_overlap double")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                     ("overlap", pa.float64()), ("question_overlap", pa.float64()),
                     ("answer_overlap", pa.float64())])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before its last sentence or line, and those of it.

    An item of one sentence has its last third as answer.
    """
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if _WORD.search(p)]
    if len(parts) > 1:
        return words_of("\n".join(parts[:-1])), words_of(parts[-1])
    words = words_of(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def stride_of(n_words: int) -> int:
    """Half the passage of an item's class of length."""
    stride = LEAST_STRIDE
    while stride < n_words:
        stride *= 2
    return stride


def shingles(words: list, n: int = SHINGLE) -> set[tuple]:
    """Runs of n words; of fewer words, the whole."""
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n))))


class Index:
    """Items of a class with at least one word, their postings, blocks and shingles."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], total: int,
                 mean_words: float, stride: int = LEAST_STRIDE) -> None:
        self.stride = stride
        self.items, self.grams, self.parts = [], [], []
        self.number: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for item_id, text in sorted(items):
            words = words_of(text)
            if not words:
                continue
            at = len(self.items)
            self.items.append(item_id)
            counts = Counter(words)
            norm = K1 * (1 - B + B * len(words) / mean_words)
            weights = {
                w: math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5))
                * n * (K1 + 1) / (n + norm)
                for w, n in counts.items()
            }
            full = sum(weights.values())
            for w, x in weights.items():
                t = self.number.setdefault(w, len(postings))
                if t == len(postings):
                    postings.append([])
                postings[t].append((at, x / full))
            numbered = [self.number[w] for w in words]
            q, a = question_and_answer(text)
            self.grams.append(shingles(numbered))
            self.parts.append([shingles([self.number[w] for w in part]) for part in (q, a)])
        self.lists = [([i for i, _ in p], [x for _, x in p]) for p in postings]
        self.n_blocks = -(-len(self.items) // BLOCK)
        # of each list: block -> first and last place in it, and largest weight
        self.runs: list[dict[int, tuple[int, int, float]]] = []
        self.block_of, self.block_max = [], []
        for p in postings:
            runs: dict[int, tuple[int, int, float]] = {}
            for at, (i, x) in enumerate(p):
                start, _, most = runs.get(i // BLOCK, (at, at, 0.0))
                runs[i // BLOCK] = (start, at + 1, max(most, x))
            self.runs.append(runs)
            self.block_of.append(np.fromiter(runs, np.int64))
            self.block_max.append(np.array([most for _, _, most in runs.values()]))

    def blocks(self, terms: list[int]) -> list[int]:
        """The blocks whose maxima reach the threshold together."""
        bounds = np.bincount(
            np.concatenate([self.block_of[t] for t in terms]),
            np.concatenate([self.block_max[t] for t in terms]), self.n_blocks)
        return np.flatnonzero(bounds >= SCORE - 1e-9).tolist()

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose score for these distinct terms reaches the threshold."""
        return [hit for block in self.blocks(terms) for hit in self._wand(terms, block)]

    def _wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """WAND within a block: its maxima bound what each list can still add."""
        cursors = []  # [item, place, end, largest weight in the block, term]
        for t in terms:
            run = self.runs[t].get(block)
            if run:
                cursors.append([self.lists[t][0][run[0]], *run, t])
        hits = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= SCORE - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                own = [c for c in cursors if c[0] == pivot]
                score = sum(self.lists[c[4]][1][c[1]] for c in own)
                if score >= SCORE - 1e-9:
                    hits.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            for c in cursors:
                if c[0] < goal:
                    ids = self.lists[c[4]][0]
                    c[1] = bisect_left(ids, goal, c[1], c[2])
                    c[0] = ids[c[1]] if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return hits

    def verify(self, item: int, present: set[tuple]) -> tuple[float, float, float] | None:
        """Shares of an item's, question's and answer's shingles among those present."""
        grams = self.grams[item]
        short = {len(g) for g in grams}.pop() < SHINGLE

        def share(wanted: set[tuple]) -> float:
            if not wanted:
                return 1.0
            size = len(next(iter(wanted)))
            pool = present if size == SHINGLE else {
                g[i : i + size] for g in present for i in range(len(g) - size + 1)}
            return len(wanted & pool) / len(wanted)

        whole = share(grams)
        if whole < (1.0 if short else OVERLAP) - 1e-9:
            return None
        q, a = map(share, self.parts[item])
        return None if min(q, a) < PART_OVERLAP - 1e-9 else (whole, q, a)

    def leaks(self, words: list[str]) -> list[tuple[int, float, float, float, float]]:
        """Per item found in a text's words: id, score and overlaps of its best passage."""
        number, stride = self.number.get, self.stride
        terms = [number(w, -1) for w in words]
        known = set(terms)
        known.discard(-1)
        # a document whose words all together cannot reach an item has no passage that does
        if not known or not self.blocks(list(known)):
            return []
        best: dict[int, tuple] = {}
        for start in range(0, max(1, len(terms) - stride), stride):
            part = terms[start : start + 2 * stride]
            own = set(part)
            own.discard(-1)
            if not own:
                continue
            hits = self.search(list(own))
            present = shingles(part) if hits else set()
            for item, score in hits:
                found = self.verify(item, present)
                if found:
                    best[item] = max(best.get(item, (0.0,)), (found[0], score, *found[1:]))
        return [(self.items[i], score, whole, q, a) for i, (whole, score, q, a) in best.items()]


def leaks(indexes: list[Index], text: str | None) -> list[tuple]:
    """Per item of several indexes that is found in a text: id, score and overlaps."""
    words = words_of(text)
    return [leak for index in indexes for leak in index.leaks(words)]


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [len(words_of(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
             pa.array(map(stride_of, counts), pa.int64())],
            ["item_id", "text", "n_words", "stride"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter((s, w) for t, s in zip(*(c.to_pylist() for c in batch.columns))
                       for w in set(words_of(t)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in seen], pa.int64()), pa.array([w for _, w in seen], pa.string()),
             pa.array(seen.values(), pa.int64())], ["stride", "word", "n"])


def word_counts(items: DataFrame) -> DataFrame:
    """Items of a class of length that hold a word."""
    return items.select("text", "stride").mapInArrow(
        _words, "stride long, word string, n long"
    ).groupBy("stride", "word").agg(F.sum("n").alias("n"))


def build_indexes(benchmark: DataFrame) -> list[Callable[[], list[Index]]]:
    """Makers of the indexes, a bounded number of characters of items each.

    Only one maker's items need be in memory at a time. Those of a class of length that fill more
    than one part share its statistics.
    """
    items = stage(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string"))
        .where("text is not null and item_id is not null").dropDuplicates()
        .mapInArrow(_sized, "item_id long, text string, n_words long, stride long")
        .where("n_words > 0"), "items")
    # a row for each doubling of an item's length
    classes = items.groupBy("stride").agg(
        F.count("*").alias("total"), F.sum("n_words").alias("words"),
        F.sum(F.length("text")).alias("characters")).orderBy("stride").collect()
    every = stage(word_counts(items), "words") if classes else None

    def built(c: Row, part: int, parts: int) -> Index:
        share = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part
        own = items.where((F.col("stride") == c["stride"]) & share)
        counts = every.where(F.col("stride") == c["stride"])
        if parts > 1:
            # no more words than the characters of the part
            counts = counts.join(word_counts(own).select("word"), "word")
        return Index([(r["item_id"], r["text"]) for r in own.select("item_id", "text").collect()],
                     dict(counts.select("word", "n").collect()), c["total"],
                     c["words"] / c["total"], c["stride"])

    groups: list[list[tuple]] = []
    room = 0
    for c in classes:
        parts = -(-c["characters"] // INDEX_CHARACTERS)
        for part in range(parts):
            size = c["characters"] // parts
            if size > room:
                groups.append([])
                room = INDEX_CHARACTERS
            groups[-1].append((c, part, parts))
            room -= size
    return [lambda group=group: [built(*g) for g in group] for group in groups]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, overlap, question_overlap, answer_overlap``.

    A row for each document and item whose text a passage of the document holds: BM25 of at
    least ``SCORE`` of the item's own, ``OVERLAP`` of its five-word shingles, and
    ``PART_OVERLAP`` of its question's and answer's. Items with fewer words must be held
    whole. Null and empty texts and items match nothing; repeated documents give a row each,
    repeated items count once; an empty benchmark gives an empty result; other columns are not
    read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    makers, found = build_indexes(benchmark), []
    for make in makers:
        def run(batches: Iterator[pa.RecordBatch], indexes: list[Index] = make()):
            for batch in batches:
                for part in range(0, batch.num_rows, _BATCH):
                    cut = batch.slice(part, _BATCH)
                    out = [(d, *leak) for d, t in zip(*(c.to_pylist() for c in cut.columns))
                           for leak in leaks(indexes, t)]
                    columns = list(zip(*out)) if out else [[]] * len(_SCHEMA)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

        one = rows.mapInArrow(run, _DDL)
        # written before the next index is made
        found.append(stage(one, "leaks") if len(makers) > 1 else one)
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], _DDL)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    at, makers = docs.columns.index("text"), build_indexes(benchmark)
    for make in makers:
        def run(batches: Iterator[pa.RecordBatch], indexes: list[Index] = make()):
            for batch in batches:
                clean = [not leaks(indexes, t) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if len(makers) > 1:
            docs = stage(docs, "clean")
    return docs
