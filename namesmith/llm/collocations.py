"""Phrases whose words keep together, by Misra-Gries summaries and an exact second pass.

A phrase of one to four words that occurs ``threshold`` times or more must survive the first
pass: its hash falls into one hash partition, whose summary has more counters than the
partition's occurrences divided by the threshold, so that it undercounts by less than the
threshold. Every block of documents sends one small summary for each partition; they are
merged in a stream. What survives goes back to the blocks that hold it, and the second pass
counts exactly, by the words themselves.

Defined results: a null text is empty, a null language ``und``; a table without a frequent
phrase gives no rows; repeated rows and ids count as often as they stand there; other columns
are not read; texts of any length are walked in segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

#: occurrences from which a phrase is a candidate, its longest form, phrases of a language
THRESHOLD, MAX_WORDS, KEEP = 30, 4, 2_000
#: a phrase goes where a longer one has this share of its occurrences
COVER = (80, 100)
#: bytes of text for which there is one hash partition. A worker holds the keys of one, about
#: three bytes for every two bytes of text; a cluster with larger executors takes fewer, larger
#: ones, so that a summary's rows stay long
PARTITION_BYTES = 8_000_000
#: documents of a block, phrases that a worker holds before it sends a summary
BLOCK_ROWS, SUMMARY_PHRASES = 2_048, 4_000_000
#: bytes of text taken at once, in the first pass and in the second
HASH_BYTES, COUNT_BYTES = 1_000_000, 4_000_000

#: ends of pieces, all written as line ends; tabs as spaces
_PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: bits of a key within its partition. Keys may be shared: then more survive the first pass
_KEY_BITS = 24
_KEY = np.uint64((1 << _KEY_BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: words up to so many bytes are hashed and compared by arrays, eight bytes at a time
_SHORT = 64
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _segments(text: bytes, size: int, carried: int) -> Iterator[tuple[bytes, int]]:
    """Plain text in segments that end between words, each with its number of repeated words.

    A segment that starts within a piece repeats the piece's last words before it.
    """
    data = text.lower().translate(_PLAIN)
    lead: list[bytes] = []
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            cut = max(data.rfind(b" ", start, end), data.rfind(b"\n", start, end))
            if cut < 0:  # a word longer than a segment
                cut = min((i for i in (data.find(b" ", end), data.find(b"\n", end)) if i >= 0),
                          default=len(data))
            end = cut + 1
        part = b" ".join([*lead, data[start:end]])
        yield part, len(lead)
        lead = part[part.rfind(b"\n") + 1 :].split()[-carried:] if carried else []
        start = end


def _mixed(code: np.ndarray) -> np.ndarray:
    code = code * _MIX
    return code ^ (code >> np.uint64(29))


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the values, and where in it each different one starts."""
    order = np.argsort(values)
    ordered = values[order]
    if not len(ordered):
        return order, order
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


class _Chunk:
    """Segments of some documents: their words, and the piece and language of each."""

    def __init__(self, parts: list[tuple[str, bytes, int]]) -> None:
        self.data = b"\n".join(part for _, part, _ in parts)
        text = np.frombuffer(self.data, np.uint8)
        ends = text == 10
        inside = np.concatenate([[False], ~ends & (text != 32), [False]])
        bounds = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.sizes = bounds[::2], bounds[1::2] - bounds[::2]
        self.piece = np.searchsorted(np.flatnonzero(ends), self.starts)
        first = np.cumsum([0, *(len(part) + 1 for _, part, _ in parts[:-1])])
        part_of = np.searchsorted(first, self.starts, side="right") - 1
        self.langs = list(dict.fromkeys(lang for lang, _, _ in parts))
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([number[lang] for lang, _, _ in parts])[part_of]
        # words that the segment before has counted
        within = np.arange(len(part_of)) - np.searchsorted(part_of, np.arange(len(parts)))[part_of]
        self.old = within < np.array([repeated for _, _, repeated in parts])[part_of]
        # eight bytes from every byte on
        self.eight = np.ndarray((len(self.data),), "<u8", self.data + bytes(8), strides=(1,))
        self.long = np.flatnonzero(self.sizes > _SHORT)
        self.codes = self.word_codes()

    def bytes_at(self, at: int) -> bytes:
        return self.data[self.starts[at] : self.starts[at] + self.sizes[at]]

    def phrases(self, starts: np.ndarray, m: int) -> list[bytes]:
        """The ``m`` words from each start, joined by single spaces."""
        last = starts + (m - 1)
        a, b = self.starts[starts], self.starts[last] + self.sizes[last]
        words = sum((self.sizes[starts + j] for j in range(m)), np.zeros(len(starts), np.int64))
        found = [self.data[i:j] for i, j in zip(a.tolist(), b.tolist())]
        for i in np.flatnonzero(b - a != words + (m - 1)).tolist():
            found[i] = b" ".join(found[i].split())
        return found

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words that have a next eight bytes, and these."""
        some = np.arange(len(self.starts))
        for k in range(0, _SHORT, 8):
            some = some[self.sizes[some] > k]
            left = np.minimum(self.sizes[some] - k, 8)
            yield some, self.eight[self.starts[some] + k] & _FIRST_BYTES[left]

    def word_codes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        code = _mixed(self.sizes.astype(np.uint64))
        for some, value in self._blocks():
            code[some] = _mixed(code[some] ^ value)
        for at in self.long.tolist():
            code[at] = xxhash.xxh3_64_intdigest(self.bytes_at(at))
        return code

    def word_ids(self) -> np.ndarray:
        """The same number for equal words only: hashes are held against the words themselves."""
        order, starts = _grouped(self.codes)
        ids = np.empty(len(order), np.int64)
        ids[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
        like = order[starts][ids]
        same = bool((self.sizes == self.sizes[like]).all())
        value = np.zeros(len(ids), np.uint64)
        for some, eight in self._blocks() if same else ():
            value[some] = eight
            same = same and bool((eight == value[like[some]]).all())
        same = same and all(self.bytes_at(i) == self.bytes_at(like[i]) for i in self.long.tolist())
        if same:
            return ids
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.bytes_at(i), len(known)) for i in range(len(ids))])

    def grams(self, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the first words of its phrases and their 64-bit hashes."""
        word = self.codes
        by_lang = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs], np.uint64)
        code = by_lang[self.lang]
        for m in range(1, max_words + 1):
            n = len(word) - m + 1
            if n <= 0:
                return
            code = _mixed(code[:n] ^ word[m - 1 :])
            starts = np.flatnonzero((self.piece[:n] == self.piece[m - 1 :]) & ~self.old[m - 1 :])
            yield m, starts, code[starts]


def _slot(code: np.ndarray, partitions: int) -> np.ndarray:
    """The hash partition in the upper bits, the key within it in the lower ones."""
    return ((code >> np.uint64(32)) % np.uint64(partitions)) << np.uint64(_KEY_BITS) | (code & _KEY)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : _KEY_BITS // 8].tobytes()


def _unpacked(keys: bytes) -> np.ndarray:
    narrow = np.frombuffer(keys, np.uint8).reshape(-1, _KEY_BITS // 8)
    wide = np.zeros((len(narrow), 4), np.uint8)
    wide[:, : _KEY_BITS // 8] = narrow
    return wide.view("<u4").ravel()


_SUMMARY = pa.schema([("p", pa.int64()), ("seq", pa.int32()), ("block", pa.int64()),
                      ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _summaries(max_words: int, partitions: int, segment: int):
    """Blocks of documents to a summary for each hash partition, its mass in a row ahead."""

    def summary(block: int, found: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.concatenate(found)
        found.clear()
        slots.sort()
        starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        counts = np.diff(starts, append=len(slots))
        slots = slots[starts]
        of = (slots >> np.uint64(_KEY_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        rows = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(of)]):
            key, n = slots[a:b] & _KEY, counts[a:b]
            many = n > 1
            rows.append((int(of[a]), 0, block, int(n.sum()), None, None))
            # keys that occur once come last, without their count
            rows.append((int(of[a]), 1, block, None,
                         _packed(np.concatenate([key[many], key[~many]])),
                         n[many].astype(np.uint32).tobytes()))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)]
        return pa.RecordBatch.from_arrays(columns, schema=_SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, held = None, [], 0
        for block, chunk in _chunks(batches, max_words, segment, HASH_BYTES):
            if found and (block != now or held >= SUMMARY_PHRASES):
                yield summary(now, found)
                held = 0
            now = block
            for _, _, code in chunk.grams(max_words):
                if len(code):
                    found.append(_slot(code, partitions))
                    held += len(code)
        if found:
            yield summary(now, found)

    return run


def _chunks(
    batches: Iterator[pa.RecordBatch], max_words: int, segment: int, size: int
) -> Iterator[tuple[int, _Chunk]]:
    """Each block's documents in chunks of bounded size."""
    now, parts, held = None, [], 0
    for batch in batches:
        blocks, langs, texts = (batch.column(c) for c in ("block", "lang", "text"))
        for i in range(batch.num_rows):
            block, lang = blocks[i].as_py(), langs[i].as_py()
            if block != now and parts:
                yield now, _Chunk(parts)
                parts, held = [], 0
            now = block
            for part, repeated in _segments(texts[i].as_py(), min(segment, size), max_words - 1):
                parts.append((lang, part, repeated))
                held += len(part)
                if held >= size:
                    yield now, _Chunk(parts)
                    parts, held = [], 0
    if parts:
        yield now, _Chunk(parts)


class MisraGries:
    """A mergeable summary: it undercounts a key by at most ``missed``.

    With ``capacity`` counters, ``missed`` is at most the merged mass / (capacity + 1).
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.missed = 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._waits = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._waits += len(keys)
        if self._waits >= self.capacity:
            self.merge()

    def merge(self) -> None:
        """Take in what waits; if that is too much, lower all counters alike."""
        if not self._waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self._waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self._waiting)])
        order, starts = _grouped(keys)
        keys, counts = keys[order[starts]], np.add.reduceat(counts[order], starts)
        if len(keys) > self.capacity:
            # the largest counter that finds no room
            over = len(counts) - self.capacity - 1
            less = int(np.partition(counts, over)[over])
            self.missed += less
            counts = counts - less
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts, self._waiting, self._waits = keys, counts, [], 0

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys, in order, that may have been seen ``threshold`` times."""
        self.merge()
        return self.keys[self.counts + self.missed >= threshold]


_SURVIVORS = pa.schema([("block", pa.int64()), ("p", pa.int64()), ("keys", pa.binary())])


def _survivors(threshold: int):
    """Summaries in order of partition to the keys that each block must count exactly.

    Memory is that of one hash partition, whose size ``PARTITION_BYTES`` sets.
    """

    def ended(p: int, summary: MisraGries, sent: list) -> pa.RecordBatch:
        frequent = np.zeros(1 << _KEY_BITS, bool)
        frequent[summary.frequent(threshold)] = True
        rows = []
        for block, packed in sent:
            keys = _unpacked(packed)
            keys = keys[frequent[keys]]
            if len(keys):
                rows.append((block, p, _packed(keys)))
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _SURVIVORS)], schema=_SURVIVORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary, sent = None, 0, None, []
        for batch in batches:
            for row in _each(batch):
                if row["p"] != now:
                    if summary is not None:
                        yield ended(now, summary, sent)
                    now, mass, summary, sent = row["p"], 0, None, []
                if row["seq"] == 0:
                    mass += row["mass"]
                    continue
                if summary is None:
                    summary = MisraGries(mass // threshold + 1)
                keys, many = _unpacked(row["keys"]), np.frombuffer(row["counts"], np.uint32)
                counts = np.ones(len(keys), np.int64)
                counts[: len(many)] = many
                summary.add(keys, counts)
                sent.append((row["block"], row["keys"]))
        if summary is not None:
            yield ended(now, summary, sent)

    return run


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


def _exact(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each tuple, equal for equal tuples only."""
    code = columns[0]
    for column in columns[1:]:
        if len(code) and (int(code.max()) + 1) * size >= 1 << 62:
            order, starts = _grouped(code)
            code = np.empty(len(order), np.int64)
            code[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
        code = code * size + column
    return code


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: each holds a large value."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _counted(max_words: int, partitions: int, segment: int):
    """A block's surviving keys, then its documents, to exact counts of their phrases.

    The row of an empty phrase has the number of words of a language.
    """
    # a first look by some of the bits spares the search for most phrases
    some = np.uint64((1 << 22) - 1)

    def counts(chunk: _Chunk, slots: np.ndarray, maybe: np.ndarray) -> Iterator[pa.RecordBatch]:
        langs = pa.array(chunk.langs, pa.string())
        words = np.bincount(chunk.lang[~chunk.old], minlength=len(langs))
        yield pa.RecordBatch.from_arrays(
            [langs, pa.array([b""] * len(langs), pa.binary()), pa.array(words, pa.int64())],
            schema=_COUNTS)
        ids = chunk.word_ids()
        size = int(ids.max(initial=0)) + 1
        for m, starts, code in chunk.grams(max_words):
            slot = _slot(code, partitions)
            likely = np.flatnonzero(maybe[slot & some])
            slot, starts = slot[likely], starts[likely]
            at = np.searchsorted(slots, slot)
            at[at == len(slots)] = 0
            starts = starts[slots[at] == slot] if len(slots) else starts[:0]
            order, first = _grouped(
                _exact([chunk.lang[starts], *(ids[starts + j] for j in range(m))], size))
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(chunk.lang[starts[order[first]]])),
                 pa.array(chunk.phrases(starts[order[first]], m), pa.binary()),
                 pa.array(np.diff(first, append=len(order)), pa.int64())], schema=_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[np.ndarray]] = {}

        def documents() -> Iterator[pa.RecordBatch]:
            """The rows that have a text; the keys ahead of them are put aside."""
            for batch in batches:
                given = np.flatnonzero(batch.column("seq").to_numpy() == 0)
                for row in _each(batch.take(pa.array(given))):
                    keys.setdefault(row["block"], []).append(
                        _unpacked(row["keys"]).astype(np.uint64)
                        | np.uint64(row["p"] << _KEY_BITS))
                yield batch.filter(pa.compute.equal(batch.column("seq"), 1))

        now, slots, maybe = None, None, None
        for block, chunk in _chunks(documents(), max_words, segment, COUNT_BYTES):
            if block != now:
                for old in [b for b in keys if b < block]:
                    del keys[old]
                now = block
                slots = np.unique(np.concatenate([np.empty(0, np.uint64), *keys.get(block, [])]))
                maybe = np.zeros(int(some) + 1, bool)
                maybe[slots & some] = True
            yield from counts(chunk, slots, maybe)

    return run


def frequent_phrases(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    max_words: int = MAX_WORDS,
    segment: int = HASH_BYTES,
) -> DataFrame:
    """``lang, phrase, n``: phrases of one word and more that occur ``threshold`` times.

    The row of an empty phrase has all words of the language, however few.
    """
    # a block must be the same documents in both passes: it is written down
    block = F.expr(f"monotonically_increasing_id() div {BLOCK_ROWS}")
    texts = stage(docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        block.alias("block"),
    ), "phrase-blocks")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = 1 + size // PARTITION_BYTES

    schema = "p long, seq int, block long, mass long, keys binary, counts binary"
    summaries = texts.mapInArrow(_summaries(max_words, partitions, segment), schema)
    survivors = (
        summaries.repartition("p").sortWithinPartitions("p", "seq")
        .mapInArrow(_survivors(threshold), "block long, p long, keys binary")
    )
    both = survivors.selectExpr("block", "0 as seq", "p", "keys", "'' as lang",
                                "cast(null as binary) as text").unionByName(
        texts.selectExpr("block", "1 as seq", "cast(null as long) as p",
                         "cast(null as binary) as keys", "lang", "text"))
    counted = (
        both.repartition("block").sortWithinPartitions("block", "seq")
        .mapInArrow(_counted(max_words, partitions, segment), "lang string, phrase binary, n long")
    )
    total = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    phrase = F.col("phrase").cast("string")
    return total.where((F.col("n") >= threshold) | (F.octet_length("phrase") == 0)).select(
        "lang", phrase.alias("phrase"), "n")


def cut_scores(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates ``lang, phrase, size, a`` with the ``l``, ``r`` and ``score`` of their worst cut."""
    cuts = candidates.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).selectExpr(
        "lang", "phrase", "size", "a", "k",
        "substring_index(phrase, ' ', k) as first", "substring_index(phrase, ' ', k - size) as rest")
    scored = (
        cuts.join(parts.selectExpr("lang", "phrase as first", "n as l"), ["lang", "first"])
        .join(parts.selectExpr("lang", "phrase as rest", "n as r"), ["lang", "rest"])
        # 38 digits: products and sums of longs fit
        .withColumn("score", F.expr(
            "2000000BD * cast(a as decimal(20, 0))"
            " div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    )
    worst = scored.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return worst.selectExpr("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def not_covered(candidates: DataFrame, cover: tuple[int, int] = COVER) -> DataFrame:
    """Candidates that no longer one holds with the given share of their occurrences.

    Phrases longer by one word suffice: one within a longer phrase occurs as often at least.
    """
    num, den = cover
    inside = candidates.where("size > 2").select(
        "lang", F.explode(F.expr(
            "array(substring_index(phrase, ' ', size - 1), substring_index(phrase, ' ', 1 - size))"
        )).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = most.join(candidates.select("lang", "phrase", "a"), ["lang", "phrase"]).where(
        f"{den}BD * cast(longer as decimal(20, 0)) >= {num}BD * cast(a as decimal(20, 0))")
    return candidates.join(covered.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def collocations(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    max_words: int = MAX_WORDS,
    keep: int = KEEP,
    segment: int = HASH_BYTES,
) -> DataFrame:
    """The ``keep`` best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    counts = stage(frequent_phrases(docs, threshold, max_words, segment), "phrase-counts")
    words = counts.where("phrase = ''").selectExpr("lang", "n")
    parts = counts.where("phrase <> ''")
    candidates = parts.selectExpr(
        "lang", "phrase", "n as a", "length(phrase) - length(replace(phrase, ' ', '')) + 1 as size"
    ).where("size > 1")
    scored = cut_scores(not_covered(candidates), parts)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return ranked.join(words, "lang").selectExpr(
        "lang", "cast(rank as long) as rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The same by plain counting of all phrases."""
    grams = "\n union all\n".join(
        f"select lang, {m} as size, list_slice(words, i, i + {m - 1}) as gram"
        f" from pieces, unnest(generate_series(1, len(words) - {m - 1})) as t(i)"
        for m in range(1, MAX_WORDS + 1))
    return rf"""
with docs as (
 select coalesce(lang, 'und') as lang, translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (
 select lang, regexp_extract_all(piece, '[^ \t]+') as words
 from (select lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\x0C\r]')) as piece from docs)),
counts as (
 select lang, size, array_to_string(gram, ' ') as phrase, count(*) as n from ({grams}) g
 group by all having count(*) >= {THRESHOLD}),
words as (select lang, cast(sum(len(words)) as bigint) as n from pieces group by lang),
candidates as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from counts where size > 1),
inside as (
 select lang, array_to_string(list_slice(w, i, i + size - 2), ' ') as phrase, max(a) as longer
 from candidates, unnest([1, 2]) as t(i) where size > 2 group by all),
left_over as (
 select c.* from candidates c left join inside i using (lang, phrase)
 where longer is null or {COVER[1]}::hugeint * longer < {COVER[0]}::hugeint * a),
cuts as (
 select c.lang, c.phrase, c.a, k, f.n as l, r.n as r,
  (2000000::hugeint * c.a) // (f.n::hugeint + r.n) as score
 from left_over c cross join unnest(generate_series(1, {MAX_WORDS - 1})) as t(k)
 join counts f on f.lang = c.lang and f.phrase = array_to_string(list_slice(w, 1, k), ' ')
 join counts r on r.lang = c.lang and r.phrase = array_to_string(list_slice(w, k + 1, c.size), ' ')
 where k < c.size),
worst as (
 select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
 phrase, a, l, r, n, cast(score as bigint) as score
from worst join words using (lang)
qualify rank <= {KEEP}
"""
