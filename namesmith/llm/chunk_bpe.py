"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash of the last bytes cuts texts into chunks, so texts that share a passage share
its chunks whatever stands before. A worker process encodes a chunk once and keeps the result
for all documents of all its tasks, within a bound of bytes. A chunk's own encoding is exact from its first to
its last white space, because no token reaches over white space; at a join the rest of the
left chunk and the head of the right one are encoded again as one run, which grows over
further chunks until it ends in white space on both sides and so agrees with what surrounds
it. The tokens of equal words are kept in the same way.

The encodings stay with the process that made them: a table of them that all share would
have several times the bytes of the texts.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: bytes that decide a cut, and one cut in so many places
WINDOW, EVERY = 8, 1024
#: bytes from which a piece's merges are kept in a heap, which short pieces do not repay
LONG_PIECE = 256
#: what a worker process keeps: characters of encoded chunks, and words
KEPT_CHARACTERS, KEPT_WORDS = 24_000_000, 400_000

# white space of the tokenizer's patterns; fixed values
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: the pieces a run is taken apart into; fixed value of the vocabulary file
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"

_BATCH = 500
_MULTIPLIER = 0x9E3779B97F4A7C15


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b if b in plain else 0x100 + others.index(b)) for b in range(256)]


class WordEncoder(dict):
    """Piece -> (number of tokens, ids as text, tokens as text); forgets all when full."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.inner = [vocab[c] for c in byte_characters()]
        self.last = [vocab[c + self.suffix] for c in byte_characters()]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.joined = [vocab[a + b] for a, b in model["merges"]]
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special)) + ")")

    def __missing__(self, piece: str) -> tuple[int, str, str]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self.merged(piece.encode())
        found = self[piece] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return found

    def merged(self, data: bytes) -> list[int]:
        """The merges of lowest rank, leftmost first, until none applies."""
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        if len(ids) > LONG_PIECE:
            return self._merged_long(ids)
        rank_of, none = self.ranks.get, len(self.joined)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            ids[i : i + 2] = [self.joined[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same for pieces of any length: pairs in a heap, neighbours linked."""
        rank_of = self.ranks.get
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = ((rank_of(pair), i) for i, pair in enumerate(zip(ids, ids[1:])))
        heap = [pair for pair in pairs if pair[0] is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = right[i]
            # a pair that has changed since has an entry of its own
            if ids[i] < 0 or j == n or rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.joined[rank], -1
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (new := rank_of((ids[i], ids[after]))) is not None:
                    heappush(heap, (new, i))
            if (before := left[i]) >= 0 and (new := rank_of((ids[before], ids[i]))) is not None:
                heappush(heap, (new, before))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts with a space between; the vocabulary has no other decoder."""
        return " ".join(self.names[i] for i in ids)

    def encode(self, text: str) -> tuple[int, list[str], list[str]]:
        """Number of tokens, ids and tokens as texts, of a text bounded by white space."""
        n, ids, tokens = 0, [], []
        parts = self.specials.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.special:
                found = [(1, str(self.special[part]), part)]
            else:
                found = list(map(self.__getitem__, self.pieces.findall(_normal(part))))
            if found:
                counts, own_ids, own_tokens = zip(*found)
                n += sum(counts)
                ids += own_ids
                tokens += own_tokens
        return n, ids, tokens


def _normal(text: str) -> str:
    """NFC and lower case, each character by itself."""
    # str.lower looks at a sigma's neighbours
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text: after an ASCII byte whose window's hash is divisible."""
    n = len(data)
    if n <= WINDOW:
        return [n]
    a = np.frombuffer(data, np.uint8)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    wide = a.astype(np.uint64) + np.uint64(1)
    # Horner over the window: each place's hash depends on its own bytes only
    for i in range(WINDOW):
        h = h * np.uint64(_MULTIPLIER) + wide[i : i + len(h)]
    h ^= h >> np.uint64(32)
    ends = np.flatnonzero((h % np.uint64(EVERY) == 0) & (a[WINDOW - 1 :] < 0x80)) + WINDOW
    return [*(e for e in ends.tolist() if e < n), n]


class ChunkEncoder:
    """Encodes whole texts; keeps the encodings of chunks for the next ones."""

    def __init__(self, path: str) -> None:
        self.words = WordEncoder(path)
        self.space = regex.compile(f"[{SPACE}]")
        self.kept: dict[bytes, tuple] = {}
        self.size = 0
        self.made = self.reused = 0

    def chunk(self, data: bytes) -> tuple:
        """Head and tail of a chunk, outside its outermost white space, and its encoding."""
        found = self.kept.get(data)
        if found is not None:
            self.reused += 1
            return found
        self.made += 1
        text = data.decode()
        first = self.space.search(text)
        if first is None:
            return text, None, ""
        tail = self.space.split(text)[-1] if len(text) < 64 else self._after(text)
        body = text[first.start() : len(text) - len(tail)]
        n, ids, tokens = self.words.encode(body)
        found = (text[: first.start()], (n, " ".join(ids), " ".join(tokens)), tail)
        self.size += 2 * len(text) + len(found[1][1]) + len(found[1][2])
        if self.size > KEPT_CHARACTERS:
            self.kept.clear()
            self.size = 0
        self.kept[data] = found
        return found

    def _after(self, text: str) -> str:
        """What follows the last white space."""
        step = 64
        while True:
            parts = self.space.split(text[-step:])
            if len(parts) > 1 or step >= len(text):
                return parts[-1]
            step *= 4

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, ids joined by spaces, decoded text."""
        data = (text or "").encode()
        n, ids, tokens, open_run, at = 0, [], [], [], 0

        def add(found: tuple) -> None:
            nonlocal n
            if found[0]:
                n += found[0]
                ids.append(found[1])
                tokens.append(found[2])

        def close() -> None:
            run = "".join(open_run)
            if run:
                m, i, t = self.words.encode(run)
                add((m, " ".join(i), " ".join(t)))

        for end in cuts(data):
            head, body, tail = self.chunk(data[at:end])
            at = end
            open_run.append(head)
            if body is not None:
                close()
                add(body)
                open_run = [tail]
        close()
        return n, " ".join(ids), " ".join(tokens)


def kept_encoder(path: str) -> ChunkEncoder:
    """The encoder that this worker process keeps from task to task.

    Code that travels with a task has module variables of its own, so a module that
    only holds the encoders stands in for them.
    """
    home = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    encoders = home.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = ChunkEncoder(path)
    return encoders[path]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every document.

    ``vocabulary`` is the path of the tokenizer's file on every machine. A null text is
    empty and has no ids; repeated rows are encoded one by one; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_encoder(vocabulary)
        for batch in batches:
            for part in range(0, batch.num_rows, 50):
                cut = batch.slice(part, 50)
                made = [coder.encode(t) for t in cut.column(1).to_pylist()]
                ids = [np.array(i.split(), np.int32) for _, i, _ in made]
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([d for _, _, d in made], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")


def with_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` and ``n_tokens, ids_sha256, decoded_sha256``; columns of these names go."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    source = docs.drop(*made)
    at = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_encoder(vocabulary)
        for batch in batches:
            for part in range(0, batch.num_rows, _BATCH):
                cut = batch.slice(part, _BATCH)
                n, ids, decoded = [], [], []
                for text in cut.column(at).to_pylist():
                    count, i, d = coder.encode(text)
                    n.append(count)
                    ids.append(hashlib.sha256(i.encode()).hexdigest())
                    decoded.append(hashlib.sha256(d.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [*cut.columns, pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(decoded, pa.string())], [*cut.schema.names, *made])

    return source.mapInArrow(run, StructType([
        *source.schema.fields, StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]))


def token_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_digests(rows, vocabulary).drop("text")
