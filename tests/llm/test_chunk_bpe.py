import hashlib
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from namesmith.llm import chunk_bpe as C

from .common import awkward_rows, docs_table

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"ab cdé'sΣσİſK1²½٣ \t\n\x1c\x85\xa0日本!*$<|>́ß\x00", "<|endoftext|>", "<|startoftext|>",
         "hello", " the", "'ll", "don't", "!!", "é", " ", "　"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)

    return encode


@pytest.mark.parametrize("every", [4, 64, 1024])
def test_equals_the_library_whatever_the_chunks(library, monkeypatch, every):
    monkeypatch.setattr(C, "EVERY", every)
    rng, coder, texts = random.Random(every), C.ChunkEncoder(PATH), []
    for _ in range(1200):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(90)))
        if texts and rng.random() < 0.5:
            text = text[: rng.randrange(20)] + rng.choice(texts) + text[-rng.randrange(1, 9):]
        texts.append(text)
        assert coder.encode(text) == library(text)
    if every < 1024:
        assert coder.reused > 100


def test_texts_without_white_space(library, monkeypatch):
    monkeypatch.setattr(C, "EVERY", 4)
    coder = C.ChunkEncoder(PATH)
    for text in ("x" * 3000, "日本" * 800, "a!" * 900, "é" * 500 + " " + "é" * 500):
        assert coder.encode(text) == library(text)


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(C, "KEPT_CHARACTERS", 50)
    monkeypatch.setattr(C, "KEPT_WORDS", 3)
    rng, coder = random.Random(1), C.ChunkEncoder(PATH)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(60))
        assert coder.encode(text) == library(text)


def test_digests_and_ids(spark, library):
    rows = awkward_rows()
    docs = docs_table(spark, rows, ["n_tokens", "ids"])
    got = sorted(map(tuple, C.token_digest(docs, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        n, ids, decoded = library(t)
        want.append((i, n, *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded))))
    assert got == sorted(want, key=str)
    whole = C.encode_documents(docs, PATH).collect()
    assert sorted(" ".join(map(str, r.ids)) for r in whole) == sorted(library(t)[1] for _, t in rows)
    assert C.with_digests(docs, PATH).columns == [
        *(c for c in docs.columns if c != "n_tokens"), "n_tokens", "ids_sha256", "decoded_sha256"]
    assert C.token_digest(docs_table(spark, []), PATH).collect() == []


def test_long_pieces(library, monkeypatch):
    rng, coder = random.Random(12), C.ChunkEncoder(PATH)
    for n, letters in ((300, "ab"), (700, "theingstr"), (2_000, "aàé日x"), (1_500, "a"), (900, "!?-")):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert coder.encode(text) == library(text)
    monkeypatch.setattr(C, "LONG_PIECE", 1)
    again = C.ChunkEncoder(PATH)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
        assert again.encode(text) == library(text)


def test_a_megabyte_without_white_space():
    rng, coder = random.Random(13), C.ChunkEncoder(PATH)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    start = time.process_time()
    n, ids, decoded = coder.encode(text)
    assert time.process_time() - start < 20  # about 4 s; squares of the length would be hours
    assert len(ids.split()) == n and decoded.replace(" ", "").replace("</w>", "") == text
