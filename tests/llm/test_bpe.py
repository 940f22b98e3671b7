"""Coding against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import bpe

from .fixtures import documents, empty

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", FILES)
def test_each_token_encodes_to_itself(name):
    """Where this holds, rank-based merging and the file's merges agree (see the module)."""
    coder = bpe.loaded(public_tokenizers.path(name))
    assert coder.fast
    byte_of = bpe._byte_of_char()
    wrong = 0
    for i, token in coder.text_of.items():
        if token in coder.specials:
            continue
        raw = bytes(byte_of[c] for c in token.removesuffix(coder.suffix or "\0"))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue  # a part of a character is no text
        if coder.suffix and token.endswith(coder.suffix) and coder.library.encode(text, add_special_tokens=False).ids == [i]:
            wrong += coder.encode(text) != [i]
        elif not coder.suffix and coder.library.encode(text, add_special_tokens=False).ids == [i]:
            wrong += coder.encode(text) != [i]
    assert wrong == 0


@pytest.mark.parametrize("name", FILES)
def test_any_text(name):
    coder, library = bpe.loaded(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    letters = st.sampled_from(list("aábcdeéßñöÜX'stremd019½ \n\t.,;-_#!?&  ΣσاД日́İ\x01\x7f­"))

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=letters, max_size=60))
    def run(text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)

    run()


def test_words_of_random_letters():
    rng = random.Random(1)
    for name in FILES:
        coder, library = bpe.loaded(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        for _ in range(3000):
            word = "".join(rng.choice("aaabcdeeéfghiilmnnoorsttuy") for _ in range(rng.randint(1, 25)))
            assert coder.encode(word) == library.encode(word, add_special_tokens=False).ids, word


@pytest.mark.parametrize("name", FILES)
def test_documents(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(900))
    texts = [passage, "intro " + passage + " outro", passage[:3000] + "日本語" + passage[3000:], "q" * 20000 + " " + "ab" * 9000, "日" * 9000]
    docs = documents(spark).unionByName(documents(spark, texts, repeat=False))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, path, keep_ids=False).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(empty(docs), path).count() == 0
    kept = bpe.encode_documents(docs.where("doc_id = 4"), path).first()
    assert np.frombuffer(kept["ids"], "<u4").tolist() == library.encode(docs.where("doc_id = 4").first()["text"], add_special_tokens=False).ids or kept["decoded"]


def test_chunks_are_shared_and_joins_mended():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    coder = bpe.ChunkCoder(bpe.loaded(public_tokenizers.path(FILES[0])))
    coder.document(" ".join(words))
    first = coder.encoded
    coder.document("new start " + " ".join(words))
    assert first > 10 and coder.encoded <= first + 2 and coder.hits >= first - 2
    assert coder.mended == 0


@pytest.mark.parametrize("name", FILES)
def test_joins_that_fail_are_mended(name, monkeypatch):
    """With chunks cut anywhere, most joins fail; what is left of them still gives the library's ids."""
    monkeypatch.setattr(bpe, "chunk_ends", lambda data: [*range(50, len(data), 50), len(data)])
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh  ,.'\n") for _ in range(6000))
    coder = bpe.ChunkCoder(bpe.loaded(public_tokenizers.path(name)))
    parts = coder.document(text)
    assert coder.mended > 20 and len(parts) > 5
    assert b"".join(p[1] for p in parts) == np.array(coder.bpe.encode(text), "<u4").tobytes()


@pytest.mark.parametrize("kind", ["letters", "base64", "lines of base64", "CJK", "words of 30,000 letters", "blanks", "4,000,000 letters"])
def test_time_is_linear(kind):
    """Texts of a million characters (four, in the last), where joins are rare or dear: within three times of encoding
    the text at once, and equal."""
    rng = random.Random(8)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    text = {
        "letters": lambda: some("abcdefgh", 1_000_000),
        "base64": lambda: some(alphabet, 1_000_000),
        "lines of base64": lambda: "\n".join(some(alphabet, 76) for _ in range(13_000)),
        "CJK": lambda: some([chr(c) for c in range(0x4E00, 0x4F00)], 1_000_000),
        "words of 30,000 letters": lambda: " ".join(some("abcdefgh", 30_000) for _ in range(33)),
        "blanks": lambda: " " * 999_000 + some("abc ", 1000),
        "4,000,000 letters": lambda: some("abcdefgh", 4_000_000),
    }[kind]()
    coder = bpe.ChunkCoder(bpe.loaded(public_tokenizers.path(FILES[0])))
    coder.bpe.encode("日 warm")
    began = time.perf_counter()
    want = coder.bpe.encode(text)
    decoded = coder.bpe.decode(want)
    at_once = time.perf_counter() - began
    began = time.perf_counter()
    parts = coder.document(text)
    assert time.perf_counter() - began < 3 * at_once + 2
    assert b"".join(p[1] for p in parts) == np.array(want, "<u4").tobytes()
    assert b" ".join(p[2] for p in parts if p[0]).decode() == decoded


def test_small_cache():
    coder = bpe.ChunkCoder(bpe.loaded(public_tokenizers.path(FILES[0])), keep_bytes=2000)
    for i in range(50):
        coder.chunk(f"text {i} " * 20)
    assert coder.size <= 2000
