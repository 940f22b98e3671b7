"""Byte-pair encoding as the tokenizers library does it, with chunks that documents share encoded once.

Encoder: merges run in a rank-based encoder built from the tokenizer file; it gives the library's ids at several
times its speed. The two agree wherever each token of the vocabulary encodes to itself (a test holds this), as a merge
of adjacent parts to a token can then only be that token's own last merge. Texts with characters beyond a vetted
range (Latin letters and common punctuation), control characters or special tokens go to the library itself.

Chunk reuse: a rolling hash over the bytes sets chunk ends by content, so copied passages give the same chunks
wherever they stand. Documents are exchanged by their least chunk hash, which brings those with common chunks
together, and each task encodes a chunk once. At each join of chunks, the text around it is encoded across the join
and compared with the parts; where they differ, the chunks merge and are encoded as one, so that all joins left agree
exactly. Chunks end before words only, so a text without blanks is one chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters for which every Unicode version and regex engine in play agrees on letters, numbers and white space.
_UNVETTED = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧]")
_MARK = "\x01"
#: Fixed value: the public pre-tokenizing pattern of the byte-level vocabulary.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _class_of(kinds: str) -> str:
    """A regex class body for the vetted characters whose category begins with one of kinds."""
    return "".join(re.escape(chr(c)) for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x2010, 0x2028)] if unicodedata.category(chr(c))[0] in kinds)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """encode(text) and decode(ids) of a tokenizer file. `fast` is off where the file isn't of a kind known here. What
    only some callers need, the library's tokenizer and the texts of ids, is loaded when it is first asked for."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.joined_by_blanks = spec["decoder"] is None
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        byte_of = _byte_of_char()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ordered = all(model["vocab"].get("".join(m)) == len(model["vocab"]) - len(merges) + i for i, m in enumerate(merges))
        self.fast = None
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        pre = json.dumps(spec["pre_tokenizer"])
        if ordered and plain and not self.suffix and spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items()}
            self.fast = tiktoken.Encoding("bytes", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        elif ordered and plain and self.suffix and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pre:
            ranks = {}
            for t, i in model["vocab"].items():
                if t.endswith(self.suffix):
                    ranks[bytes(byte_of[c] for c in t[: -len(self.suffix)]) + _MARK.encode()] = i
                else:
                    ranks[bytes(byte_of[c] for c in t)] = i
            # A word's end is a byte that vetted text hasn't; its merge with the last byte ranks before all others.
            enc = tiktoken.Encoding("words", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            letters, numbers = _class_of("L"), _class_of("N")
            words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t\n\r {letters}{numbers}]+").findall
            self.fast = lambda text: enc(_MARK.join(words(text.lower())) + _MARK) if text and not text.isspace() else []

    @cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def text_of(self) -> dict[int, str]:
        return {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}

    def encode(self, text: str) -> list[int]:
        if self.fast and not _UNVETTED.search(text) and not any(s in text for s in self.specials):
            return self.fast(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        if self.joined_by_blanks:
            return " ".join(map(self.text_of.__getitem__, ids))
        return self.library.decode(ids, skip_special_tokens=False)


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GEAR = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(data: bytes, mean_words: int = 128) -> list[int]:
    """Ends of content-defined chunks, the last of them len(data). A chunk ends before the last blank before a word if
    the hash of the eight bytes up to that blank is 0 modulo mean_words, so ends depend on nine bytes only. A stretch
    without blanks is never cut: its parts could only be joined again by encoding all of it."""
    n = len(data)
    if n < 64:
        return [n] if n else []
    a = np.frombuffer(data, dtype=np.uint8)
    eight = np.ndarray((n - 8,), dtype="<u8", buffer=data, strides=(1,))
    blank = _BLANK[a]
    at = np.flatnonzero(blank[7:-1] & ~blank[8:])
    hashed = (eight[at] * _GEAR) >> np.uint64(40)
    return [*(at[hashed % np.uint64(mean_words) == 0] + 7).tolist(), n]


_WORD_BREAK = re.compile(r"[\t\n\r ](?=[^\s])")
_REACH = 1024


def _around(text: str, at: int, least: int = 24) -> tuple[str, str]:
    """The text on either side of a join: at least so many characters, on to where a word starts (on the left before
    its blank); where none does within _REACH characters, that many. Merges stay inside words, and whether a word goes
    across the join shows within its nearest characters."""
    first = max(0, at - _REACH)
    breaks = [m.start() for m in _WORD_BREAK.finditer(text, first, max(first, at - least))]
    while not breaks and first and first < at and unicodedata.combining(text[first]):
        first += 1
    m = _WORD_BREAK.search(text, at + least, at + _REACH)
    return text[breaks[-1] if breaks else first : at], text[at : m.start() if m else at + _REACH]


class ChunkCoder:
    """Encodes documents by chunks, and keeps what it has encoded, up to so many bytes."""

    def __init__(self, bpe: Bpe, keep_bytes: int = 48 << 20):
        self.bpe, self.keep_bytes = bpe, keep_bytes
        self.known: OrderedDict[str, tuple[list[int], bytes, bytes]] = OrderedDict()
        self.size = self.hits = self.encoded = self.mended = 0

    def chunk(self, text: str) -> tuple[int, bytes, bytes]:
        """The number of ids, the ids as little-endian 32-bit integers, the decoded text."""
        got = self.known.get(text)
        if got is not None:
            self.hits += 1
            self.known.move_to_end(text)
            return got
        ids = self.bpe.encode(text)
        got = (len(ids), np.array(ids, dtype="<u4").tobytes(), self.bpe.decode(ids).encode("utf-8") if self.bpe.joined_by_blanks else b"")
        self.encoded += 1
        self.known[text] = got
        self.size += 2 * len(text) + len(got[1]) + len(got[2]) + 300
        while self.size > self.keep_bytes:
            old, gone = self.known.popitem(last=False)
            self.size -= 2 * len(old) + len(gone[1]) + len(gone[2]) + 300
        return got

    def agrees(self, text: str, at: int) -> bool:
        """Whether encoding across the join gives what the parts give."""
        a, b = _around(text, at)
        return self.bpe.encode(a + b) == self.bpe.encode(a) + self.bpe.encode(b)

    def parts(self, text: str) -> Iterator[str]:
        """The chunks; those whose join fails become one. Joins are checked in the text itself, each once, so the time
        is in proportion to the text's length whatever fails."""
        data = text.encode("utf-8", "surrogatepass")
        at, upto, since = 0, 0, 0  # in bytes; in characters; where the open chunk begins
        for end in chunk_ends(data):
            if upto > since:
                if self.agrees(text, upto):
                    yield text[since:upto]
                    since = upto
                else:
                    self.mended += 1
            upto += end - at if len(data) == len(text) else len(data[at:end].decode("utf-8", "surrogatepass"))
            at = end
        if upto > since:
            yield text[since:upto]

    def document(self, text: str) -> list[tuple[int, bytes, bytes]]:
        return [self.chunk(p) for p in self.parts(text)]


def least_chunk_hash(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with `_least`, the least hash of a document's chunks; null for null and empty texts."""
    schema = docs.select("*", F.lit(None).cast("long").alias("_least")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                at, hashes = 0, []
                for end in chunk_ends(data):
                    hashes.append(int.from_bytes(hashlib.blake2b(data[at:end], digest_size=8).digest(), "little", signed=True))
                    at = end
                least.append(min(hashes, default=None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "_least"])

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids (little-endian 32-bit integers) and
    decoded text, of each row of docs.

    Null and empty texts have no ids and the digests of nothing. Rows of any doc_id, null or repeated, come out once
    each. Columns beside doc_id and text play no part. Empty input: no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkCoder(loaded(path))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                parts = coder.document(text.as_py() or "")
                n = sum(p[0] for p in parts)
                digest = hashlib.sha256()
                for p in parts:
                    digest.update(p[1])
                if coder.bpe.joined_by_blanks:
                    decoded = b" ".join([p[2] for p in parts if p[0]])
                else:
                    decoded = coder.bpe.decode(np.frombuffer(b"".join(p[1] for p in parts), dtype="<u4").tolist()).encode("utf-8")
                row = [doc_id.as_py(), n, digest.hexdigest(), hashlib.sha256(decoded).hexdigest()]
                out.append(row + [b"".join(p[1] for p in parts), decoded.decode("utf-8")] * keep_ids if keep_ids else row)
                if len(out) >= 256:
                    yield _batch(out, keep_ids)
                    out = []
            if out:
                yield _batch(out, keep_ids)

    keyed = least_chunk_hash(docs.select("doc_id", "text"), "text")
    # Rebalanced, so that a group of copies larger than a partition is split over several.
    return keyed.hint("rebalance", "_least").sortWithinPartitions("_least").select("doc_id", "text").mapInArrow(run, schema)


def _batch(rows: list[list], keep_ids: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary(), pa.string()] * keep_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
