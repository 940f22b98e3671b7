"""Packing: pieces against the library, places against the rules, sequences against the bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm import packing

from .fixtures import documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sequences(patterns, counts, capacity):
    """How many sequences there are, having checked that they hold the pieces and no more."""
    used, bins = defaultdict(int), 0
    for n, filled in patterns:
        assert n > 0 and sum(x * k for x, k in filled.items()) <= capacity
        bins += n
        for x, k in filled.items():
            used[x] += n * k
    assert used == {x: n for x, n in counts.items() if n}
    return bins


def fewest(items, capacity):
    """The least number of bins, by search; for few items."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                place(i + 1, bins)
                bins[b] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_small_instances():
    rng = random.Random(4)
    extra = 0
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        extra += sequences(packing.solve(counts, 20), counts, 20) - fewest(items, 20)
    assert extra <= 6


def test_reduction_is_safe():
    """What dominance fixes leaves an instance that still packs into the fewest bins."""
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        left = dict(counts)
        fixed = sum(n for n, _ in packing.reduce_by_dominance(left, 20))
        assert fixed + fewest([x for x, n in left.items() for _ in range(n)], 20) == fewest(items, 20)


def at_least(counts, capacity):
    """A lower bound: pieces over a half need sequences of their own, and those under it fill the room beside them."""
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for small in range(1, capacity // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > capacity - small)
        paired = [(x, n) for x, n in counts.items() if capacity / 2 < x <= capacity - small]
        rest = sum(x * n for x, n in counts.items() if small <= x <= capacity / 2)
        room = sum((capacity - x) * n for x, n in paired)
        best = max(best, alone + sum(n for _, n in paired) + max(0, -(-(rest - room) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_large_instances(seed):
    rng = random.Random(seed)
    counts = {x: rng.randint(0, 500) for x in range(1, 1025)}
    bins = sequences(packing.solve(counts, 1024), counts, 1024)
    assert bins <= 1.003 * at_least(counts, 1024)


def check(rows, docs):
    library = Tokenizer.from_file(PATH)
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in spans.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    want = defaultdict(int)
    for doc in docs:
        ids = np.array([*library.encode(doc["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        cut, start = (len(ids) - 1) % 1024 + 1, 0
        for piece in range(-(-len(ids) // 1024)):
            part = ids[start : cut + 1024 * piece]
            want[(doc["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
            start += len(part)
    got = defaultdict(int)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    assert got == want
    return len(spans), -(-sum(r["length"] for r in rows) // 1024)


def test_documents(spark):
    docs = documents(spark).unionByName(documents(spark, ["copy of a text"] * 60 + ["w " * n for n in range(1, 2100, 90)], repeat=False))
    used, least = check(packing.pack_documents(docs.repartition(3), PATH).collect(), docs.collect())
    assert used <= least + 1
    assert packing.pack_documents(empty(docs), PATH).count() == 0
    full = packing.pack_documents(docs.where("doc_id = 8"), PATH, keep_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in full)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used, least = check(packing.pack_documents(docs, PATH).collect(), docs.collect())
    assert used <= 1.01 * least + 1


def test_many_partitions_of_copies(spark):
    """A third of all rows are copies of one text, over 211 partitions: places stay gapless and sequences full."""
    texts = ["the same short text"] * 700 + [" ".join(["word"] * (1 + n % 300)) for n in range(1400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(211)
    used, least = check(packing.pack_documents(docs, PATH).collect(), docs.collect())
    assert used <= 1.01 * least + 1


def test_encoding_alone_loads_no_library():
    coder = packing.loaded.__globals__["Bpe"](PATH)
    assert coder.encode("plain words, vetted") and not {"library", "text_of"} & vars(coder).keys()
    assert coder.encode("日本語") and "library" in vars(coder)
