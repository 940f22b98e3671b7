"""The pipeline's stages, each on what its predecessor kept, against direct versions."""

import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import secrets, toxicity

from .fixtures import documents
from .test_jaccard import brute

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, DIR)
    flagged = {r["doc_id"] for r in toxicity.severities(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("toxic").collect()}
    assert flagged and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - flagged
    assert clean.columns == docs.columns
    clean = clean.where("doc_id < 500")
    single = stages["ngram_jaccard_join"](spark, clean, DIR)
    want = brute([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (n, c) in want.items() if i == c or not n}
    redacted = stages["secret_scans"](spark, single, DIR)
    before = {r["doc_id"]: r for r in single.collect()}
    scanner, changed = secrets.Scanner(), 0
    for r in redacted.collect():
        old = before.pop(r["doc_id"])
        base = scanner.base(old["text"])
        spans = base + scanner.added(old["text"], base)
        assert (r["text"] == old["text"]) == (not spans) and r["n_chars"] == (len(r["text"]) if spans else old["n_chars"])
        changed += bool(spans)
        assert not re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r["text"])
    assert changed and not before
    packed = stages["best_fit_packing"](spark, redacted, DIR).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n"] for r in packed} == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in redacted.collect()}


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.columns[0] == "doc_id"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]


def test_odd_rows(spark):
    docs = documents(spark)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DIR)
        assert kept.columns == docs.columns
    assert kept.count() > 5 and corpus_pipeline.STAGES[-1][1](spark, kept, DIR).count() >= kept.count()
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DIR)
    assert none.count() == 0
