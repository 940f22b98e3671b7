"""Archives against hashes taken directly."""

import hashlib
from collections import Counter

from corvane.llm import warc

BIG = "x" * 1500
MAGIC = "pre WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nmore"
ROWS = [
    (1, "u", BIG),
    (2, "u v\r\nX: y%", BIG),
    (3, None, BIG),
    (None, "u", BIG),
    (3, None, BIG),
    (4, "a", MAGIC),
    (5, "b", None),
    (6, "b", ""),
    (7, "c", "é\r\n\r\nWARC/1.1\r\n"),
    (7, "c", "x"),
    (8, "d", "WARC/1.1\r\nWARC/1.1\r\n" * 60),
    (9, "d", "WARC/1.1\r\nWARC/1.1\r\n" * 60),
    (10, "e", "short"),
    (11, "e", "short"),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest", "3 AS bytes", "4 AS value", "5 AS file", "6 AS first_id", "7 AS payload")


def check(spark, rows, parts):
    got = warc.deduplicated_archive(table(spark, rows).repartition(parts)).collect()
    most = {}
    for i, _, html in rows:
        if i is not None:
            most[html or ""] = max(most.get(html or "", i), i)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and (html or "") in most and i != most[html or ""]
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", most[html or ""] if again else None)] += 1
    assert Counter(map(tuple, got)) == want


def test_round_trip(spark):
    check(spark, ROWS, 1)
    check(spark, ROWS, 3)


def test_many_records_in_a_file(spark):
    check(spark, [(i, f"u{i}", f"{i} " * (i % 400) + "WARC/1.1\r\n" * (i % 3)) for i in range(300)], 2)


def test_payloads_of_megabytes(spark):
    """Long payloads, copies of them, and magic all through one: read whole from files that are split."""
    long, magic = "é" * 2_000_000, ("text WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60_000)[:2_000_000]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        check(spark, [(1, "a", long), (2, "b", long), (3, "c", magic), (4, "d", "x" * 3_000_000), (5, "e", "")], 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty(spark):
    assert warc.deduplicated_archive(table(spark, ROWS).where("false")).count() == 0


def test_payload_bytes_and_splits(spark, tmp_path):
    path = str(tmp_path / "w")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write_warc(table(spark, ROWS * 5).coalesce(1), path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(ROWS) * 5
    texts = Counter(bytes(r["payload"]).decode() for r in got if r["record_type"] == "response" and "page:4>" in r["record_id"])
    assert texts == {MAGIC: 5}


def test_false_magic_is_not_reached(spark):
    rows = [("f", 0, 100), ("f", 40, 60), ("f", 60, 100), ("f", 100, 150), ("f", 150, 900), ("g", 5, 9)]
    got = warc.verify_chain(spark.createDataFrame(rows, "file string, at long, next long")).collect()
    assert {tuple(r) for r in got} == {("f", 0), ("f", 100), ("f", 150)}
