"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Reading does not trust the magic string. Tasks cut the files at every `WARC/1.1` line, wherever it stands, and emit
each cut as a candidate with the offset that its own header names as its successor. Starting from offset 0 of each
file, pointer jumping (each round doubles the steps that a pointer spans) marks the candidates that the chain of
records really reaches; magic inside a payload is not reached and goes back into the payload it was cut from.
All of it is DataFrame operations over byte-exact strings, so payloads need not be valid UTF-8.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT_BYTES = 1000


def _bytes(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary")


def _escaped(c: str) -> Column:
    """A header value on one line: control characters, spaces and per cent signs as %XX."""
    out = F.coalesce(F.col(c), F.lit(""))
    out = F.replace(out, F.lit("%"), F.lit("%25"))
    for n in [*range(33), 127]:
        out = F.replace(out, F.lit(chr(n)), F.lit(f"%{n:02X}"))
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """A WARC file per partition of pages at path, a record per row, in row order.

    Of rows with equal payloads of MIN_REVISIT_BYTES or more, those with the largest id are `response` records and
    the others `revisit` records without payload. A null id counts as the smallest; rows that repeat the largest id
    are all responses, as are groups of null ids only. A null payload is empty, a null url is an empty URI. Empty
    input: no records.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), _escaped(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(_bytes("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    # Written, so that its size is known: the planner broadcasts it below its threshold and else sorts and merges.
    groups = materialize(groups.drop("n"), "warc-groups")
    rows = rows.join(groups, ["digest", "bytes"], "left")
    revisit = F.coalesce((F.col("id") < F.col("first_id")) | (F.col("id").isNull() & F.col("first_id").isNotNull()), F.lit(False))
    name = F.when(F.col("id").isNull(), F.lit("<urn:page:>")).otherwise(F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        name,
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic strings, with file, split, split's start and order in it. The piece before the first
    magic of a file is one of them."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value"),
    )


def _parsed(pieces: DataFrame, derive: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The header fields of each piece, as if it were a record, and what is derived from its payload."""
    head = F.substring_index("value", END, 1)
    field = lambda name: F.regexp_extract("_head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    out = pieces.select("*", F.octet_length("value").cast("long").alias("piece_bytes"), head.alias("_head"))
    out = out.select(
        "*",
        F.expr("try_cast(nullif(regexp_extract(_head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*\\r?$', 1), '') as bigint)").alias("block_bytes"),
        (F.octet_length("_head") + 4).cast("long").alias("head_bytes"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("stated_digest"),
        field("WARC-Target-URI").alias("target_uri"),
    )
    return _with_payload(out, derive)


def _with_payload(rows: DataFrame, derive: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The payload: what follows the HTTP header in the block. Null where the piece is not the whole record."""
    rows = rows.withColumn("_block", F.expr("substring(cast(value as binary), cast(head_bytes + 1 as int), cast(block_bytes as int))"))
    http = F.substring_index(F.col("_block").cast("string"), END, 1)
    payload = F.expr("substring(_block, octet_length(_http) + 5, length(_block))")
    rows = rows.withColumn("_http", http).withColumn("http_bytes", F.expr("try_cast(nullif(regexp_extract(_http, '(?im)^Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*\\r?$', 1), '') as bigint)"))
    return rows.withColumns({k: f(payload) for k, f in derive.items()}).drop("_block", "_http", "_head")


def verify_chain(candidates: DataFrame) -> DataFrame:
    """Of candidates (file, at, next), those reachable from `at` = 0 of their file, as (file, at).

    Pointer jumping: after round k a pointer spans 2^k records, and a mark goes along it; so a file of m candidates
    takes log2 m rounds. Each round is written out, so that its plan doesn't grow and a lost executor repeats none.
    """
    longest = candidates.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    at = candidates.select("file", "at", "next", (F.col("at") == 0).alias("reached"))
    for step in range(max(0, math.ceil(math.log2(longest + 1)))):
        if step:
            at = materialize(at, "warc-jump")
        ahead = at.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        moved = at.join(ahead, ["file", "next"], "left").select("file", "at", F.col("after").alias("next"), "reached")
        marks = at.where("reached and next is not null").select("file", F.col("next").alias("at"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("reached"))
        # A mark on an offset where no candidate begins has no row of its own kind and goes.
        at = moved.withColumn("own", F.lit(True)).unionByName(marks.withColumn("own", F.lit(False))).groupBy("file", "at").agg(F.max("next").alias("next"), F.max("reached").alias("reached"), F.max("own").alias("own")).where("own").drop("own")
    return at.where("reached").select("file", "at")


def read_warc(spark: SparkSession, path: str, derive: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A row per record: file, at, record_type, record_id, refers_to, stated_digest, target_uri, http_bytes, and for
    each entry of derive (default: the payload itself) that function of the payload, binary. Derived columns are made
    in the scan, so that a digest is shuffled and not the payload. An empty folder gives no rows; a file whose first
    bytes aren't a record gives none.
    """
    derive = derive or {"payload": lambda p: p}
    pieces = _pieces(spark, path)
    parsed = _parsed(pieces, derive)
    narrow = materialize(parsed.drop("value"), "warc-pieces")
    # Offsets: pieces tile a file, so a piece starts where those before it end. First within a split, then over splits.
    step = F.col("piece_bytes") + len(MAGIC)
    within = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = narrow.groupBy("file", "split").agg(F.sum(step).alias("_bytes")).select("file", "split", F.coalesce(F.sum("_bytes").over(over), F.lit(0)).alias("_before"))
    placed = narrow.withColumn("_in", F.coalesce(F.sum(step).over(within), F.lit(0))).join(splits, ["file", "split"])
    # `at`: the offset of the magic in front of the piece; the first piece of a file has none and comes at -len(MAGIC).
    placed = placed.withColumn("at", F.col("_before") + F.col("_in") - len(MAGIC)).withColumn("next", F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("block_bytes") + len(END)).drop("_in", "_before")
    placed = materialize(placed, "warc-placed")
    reached = verify_chain(placed.where("at >= 0 and next is not null").select("file", "at", "next"))
    records = placed.join(reached, ["file", "at"])
    # Magic in a payload leaves a record's last piece short of its end, or the file's last record at its end + MAGIC.
    whole = F.col("at") + len(MAGIC) + F.col("piece_bytes") >= F.col("next")
    kept = ["file", "at", "record_type", "record_id", "refers_to", "stated_digest", "target_uri", "http_bytes", *derive]
    cut = materialize(records.where(~whole).select("file", "at", "next"), "warc-cut")
    if cut.isEmpty():
        return records.select(*kept)
    # Put cut records together again: their pieces are those from `at` up to `next`, found block by block of offsets.
    block = 1 << 20
    spans = cut.withColumnsRenamed({"at": "record", "next": "until"}).withColumn("_block", F.explode(F.sequence((F.col("record") / block).cast("long"), (F.col("until") / block).cast("long"))))
    inside = placed.where("at >= 0").select("file", "split", "seq", "at", (F.col("at") / block).cast("long").alias("_block")).join(spans, ["file", "_block"]).where("at >= record and at < until")
    texts = pieces.join(inside.select("file", "split", "seq", "at", "record"), ["file", "split", "seq"])
    joined = texts.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]), MAGIC).alias("value"))
    mended = joined.select("file", F.lit(0).cast("long").alias("split"), F.lit(0).cast("long").alias("seq"), "value", F.col("record").alias("at"))
    return records.where(whole).select(*kept).unionByName(_parsed(mended, derive).select(*kept))


def deduplicated_archive(pages: DataFrame) -> DataFrame:
    """Write pages as WARC, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response come from the payload read; those of a revisit from its header fields. Rows in
    any number per page_id give as many rows. Columns of pages beside page_id, url and html play no part.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    got = read_warc(spark, path, {"_digest": F.sha1, "_bytes": lambda p: F.length(p).cast("long")})
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1), '') as bigint)")
    revisit = F.col("record_type") == "revisit"
    return got.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("stated_digest", ":", -1)).otherwise(F.col("_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
