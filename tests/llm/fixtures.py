"""Small tables with what is awkward: nulls, empty and long texts, ties, repeated rows, clashing columns."""

CLASH = "1 AS rid, 2 AS node, 3 AS n, 4 AS part, 5 AS length, 6 AS _id, 7 AS _n, 8 AS _node, 9 AS keys, 10 AS size, 11 AS severity, 12 AS _toxicity_toxic, 13 AS toxic, 14 AS offset, 15 AS shard, 16 AS spans"

ODD_TEXTS = [None, "", " \t\n", "one", "A b  c", "a B c", "naïve café\x85x", "日本語 テキスト", "x" * 5000, "w " * 3000, "é" * 700 + " end", "tab\x01 bell\x07", "<|endoftext|> and <|startoftext|>"]


def documents(spark, texts=ODD_TEXTS, repeat=True):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[-1], (None, "null id", "en", "s", 7), (None, None, None, None, None), (3, "again another text under a known id", "en", "s", 35)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *CLASH.split(", "))


def empty(df):
    return df.where("false")
