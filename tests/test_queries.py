"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def _values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(columns), sorted(([tidy(r[i]) for i in order] for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    cursor = duck.execute(SQL[name])
    want = _values([d[0] for d in cursor.description], cursor.fetchall())
    assert _values(got.columns, [tuple(r) for r in got.collect()]) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())


def test_shard_union_covers_every_row(spark, tmp_path):
    rows = [(1, "en"), (2, None), (3, "it"), (4, "en"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["lang"]: (r["n"], r["first"], r["last"]) for r in entry.queries()["shard_union"](spark, str(tmp_path)).collect()}
    assert got == {"en": (2, 1, 4), None: (2, 2, 5), "it": (1, 3, 3), "": (1, 6, 6)}


def test_comparison_report_of_small_deltas(spark, tmp_path):
    """A delta that rounds to zero from below, and rates halfway between two tenths of a per cent."""
    docs = [(i, "en" if i < 4000 else "de", int(i < 2001 or 4000 <= i < 5969)) for i in range(6000)]
    rows = spark.createDataFrame(docs, "doc_id long, lang string, quality int")
    rows.drop("quality").write.parquet(f"{tmp_path}/documents.parquet")
    rows.drop("lang").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()["comparison_report"](spark, str(tmp_path)).collect()]
    assert got == sorted(con.execute(SQL["comparison_report"]).fetchall())
    assert got[:2] == [("1de", f"{'de':<12} {'98.5%':>13} {'98.4%':>15} {'-0.1%':>9}"), ("1en", f"{'en':<12} {'50.0%':>13} {'50.0%':>15} {'-0.0%':>9}")]
