"""Every query against its SQL, over the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallystone.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(columns, found):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(float(r[i]), 6)) if isinstance(r[i], float) else repr(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_same_rows(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    want = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_chunks(spark):
    from tallystone.operators.extraction import pack_lines

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    found = catalogue.text_chunks(spark, DIR).collect()
    assert {(r.doc_id, r.chunk_no): r.n_chars for r in found} == {(d, i): len(c) for d, t in texts.items() for i, c in enumerate(pack_lines(t, 2000))}
    assert all("".join(pack_lines(t, 50)) == t for t in texts.values())
    assert pack_lines("aa\nbbbbbb\nc\n", 5) == ["aa\n", "bbbbbb\n", "c\n"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_merge_takes_what_is_needed_once(spark):
    plan = lambda name: catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "'V3'" not in plan("merge_last_wins") and "flags" not in plan("merge_last_wins")
    assert all("l_orderkey" not in plan(name) for name in ("price_deviation", "first_pass_groups", "compare_matrix"))


def test_suppliers_are_sent_and_not_lines(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") % 3).cast("string").alias("supplier_name"), F.col("id").cast("string").alias("item_key"), F.struct("id").alias("first_ord"))
    rows = rows.groupBy("supplier_name", "item_key").agg(F.min("first_ord").alias("first_ord"))
    plans = {}
    for sent in (100_000, 2):
        monkeypatch.setattr(catalogue, "SENT_SUPPLIERS", sent, raising=False)
        out = catalogue._placed(rows)
        assert {(r.supplier_name, r.supplier_ord) for r in out.collect()} == {("0", 0), ("1", 1), ("2", 2)} and out.count() == 5000
        plans[sent] = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plans[100_000] and not any("BuildLeft" in p for p in plans.values()) and "Broadcast" not in plans[2]
