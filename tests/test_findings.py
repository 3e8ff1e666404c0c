"""Cases in which a query and its SQL once gave something else; both must agree on each."""

import datetime

import duckdb
import pytest

from lexarium.jobs.catalog import ORACLE_SQL, QUERIES
from test_queries import table


def both(spark, path, name, **tables):
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(path))
    got, want = table(df.columns, df.collect()), con.sql(ORACLE_SQL[name])
    assert got == table(want.columns, want.fetchall())
    return [r.asDict() for r in QUERIES[name](spark, str(path)).collect()]


DOCS, ITEMS = "doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string"


def test_a10_finds_items_that_end_within_words(spark, tmp_path):
    docs = [(1, "this is wonderfully made", "en", "s", 24), (2, "日本語の文", "ja", "s", 5), (3, None, "en", "s", 0), (4, "is wonderful is wonderful", "en", "s", 25)]
    items = [(1, "is wonderful"), (2, "日本"), (3, ""), (4, "not there"), (5, "日本"), (6, None)]
    got = {r["item_id"]: r["holders"] for r in both(spark, tmp_path, "a10_answerable", documents=(docs, DOCS), benchmark=(items, ITEMS))}
    assert got == {1: 2, 2: 1, 3: 3, 4: 0, 5: 1, 6: 0}


def test_j14_compares_short_lines_of_any_beginning(spark, tmp_path):
    docs = [(1, "short\nsame", "en", "s", 10), (2, "other\nsame", "en", "s", 10), (3, "short\nthird", "en", "s", 11), (4, "other", "en", "t", 5)]
    (row,) = both(spark, tmp_path, "j14_consistency_self_join", documents=(docs, DOCS))
    assert row == {"lang": "en", "pairs": 4, "s": 6}


def test_u05_keeps_a_good_row_behind_a_bad_one(spark, tmp_path):
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    rows = [(1, 5, "P", 1.0, "1-URGENT"), (8, 5, "O", 1.0, "1-URGENT"), (15, 5, "O", 1.0, "2-HIGH"), (2, 6, None, 1.0, "1-URGENT"), (3, 7, "O", 1.0, "1-URGENT")]
    got = {r["o_custkey"]: (r["kept"], r["rejected"], r["status"]) for r in both(spark, tmp_path, "u05_advice", orders=(rows, schema))}
    assert got == {5: (1, 1, "NO_SUMMARY"), 6: (0, 1, "ABSTAINED"), 7: (1, 0, "OK")}


def test_q11_returns_one_row_whole(spark, tmp_path):
    t = [datetime.datetime(2024, 1, d) for d in (1, 2)]
    rows = [(9, t[0], 1, "a", 5.0), (3, t[1], 1, "a", 7.0), (4, t[1], 2, "b", 1.0), (5, t[1], 2, "b", 2.0)]
    got = {r["user_id"]: (r["event_id"], r["payload"]) for r in both(spark, tmp_path, "q11_upsert", events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"))}
    assert got == {1: (3, 7.0), 2: (5, 2.0)}


@pytest.mark.parametrize("chars", [3, 4_000_000])
def test_containment_in_blocks(spark, monkeypatch, chars):
    from lexarium.operators import containment

    monkeypatch.setattr(containment, "BLOCK_CHARS", chars)
    texts = spark.createDataFrame([("abcabc",), ("xbc",), (None,), ("",)], "body string")
    wanted = spark.createDataFrame([(1, "abc"), (2, "bc"), (3, ""), (4, "zz"), (5, "bc"), (6, None)], "k long, w string")
    got = {r["k"]: r["holders"] for r in containment.holders(texts, "body", wanted, "k", "w").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 5: 2}


def test_texts_held(spark):
    from lexarium.operators import containment

    rows = spark.createDataFrame([(1, "Abcabc"), (2, "xbc"), (3, None), (4, "")], "i long, body string")
    got = {r["i"]: r["w"] for r in containment.with_held(rows, "body", ["bc", "abc", "zz", "bc"], "w", lower=True).collect()}
    assert got == {1: ["abc", "bc"], 2: ["bc"], 3: None, 4: []}
    assert {tuple(r["w"] or ()) for r in containment.with_held(rows, "body", [], "w").collect()} == {()}
