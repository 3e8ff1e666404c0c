"""Rules of support on tables small enough to read."""

import pytest

from lexarium.jobs.catalog import QUERIES


@pytest.fixture()
def given(spark, tmp_path):
    def write(name, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_new_evidence_reads_whole_texts(spark, given):
    start = "a greeting that is longer than thirty characters, "
    rows = [(1, 0, "user", start + "one two"), (1, 1, "user", start + "three"), (1, 2, "user", start + "three"), (1, 3, "user", start + "one"), (2, 0, "user", None), (2, 1, "user", None)]
    folder = given("conversations", "conv_id long, turn long, role string, text string", rows)
    assert sorted(map(tuple, QUERIES["x21_new_evidence"](spark, folder).collect())) == [(1, 1), (2, 1)]
    assert [(r.conv_id, r.turn) for r in QUERIES["x22_new_relevant_evidence"](spark, folder).collect()] == [(1, 1)]


def test_adjacent_pages(spark, given):
    urls = ["http://a.org/x/3", "http://a.org/y/4?z=1", "http://a.org/4", "http://a.org/6#top", "http://b.org/9", "http://b.org/none", None]
    folder = given("pages", "page_id long, url string, html string", [(k, u, None) for k, u in enumerate(urls)])
    assert sorted(map(tuple, QUERIES["a05_adjacent_pages"](spark, folder).collect())) == [("a.org", 3, 1), ("b.org", 1, 0)]


def test_answer_support(spark, given):
    rows = [(1, "red green blue\nblue green red", "en", "s", 0), (2, "red green\nred", "de", "s", 0), (3, "red\nnone", "en", "s", 0), (4, None, "en", "s", 0), (5, "red\nred", None, "s", 0)]
    folder = given("documents", "doc_id long, text string, lang string, source string, n_chars long", rows)
    given("labels", "doc_id long, quality int, toxic int", [(1, 1, 0)])
    found = {r.doc_id: (r.matched, r.total, r.level) for r in QUERIES["r18_answer_support"](spark, folder).collect()}
    assert found == {1: (3, 3, "strong"), 2: (1, 2, "partial"), 3: (0, 1, "limited"), 4: (0, 0, "limited"), 5: (1, 1, "partial")}


def test_order_from_outside_must_name_each_once(spark, given):
    lines = [(1, 1, 3, 0), (1, 2, 2, 0), (1, 3, 4, 0), (2, 1, 2, 0), (2, 2, 4, 0)]
    folder = given("lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", lines)
    found = sorted((r.l_orderkey, r.place, r.l_partkey, r.status) for r in QUERIES["u28_order_fallback"](spark, folder).collect())
    assert found == [(1, 1, 3, "accepted"), (1, 2, 4, "accepted"), (1, 3, 2, "accepted"), (2, 1, 2, "fallback"), (2, 2, 4, "fallback")]
