from lexarium.functions.chunking import cut


def parts(spark, text, most):
    rows = cut(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", most).orderBy("part").collect()
    assert [r["part"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["headings"], r["content"]) for r in rows]


def test_headings_and_packing(spark):
    text = "intro\n# A\none\n\ntwo\n### C\ndeep\n## B ##\n" + "x" * 25
    assert parts(spark, text, 10) == [([], "intro"), (["A"], "one\n\ntwo"), (["A", "C"], "deep"), (["A", "B ##"], "x" * 10), (["A", "B ##"], "x" * 10), (["A", "B ##"], "x" * 5)]
    assert parts(spark, "aaaa\n\nbbbb\n\ncc", 8) == [([], "aaaa\n\nbbbb"), ([], "cc")]
    assert parts(spark, "", 8) == [] and parts(spark, "# only", 8) == []
    assert parts(spark, "y" * 12 + "\n\nzz", 8) == [([], "y" * 8), ([], "yyyy\n\nzz")]


def test_heading_stacks(spark):
    text = "### deep first\na\n# top\nb\n###### six\nc\n## two\nd\r\n### three\ne\n# top again\n\n\nf"
    assert parts(spark, text, 50) == [
        (["deep first"], "a"), (["top"], "b"), (["top", "six"], "c"), (["top", "two"], "d"), (["top", "two", "three"], "e"), (["top again"], "f"),
    ]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "# T\nbody"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in cut(docs, "doc_id", "text").collect()] == [(1, 1, ["T"], "body")]
    assert cut(docs.limit(0), "doc_id", "text").count() == 0
