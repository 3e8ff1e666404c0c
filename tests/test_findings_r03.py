"""Cases of the third round of findings: what a query once left out, changed with the order of rows, or held at once."""

import pytest

from lexarium.jobs.catalog import QUERIES
from test_findings import both

PAGES = "page_id long, url string, html string"


def linked(n):
    """Pages of one host that all refer to one target, a thousand times and more."""
    return [(i, f"https://h.example/p{i}", f'<a href="/a.png">say {i}</a><a href="/own{i}.png">own</a>') for i in range(n)]


def test_j07_bears_out_references_beyond_a_thousand_of_a_target(spark, tmp_path):
    assert len(both(spark, tmp_path, "j07_borne_out", pages=(linked(1500), PAGES))) == 1500


def test_j08_has_chunks_of_references_beyond_a_thousand_of_a_target(spark, tmp_path):
    assert len(both(spark, tmp_path, "j08_reviewed_chunks", pages=(linked(1500), PAGES))) == 3000


def test_u21_counts_a_sum_of_exactly_the_budget_as_exhausted(spark, tmp_path):
    values = [49.34, 29.88, 43.11, 43.94, 24.17, 40.07, 54.95, 40.69, 17.08, 56.77]
    assert sum(round(100 * v) for v in values) == 40_000
    rows = [(1, "view", v) for v in values] + [(1, "click", 399.99)]  # added in this order the doubles give 399.99999999999994
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    (row,) = QUERIES["u21_budget_snapshot"](spark, str(tmp_path)).collect()
    assert (row["remaining"], row["exhausted"]) == (0.01, "view")


def test_views_of_many_texts_are_handed_on_in_pieces():
    import pyarrow as pa

    from lexarium.operators import structure

    read = []

    def work(text, n):
        read.append(text)
        yield from ((text * n, i) for i in range(n))

    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5], "text": ["a", None, "b", "c", "d"], "n": [5000, 9, 0, 3, 3000]})
    schema = pa.schema([("k", pa.int64()), ("said", pa.string()), ("i", pa.int32())])
    pieces = structure._pieces(batch, 1, work, schema)
    first = next(pieces)
    assert read == ["a"]
    pieces = [first, *pieces]
    assert max(p.num_rows for p in pieces) <= structure.ROWS_AT_ONCE and max(p.nbytes for p in pieces) < 2 * structure.CHARS_AT_ONCE
    rows = [(r["k"], len(r["said"]), r["i"]) for p in pieces for r in p.to_pylist()]
    assert rows == [(k, n, i) for k, n in ((1, 5000), (4, 3), (5, 3000)) for i in range(n)]


def test_hash_vectors_do_not_depend_on_what_is_counted_with_them(spark, monkeypatch):
    import numpy as np

    from lexarium.functions import text

    def plain(bare):
        """One run after the other."""
        vector = np.zeros(512)
        for width in (1, 2, 3):
            for i in range(len(bare) - width + 1):
                vector[text._bucket_of(bare[i:i + width]) % 512] += 1
        return (vector / (np.sqrt(vector @ vector) or 1)).astype(np.float32)

    texts = ["", "a", "ab", "", "straßen", "日本語の文", "x" * 500, "".join(map(chr, range(0x400, 0x600))), "😀é\ud800"]
    assert np.array_equal(text._bucket_counts(texts), [plain(t) for t in texts])
    monkeypatch.setattr(text, "ALPHABET", 3)
    monkeypatch.setattr(text, "_GRAMS", [])
    assert np.array_equal(text._bucket_counts(texts), [plain(t) for t in texts])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([" a\tb ", None, ""])], "i long, t string")
    got = {r["i"]: np.array(r["v"], np.float32) for r in rows.select("i", text.hash_vector("t").alias("v")).collect()}
    assert all(np.array_equal(got[i], plain(t)) for i, t in enumerate(["ab", "", ""]))
    lengths = rows.select(text.norm(text.hash_vector("t")).alias("n")).collect()
    assert sorted(round(r["n"], 6) for r in lengths) == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("name", ["a04_signals", "d01_sufficiency", "u28_order_fallback"])
def test_tasks_that_sort_lines_are_as_many_as_the_scan_asks_for(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()


def test_tasks_score_slices_of_a_batch(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lexarium.operators import retrieval, scoring

    docs = spark.createDataFrame([(i, f"word{i % 7} common word{i % 3}") for i in range(50)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "word1 common"), (2, "word2 word6")], "qid long, text string")
    terms = retrieval.query_terms(items, "qid", "text").localCheckpoint()
    seen = []
    for rows in (1_000, 3):
        monkeypatch.setattr(scoring, "ROWS_AT_ONCE", rows)
        found = scoring.best_rows(retrieval.hits(docs, ["doc_id"], "text", terms), terms, "doc_id", "qid", 5)
        seen.append(sorted((r["qid"], r["doc_id"], round(r["score"], 9)) for r in found.select("qid", "doc_id", F.col("score")).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 10


def test_texts_are_encoded_once_and_windows_by_their_first_and_last_words():
    import public_tokenizers

    from lexarium.operators import structure

    words = [f"word{'abcdefg'[i % 7]}" + ("\n" if i % 40 == 39 else "") for i in range(3_000)]
    texts = [" ".join(words), "  no\t\tletters 12 34 before  blanks !! " * 60, "x'll don't 漢字 ß a" * 90, "\r\n \n" * 200, "y" * 4_000]
    path, read = public_tokenizers.path("byte_bpe_50k.tiktoken"), [0]
    whole, reads = structure.budget_of(path, public_tokenizers.PATTERN, 64), []

    def windows(parts, text):
        own = structure.Budget(lambda t: read.__setitem__(0, read[0] + len(t)) or whole.encode(t), whole.sizes.token_bytes, 64, parts)
        read[0] = 0
        found = list(own.windows(text, "title", None, 1))
        reads.append(read[0])
        return found

    for t in texts:
        assert windows(True, t) == windows(False, t)
    assert reads[0] < 2 * len(texts[0]) < reads[1]  # else each end that is tried takes the whole window again, after a first look eight times as long


def test_vectors_are_stored_as_one_value_each(spark, tmp_path):
    import math

    from lexarium.functions import text
    from lexarium.operators.versions import IngestError, VersionStore
    from lexarium.sources import artifact
    from pyspark.sql import functions as F

    rows = [(1, [0.5, -2.0]), (2, None), (3, [1.5, None]), (4, []), (5, [float("inf"), 0.0])]
    held = spark.createDataFrame(rows, "i int, v array<float>").coalesce(1).select("i", "v", text.packed("v").alias("p"))
    got = {r["i"]: r for r in held.select("i", "p", text.unpacked("p").alias("u"), text.norm("v").alias("a"), text.norm("p").alias("b"), text.dimensions(held, "v").alias("c"), text.dimensions(held, "p").alias("d")).collect()}
    assert [got[i]["u"] for i in (1, 2, 4, 5)] == [rows[i - 1][1] for i in (1, 2, 4, 5)] and math.isnan(got[3]["u"][1])
    assert [len(got[i]["p"]) for i in (1, 3, 4, 5)] == [8, 8, 0, 8]
    assert all(r["c"] == r["d"] and (r["a"] == r["b"] or math.isnan(r["a"]) and math.isnan(r["b"])) for r in got.values())

    sources = spark.createDataFrame([("a", "some words"), ("b", "others")], "source_id string, text string")
    artifact.build(sources, f"{tmp_path}/index")
    index = artifact.load(spark, f"{tmp_path}/index")
    assert index.stored.schema["vector"].dataType.simpleString() == "binary" and index.vectors.where("size(vector) = 512").count() == 2
    folded = spark.createDataFrame([("ＡßÉ",), ("assé",)], "t string").select(text.hash_vector("t").alias("v")).collect()
    assert folded[0]["v"] == folded[1]["v"]

    store = VersionStore(spark, f"{tmp_path}/store")
    batch = spark.createDataFrame([(1, "1a", 0, "x", "one\t two"), (1, "1a", 1, "y", "one two"), (2, "2a", 0, "x", "three")], "doc_id long, version_id string, position int, key string, content string")
    assert sorted((r["doc_id"], r["total"], r["new_vectors"]) for r in store.ingest(batch).collect()) == [(1, 2, 1), (2, 1, 1)]
    assert all(f.name.startswith("batch=") for f in (tmp_path / "store/vectors").iterdir())  # written once
    assert sorted(r["vector"] for r in store.index(told=text.dimensions).collect()) == [512] * 3
    store.encode = lambda c: F.array(F.lit(float("nan")).cast("float"), F.lit(1.0).cast("float"))
    with pytest.raises(IngestError, match="1 not finite"):
        VersionStore(spark, f"{tmp_path}/other", store.encode).ingest(batch.where("doc_id = 2"))


def test_lines_are_dealt_by_their_number_however_few_files_hold_them(spark, tmp_path, monkeypatch):
    from lexarium.sources import tables

    rows = spark.range(6_000).selectExpr("id DIV 4 AS k", "0 AS c").coalesce(1)
    rows.write.parquet(f"{tmp_path}/rows")
    for most, tasks in ((1_000, 6), (100, 60), (10_000, 2)):
        monkeypatch.setattr(tables, "ROWS_A_TASK", most)
        assert tables.dealt(spark.read.parquet(f"{tmp_path}/rows"), "k").rdd.getNumPartitions() == tasks
    lines = [(1, 1, 1, 0.5), (1, 1, 2, 0.1), (1, None, 3, 0.1), (1, 2, 4, 0.9), (1, 2, 6, 0.2), (2, None, 1, 0.3), (2, None, 2, 0.3)]
    assert len(both(spark, tmp_path, "a04_signals", lineitem=(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_discount double"))) == 2


def test_texts_are_folded_a_piece_of_a_batch_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from lexarium.functions import text

    texts = ["STRAßE Ａ", None, "", "plain", "É́", "日本語"] * 3
    wanted = [t if t is None else text._fold(t) for t in texts]
    for most in (200, 4, 1):
        monkeypatch.setattr(text, "TEXTS_AT_ONCE", most)
        got = text.casefolded.func(pa.array(texts, pa.string()))  # a batch as Arrow has it
        assert got.to_pylist() == wanted
    assert len(text.casefolded.func(pa.array([], pa.string()))) == 0
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.folded(F.col("t")).alias("f"))
    assert [r["f"] for r in sorted(rows.collect())] == wanted


def test_sections_of_a_batch_are_written_once_unless_some_are_left_out(spark, tmp_path):
    from lexarium.operators.versions import IngestError, VersionStore

    schema = "doc_id long, version_id string, position int, key string, content string"
    store = VersionStore(spark, f"{tmp_path}/store")
    folders = lambda: sorted(f.name for f in (tmp_path / "store/sections").iterdir())
    store.ingest(spark.createDataFrame([(1, "1a", 0, "x", "one"), (2, "2a", 0, "x", "two"), (2, "2a", 1, "y", "three")], schema))
    assert len(folders()) == 1 and folders()[0].startswith("batch=")
    again = spark.createDataFrame([(1, "1b", 0, "x", "one"), (2, "2b", 0, "x", "new"), (2, "2b", 1, "y", "three")], schema)
    assert [r["version_id"] for r in store.ingest(again, repeated="skip").collect()] == ["2b"]
    assert sorted((r["version_id"], r["content"]) for r in store.active().collect()) == [("1a", "one"), ("2b", "new"), ("2b", "three")]
    assert store.table("sections").count() == 5 and not any(f.startswith("staged") for f in folders())
    store.compact()
    assert store.table("sections").count() == 5
    with pytest.raises(IngestError, match="1 with two versions"):
        store.ingest(spark.createDataFrame([(3, "3a", 0, "x", "one"), (3, "3b", 1, "y", "two"), (4, "4a", 0, "x", "three")], schema))
    assert store.table("sections").count() == 5
