"""What the findings of round 4 were about."""

import math
import struct

import pyarrow.parquet as pq
import pytest

from lexarium.operators.versions import VersionStore

SCHEMA = "doc_id long, version_id string, position int, key string, content string"
FIRST = [(1, "1a", 0, "x", "one"), (2, "2a", 0, "x", "two"), (2, "2a", 1, "y", "three")]
SECOND = [(1, "1b", 0, "x", "one"), (2, "2b", 0, "x", "new"), (2, "2b", 1, "y", "three")]


def held(root, table):
    """Rows in each folder of a table, without those that have none."""
    rows = {d.name: sum(pq.read_metadata(f).num_rows for f in d.glob("*.parquet")) for d in (root / table).iterdir()}
    return {name: n for name, n in rows.items() if n}


def test_what_a_store_needs_no_more_takes_no_disk(spark, tmp_path):
    store = VersionStore(spark, f"{tmp_path}/store")
    store.ingest(spark.createDataFrame(FIRST, SCHEMA))
    report = store.ingest(spark.createDataFrame(SECOND, SCHEMA), repeated="skip")
    assert [tuple(r)[1:] for r in report.collect()] == [("2b", 2, 1, 1, 0, 0, 1, 1)]
    assert [sorted(held(tmp_path / "store", t).values()) for t in ("sections", "vectors", "versions")] == [[2, 3], [1, 3], [1, 2]]  # neither the sections as they came, nor what was told of them
    assert all(f.name.endswith(".zstd.parquet") for t in ("sections", "vectors", "versions", "reports") for f in (tmp_path / "store" / t).glob("*/*.parquet") if pq.read_metadata(f).num_rows)
    state = lambda: sorted(tuple(r) for r in store.active().select("version_id", "content", "chunk_id").collect())
    before, (_, batches) = state(), store.catalog()
    store.vacuum()  # no batch has been given up yet
    assert state() == before and store.catalog()[1] == batches
    store.compact(["sections"])
    assert {t: len(b) for t, b in store.catalog()[1].items()} == {"sections": 1, "vectors": 2, "versions": 2} and len(held(tmp_path / "store", "sections")) == 3
    store.vacuum()
    assert list(held(tmp_path / "store", "sections").values()) == [5] and len(held(tmp_path / "store", "vectors")) == 2 and state() == before
    pending = store._written("vectors", "000000004-another", store.table("vectors"), "batch")  # of a writer that has not committed
    store.compact(["vectors", "versions"])
    store.vacuum()
    assert pending.count() == 4 and sorted(held(tmp_path / "store", "vectors").values()) == [4, 4] and state() == before
    assert {r["version_id"]: r["status"] for r in store.versions().collect()} == {"1a": "ACTIVE", "2a": "SUPERSEDED", "2b": "ACTIVE"}
    assert store.index().where("size(vector) = 512").count() == 3


def test_u37_leaves_one_folder_of_each_table(spark, tmp_path, monkeypatch):
    from lexarium.jobs import stores

    monkeypatch.setattr(stores, "shared", lambda spark, name: f"{tmp_path}/store")
    served = stores.u37_store_index(spark, "/root/testdata/sf0.001")
    assert [len(held(tmp_path / "store", t)) for t in ("sections", "vectors", "versions")] == [1, 1, 1]
    vectors = spark.read.parquet(*[str(d) for d in (tmp_path / "store/vectors").iterdir() if d.name in held(tmp_path / "store", "vectors")])
    assert vectors.selectExpr("max(octet_length(vector.levels) + octet_length(vector.places))").first()[0] < 4 * 512
    assert served.where("vectors = sections").count() == served.count() > 0


def test_vectors_are_stored_by_their_different_entries(spark, monkeypatch):
    from lexarium.functions import text

    floats = [[0.5, -2.0], None, [1.5, None], [], [math.inf, 0.0, -0.0, math.nan], [float(i) for i in range(300)], [float(i % 256) for i in range(301)], [0.25, 0.0, 0.25, 0.5]]
    rows = spark.createDataFrame(list(enumerate(floats)), "i int, v array<float>").coalesce(1)
    for most in (200, 1):
        monkeypatch.setattr(text, "TEXTS_AT_ONCE", most)
        stored = rows.select("i", text.leveled("v").alias("s"), text.packed("v").alias("p"))
        got = sorted(stored.select("i", "s", "p", text.unleveled("s").alias("u"), text.dimensions(stored, "s").alias("d"), text.dimensions(stored, "p").alias("e")).collect(), key=lambda r: r["i"])
        assert all(r["p"] == r["u"] and r["d"] == r["e"] for r in got)
        assert [r["s"] and (len(r["s"]["levels"]), r["s"]["places"] and len(r["s"]["places"])) for r in got] == [(8, 2), None, (8, 2), (0, b""), (16, 4), (1200, None), (4 * 256, 301), (12, 4)]
    assert struct.unpack("<4f", got[7]["u"]) == tuple(floats[7])


@pytest.mark.parametrize("most", [0, 10])
def test_keys_beyond_the_bound_are_shuffled(spark, tmp_path, monkeypatch, most):
    from lexarium.operators import versions

    monkeypatch.setattr(versions, "IDS", most)
    monkeypatch.setattr(versions, "HASHES", most)
    store = VersionStore(spark, f"{tmp_path}/store")
    store.ingest(spark.createDataFrame(FIRST, SCHEMA))
    store.ingest(spark.createDataFrame(SECOND, SCHEMA), repeated="skip")
    assert sorted(tuple(r) for r in store.active().select("version_id", "content").collect()) == [("1a", "one"), ("2b", "new"), ("2b", "three")]
    assert store.index().count() == 3


def test_joins_with_an_empty_store_move_nothing(spark, tmp_path, capsys):
    store = VersionStore(spark, f"{tmp_path}/store")
    rows = spark.range(9).selectExpr("id AS doc_id", "'k' AS key", "unhex('00') AS content_hash")
    rows.join(store.table("vectors").select("content_hash"), "content_hash", "left_anti").explain()
    rows.join(store.active(), ["doc_id", "key"], "full_outer").explain()
    assert "Exchange" not in capsys.readouterr().out
