import os

import pytest

from lexarium.operators import versions as v
from pyspark.sql import functions as F

SCHEMA = "doc_id long, version_id string, position int, key string, content string"


@pytest.fixture
def store(spark, tmp_path):
    return v.VersionStore(spark, str(tmp_path))


def batch(spark, *docs):
    return spark.createDataFrame([(d, vid, i, k, c) for d, vid, own in docs for i, (k, c) in enumerate(own)], SCHEMA)


def report(df):
    return {r["doc_id"]: tuple(r[c] for c in v.REPORT[2:]) for r in df.collect()}


def active(store):
    return sorted((r["doc_id"], r["version_id"], r["key"], r["content"]) for r in store.active().collect())


def test_two_ingests_reuse_vectors(spark, store):
    first = batch(spark, (1, "1a", [("x", "same"), ("y", "old"), ("z", "gone")]), (2, "2a", [("x", "same")]))
    assert report(store.ingest(first)) == {1: (3, 0, 0, 3, 0, 0, 3), 2: (1, 0, 0, 1, 0, 1, 0)}
    assert report(store.ingest(batch(spark, (1, "1b", [("x", "same"), ("y", "new"), ("w", "more")])))) == {1: (3, 1, 1, 1, 1, 1, 2)}
    assert active(store) == [(1, "1b", "w", "more"), (1, "1b", "x", "same"), (1, "1b", "y", "new"), (2, "2a", "x", "same")]
    told = {r["version_id"]: (r["status"], r["previous_version_id"]) for r in store.versions().collect()}
    assert told == {"1a": ("SUPERSEDED", None), "1b": ("ACTIVE", "1a"), "2a": ("ACTIVE", None)}
    assert store.table("vectors").count() == 5 and store.index().where("size(vector) = 512").count() == 4
    store.compact()
    assert {t: len(b) for t, b in store.catalog()[1].items()} == {"sections": 1, "vectors": 1, "versions": 1}
    assert {r["version_id"]: (r["status"], r["previous_version_id"]) for r in store.versions().collect()} == told
    assert store.index().where("size(vector) = 512").count() == 4


def test_a_version_that_is_not_activated_waits(spark, store):
    store.ingest(batch(spark, (1, "1a", [("x", "a")])))
    store.ingest(batch(spark, (1, "1b", [("x", "b")])), activate=False)
    assert active(store) == [(1, "1a", "x", "a")]
    store.compact()
    store.ingest(batch(spark, (1, "1c", [("x", "c")])))
    assert active(store) == [(1, "1c", "x", "c")]
    assert {r["version_id"]: r["previous_version_id"] for r in store.versions().collect()}["1c"] == "1a"


@pytest.mark.parametrize("bad,said", [
    ([(1, "1a", [("y", "q")])], "version id that exists"), ([(1, "1b", [("x", "a")])], "ingested before"), ([(1, "1b", [("x", "a"), ("x", "b")])], "a key twice"),
    ([(1, "1b", [("x", "a")]), (1, "1c", [("y", "a")])], "two versions"), ([(1, "1b", [("x", None)])], "nulls"), ([(3, "n", [("x", "a")]), (4, "n", [("x", "a")])], "share a version id"), ([], "must hold a section"),
])
def test_a_refused_batch_changes_nothing(spark, store, bad, said):
    store.ingest(batch(spark, (1, "1a", [("x", "a")])))
    before = store.catalog()
    with pytest.raises(v.IngestError, match=said):
        store.ingest(batch(spark, (9, "9a", [("x", "good")]), *bad) if bad else batch(spark, (9, "9a", [("x", "good")])).limit(0))
    assert store.catalog() == before and active(store) == [(1, "1a", "x", "a")]


def test_a_failed_ingest_leaves_the_old_version(spark, store, monkeypatch):
    store.ingest(batch(spark, (1, "1a", [("x", "a")])))

    def broken(*args):
        raise OSError("disk")

    monkeypatch.setattr(v.VersionStore, "_commit", broken)
    with pytest.raises(OSError):
        store.ingest(batch(spark, (1, "1b", [("x", "b")])))
    monkeypatch.undo()
    assert any("batch=000000002" in d for d in os.listdir(f"{store.root}/sections"))
    assert active(store) == [(1, "1a", "x", "a")]
    assert report(store.ingest(batch(spark, (1, "1b", [("x", "b")])))) == {1: (1, 0, 1, 0, 0, 0, 1)}
    assert active(store) == [(1, "1b", "x", "b")]


def test_vectors_of_another_length_are_refused(spark, store):
    store.ingest(batch(spark, (1, "1a", [("x", "a")])))
    store.encode = lambda c: F.array(F.length(c).cast("float"))
    with pytest.raises(v.IngestError, match="2 lengths"):
        store.ingest(batch(spark, (1, "1b", [("x", "b")])))


def test_repeated_texts_may_be_skipped(spark, store):
    store.ingest(batch(spark, (1, "1a", [("x", "a")]), (2, "2a", [("x", "b")])))
    assert report(store.ingest(batch(spark, (1, "1b", [("x", "a")]), (2, "2b", [("x", "c")])), repeated="skip")) == {2: (1, 0, 1, 0, 0, 0, 1)}
