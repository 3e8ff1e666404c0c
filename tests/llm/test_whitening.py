import random

import numpy as np
import pytest

from lexarium.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v int"


def plain(vectors):
    """deviation, eigenvalues and whitened rows by whole matrices."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = x - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return deviation, e, centred @ u[:, :8] / np.sqrt(e[:8])


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(w, "BLOCK_BYTES", 8 * 12 * 7)  # seven rows of 12 doubles


def test_equals_plain_matrices(spark, tmp_path, small_blocks):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(230, 12)) @ rng.normal(size=(12, 12)) * 0.1).astype(np.float32).tolist()
    rows = [(i, v, i % 3, "a", 1) for i, v in enumerate(good)]
    rows += [(0, good[0], None, None, None), (None, good[1], 1, "x", 2)]  # a repeated row, a null id
    bad = [(900, None, 1, "", 1), (901, [None] * 12, 1, "", 1), (902, [float("nan")] + [0.0] * 11, 1, "", 1), (903, [float("inf")] * 12, 1, "", 1), (904, [], 1, "", 1), (905, [0.5] * 3, 1, "", 1), (906, [1e30] * 12, 1, "", 1)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows + bad, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = w.op13_whitening(spark, str(tmp_path)).collect()
    deviation, e, z = plain([r[1] for r in rows])
    assert len(out) == 8 * len(rows) and {r["n"] for r in out} == {len(rows)}
    got = {}
    for r in out:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["deviation"] == r["deviation_exact"] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
    sign = {}
    for (i, *_), dev, own in zip(rows, deviation, z):
        for c in range(8):
            for value in got[i, dev][c + 1]:
                sign.setdefault(c, np.sign(value * own[c]))
                assert value == pytest.approx(sign[c] * own[c], abs=1e-7)


def test_few_rows_and_none(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert w.op13_whitening(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(1, [0.5, 0.25], 1, "", 1)], SCHEMA).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    out = w.op13_whitening(spark, f"{tmp_path}/b").collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(out)] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    spark.createDataFrame([(1, [0.5, 0.25], 1, "", 1), (2, [0.0, 0.25], 1, "", 1), (3, [0.1, 0.25], 1, "", 1)], SCHEMA).write.parquet(f"{tmp_path}/c/embeddings.parquet")
    out = w.op13_whitening(spark, f"{tmp_path}/c").collect()
    assert {r["explained"] for r in out} == {0.0, 1.0} and max(r["identity_error"] for r in out) < 1e-12
    assert all((r["whitened"] == 0) == (r["component"] == 2) for r in out)


def test_wide_numbers_stay_exact():
    x = np.array([[1 << 40, 3], [-(1 << 40), 7]], dtype=np.int64)
    n, sums = 1 << 30, [5 << 60, 11]
    _, deviation = w.deviations(x, n, sums)
    assert deviation == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
