import numpy as np
import pytest

from lexarium.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, key string, run long, v int"


def plain(rows):
    """All pairs of each anchor, by whole lists."""
    kept = []
    for vec_id, e, label, *_ in rows:
        if vec_id is None or label is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in e)))
    out = []
    for a, la, va in dict.fromkeys(r for r in kept if r[0] % 100 == 0):
        meet = [(-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in kept if i != a and len(v) == len(va)]
        for ps, p, _ in sorted(m for m in meet if m[2] == la)[:5]:
            low = sorted(m for m in meet if m[2] != la and 80 * -ps <= 100 * -m[0] <= 100 * -ps)
            out += [(a, p, k, i, -ps, -s) for k, (s, i, _) in enumerate(low[:5], 1)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("RUN_BLOCKS", 3), ("PAGE_BLOCKS", 5), ("ANCHORS_A_TILE", 2), ("BATCH", 3)):
        monkeypatch.setattr(h, name, value)


def got(spark, path, rows):
    spark.createDataFrame([(*r[:3], "a", 1, 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, h.op12_hard_negatives(spark, str(path)).collect()))


def test_equals_all_pairs(spark, tmp_path, small):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.3).round(2).tolist(), int(rng.integers(0, 4))) for i in range(430)]
    rows += [(i, [0.5] * 8, i % 3) for i in range(1000, 1101)]  # one vector in a third of the rows
    rows += [(2000 + i, rng.normal(size=3).tolist(), i % 2) for i in range(40)]  # another length
    rows += [(3000, None, 1), (3001, [None] * 8, 1), (3100, [float("nan")] * 8, 1), (3200, [1.0] * 8, None), (None, [1.0] * 8, 1), (3300, [], 1), (100, rows[100][1], rows[100][2])]
    want = plain(rows)
    assert len(want) > 100 and got(spark, tmp_path, rows) == want


def test_zone_maps_leave_blocks_unread(spark, small, monkeypatch):
    monkeypatch.setattr(h, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 4
    rows = [(i, int(rng.integers(0, 3)), np.floor(256 * (centres[i % 20] + rng.normal(size=8) * 0.01)).astype(int).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>").withColumn("anchor", h.F.col("vec_id") == 100)
    at = h.keyed(df, -5000, 5000).repartitionByRange(1, "key", "vec_id", "label").sortWithinPartitions("key", "vec_id").drop("key")
    blocks = h.in_blocks(at, np.float64, 5)
    zones = blocks.where("lo IS NOT NULL")
    anchors = blocks.where("anchor").selectExpr("rid", "vec_id", "label", "v", "array(home) AS lows", f"array({h.FAR}L) AS highs")
    chosen = h.choose(zones, anchors, 1, True, np.float64).collect()
    assert 0 < sum(r["mask"].bit_count() for r in chosen) < zones.count() / 2


def test_few_rows_and_none(spark, tmp_path):
    assert got(spark, tmp_path / "a", []) == []
    assert got(spark, tmp_path / "b", [(100, [1.0], 1)]) == []
    one = [(100, [1.0], 1), (101, [0.5], 1), (102, [0.45], 2), (103, [-0.5], 1), (104, [0.5], 3)]
    assert got(spark, tmp_path / "c", one) == plain(one) == [(100, 101, 1, 104, 32768, 32768), (100, 101, 2, 102, 32768, 29440)]


def test_curve_visits_neighbours():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    path = grid[np.argsort(h.hilbert(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_wide_scores_are_refused(spark):
    df = spark.createDataFrame([(100, 1, [1 << 40])], "vec_id long, label int, v array<long>")
    with pytest.raises(ValueError):
        h.mine(df, h.F.lit(True))
