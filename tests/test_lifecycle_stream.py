import random

from lexarium.streaming import lifecycle as s

REQUEST = "artifact_id long, request_id long, action string, completed int, resume boolean"


def plain(requests, total):
    builds, out = {}, []
    for artifact, request, action, completed, resume in requests:
        out.append((artifact, *builds.setdefault(artifact, s.Build()).take(request, action, completed, resume, total)))
    return out


def log(spark, folder, total=3, **how):
    stream = spark.readStream.schema(REQUEST).parquet(f"{folder}/in")
    s.append_log(s.build_log(stream, total, **how), f"{folder}/out")
    return sorted(map(tuple, s.read_log(spark, f"{folder}/out").collect()))


def test_a_restart_goes_on_where_the_log_ended(spark, tmp_path):
    rng = random.Random(3)
    requests = [(rng.randint(1, 5), i, rng.choice(["start", "checkpoint", "checkpoint", "complete", "fail", "other"]), rng.choice([None, 0, 1, 2, 3, 3, 4]), rng.random() < 0.5) for i in range(150)]
    first, second = requests[:70], [(1, 3, "start", None, True), *requests[70:]]
    spark.createDataFrame(first, REQUEST).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(second, REQUEST).write.parquet(f"{tmp_path}/next")
    (tmp_path / "in" / "a").rename(tmp_path / "kept")
    (tmp_path / "in").rmdir()
    (tmp_path / "kept").rename(tmp_path / "in")
    assert log(spark, tmp_path) == sorted(plain(first, 3))
    for f in (tmp_path / "next").glob("part-*.parquet"):
        f.rename(tmp_path / "in" / f"second-{f.name}")
    # a late request is refused: it sorts first within its micro-batch, behind what the state has seen
    ordered = sorted(second, key=lambda r: r[1])
    want = sorted(plain(first + ordered, 3))
    got = log(spark, tmp_path)
    assert got == want and len({(r[0], r[1]) for r in got}) == len(got) == 151
    assert (1, "OUT_OF_ORDER") in {(r[0], r[-1]) for r in got}
    reasons = {r[-1] for r in got}
    assert {"RESUME_REQUIRED", "CHECKPOINT_REQUIRES_BUILDING_STATE", "CHECKPOINT_PROGRESS_INVALID", "UNKNOWN_ACTION", None} <= reasons


def test_transitions():
    b = s.Build()
    told = [b.take(i, a, c, r, 2)[3:] for i, (a, c, r) in enumerate([("complete", None, False), ("start", None, False), ("start", None, False), ("checkpoint", 1, False), ("checkpoint", 0, False), ("complete", None, False), ("checkpoint", 2, False), ("fail", None, False), ("start", None, True), ("complete", None, False), ("fail", None, False), ("start", None, True)])]
    assert [(t[0], t[-1]) for t in told] == [
        ("PENDING", "COMPLETE_REQUIRES_BUILDING_STATE"), ("BUILDING", None), ("BUILDING", "RESUME_REQUIRED"), ("BUILDING", None), ("BUILDING", "CHECKPOINT_PROGRESS_INVALID"), ("BUILDING", "PARTIAL_ARTIFACT_CANNOT_COMPLETE"),
        ("BUILDING", None), ("FAILED", None), ("BUILDING", None), ("COMPLETE", None), ("COMPLETE", "COMPLETE_ARTIFACT_CANNOT_FAIL"), ("COMPLETE", "ARTIFACT_ALREADY_COMPLETE")]
