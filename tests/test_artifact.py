import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lexarium.sources import artifact as a

TEXTS = {"guide.md": "# One\nfirst part\n\nsecond part\n# Two\nthird", "de/Übersicht.md": "kein Titel hier\n", "empty.md": ""}


@pytest.fixture
def root(tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text, encoding="utf8")
    return tmp_path


def manifest(spark, texts=TEXTS):
    return spark.createDataFrame([(n, hashlib.sha256(t.encode()).hexdigest(), "v1") for n, t in texts.items()], "path string, sha256 string, version string")


def test_files_are_built_verified_and_loaded(spark, root):
    sources = a.file_sources(spark, f"{root}/src", manifest(spark))
    made = a.build(sources, f"{root}/index")
    assert (made["chunks"], made["sources"], made["vectors"], made["dimensions"]) == (3, 2, 3, 512)
    index = a.load(spark, f"{root}/index")
    assert sorted((r["chunk_id"], r["headings"], r["content"], r["version"]) for r in index.chunks.collect()) == [
        ("de/Übersicht.md:1", [], "kein Titel hier", "v1"), ("guide.md:1", ["One"], "first part\n\nsecond part", "v1"), ("guide.md:2", ["Two"], "third", "v1")]


@pytest.mark.parametrize("fault", ["changed", "missing", "unlisted", "repeated"])
def test_sources_that_differ_from_the_manifest_are_refused(spark, root, fault):
    listed = manifest(spark)
    if fault == "changed":
        (root / "src/guide.md").write_text("# One\nfirst part!")
    elif fault == "missing":
        (root / "src/guide.md").unlink()
    elif fault == "unlisted":
        (root / "src/more.md").write_text("x")
    else:
        listed = listed.union(listed.limit(1))
    with pytest.raises(a.ArtifactError, match=f"1 {fault}"):
        a.file_sources(spark, f"{root}/src", listed)


def test_bytes_that_are_no_text_are_refused(spark, root):
    (root / "src/guide.md").write_bytes(b"\xff\xfe\x00")
    listed = manifest(spark).where("path <> 'guide.md'").union(spark.createDataFrame([("guide.md", hashlib.sha256(b"\xff\xfe\x00").hexdigest(), "v1")], "path string, sha256 string, version string"))
    with pytest.raises(a.ArtifactError, match="not UTF-8"):
        a.file_sources(spark, f"{root}/src", listed)


def test_one_changed_byte_refuses_the_load(spark, root):
    a.build(a.file_sources(spark, f"{root}/src", manifest(spark)), f"{root}/index")
    folder = root / "index/vectors"
    part = next(folder / f for f in sorted(os.listdir(folder)) if f.endswith(".parquet"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(bytes(data))
    (folder / f".{part.name}.crc").unlink(missing_ok=True)  # so that the file system itself has no say
    with pytest.raises(a.ArtifactError, match="vectors: 1 changed"):
        a.load(spark, f"{root}/index")


def test_an_unfinished_build_is_no_artifact(spark, root):
    a.build(a.file_sources(spark, f"{root}/src", manifest(spark)), f"{root}/index")
    with pytest.raises(a.ArtifactError, match="policy"):
        a.load(spark, f"{root}/index", "other")
    os.rename(root / "index/manifest/about", root / "index/manifest/elsewhere")
    with pytest.raises(a.ArtifactError, match="no complete artifact"):
        a.load(spark, f"{root}/index")


def test_vectors_must_match_chunks(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "chunk_id string, content string")
    vectors = spark.createDataFrame([("a", [0.6, 0.8]), ("c", [0.5])], "chunk_id string, vector array<float>")
    with pytest.raises(a.ArtifactError, match="2 chunks or vectors alone, 1 repeated ids, 1 vectors of another length, 1 vectors that aren't of length 1"):
        a.check(chunks, vectors, {"chunks": 3, "vectors": 2, "dimensions": 2})


def test_staging_is_named_by_content(spark, root):
    sources = a.file_sources(spark, f"{root}/src", manifest(spark))
    a.build(sources, f"{root}/one")
    a.build(sources.repartition(3), f"{root}/two")
    first, again = a.stage(f"{root}/one", f"{root}/releases", spark), a.stage(f"{root}/two", f"{root}/releases", spark)
    assert first == again and os.listdir(root / "releases") == [first]
    assert a.load(spark, f"{root}/releases/{first}").manifest["chunks"] == 3


def test_hash_vector_counts_runs(spark):
    from lexarium.functions.text import hash_vector

    rows = spark.createDataFrame([("aB a",), ("ｆ",), ("",), (None,)], "t string").select(hash_vector(F.col("t"))).collect()
    b = lambda g: int.from_bytes(hashlib.sha256(g.encode()).digest()[:4], "big") % 512
    want = [0.0] * 512
    for g in ("a", "b", "a", "ab", "ba", "aba"):
        want[b(g)] += 1
    norm = sum(x * x for x in want) ** 0.5
    assert rows[0][0] == pytest.approx([x / norm for x in want], abs=1e-6)
    assert rows[1][0][b("f")] == 1.0 and not any(rows[2][0]) and not any(rows[3][0])
