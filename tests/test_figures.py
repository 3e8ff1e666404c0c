from pyspark.sql import functions as F

from lexarium.operators import figures as g


def test_paths_resolve_within_the_root(spark):
    cases = {
        ("a/b/doc.md", "x.png"): "a/b/x.png", ("a/b/doc.md", "../x%20y.png?v=1#z"): "a/x y.png", ("a/b/doc.md", "./../../x.png"): "x.png", ("a/b/doc.md", "../../../x.png"): None,
        ("doc.md", "/img/./x.png"): "img/x.png", ("doc.md", "https://h/x.png"): None, ("doc.md", "//h/x.png"): None, ("doc.md", "data:image/png;base64,AA"): None, ("doc.md", "#top"): None, ("doc.md", "100%.png"): "100%.png",
    }
    df = spark.createDataFrame(list(cases), "p string, t string")
    assert {(r["p"], r["t"]): r["x"] for r in df.select("p", "t", g.resolved(F.col("p"), F.col("t")).alias("x")).collect()} == cases


def test_inventory_and_what_it_bears_out(spark):
    docs = [(1, "r", "d/one.md", 'x ![First](img/a.png "t") y\n<IMG alt="tag" src="../b.png"> ![](https://h/c.png)'), (2, "r", "two.md", "![again](d/img/a.png) ![First](d/img/a.png) ![up](../../z.png)"), (3, "r", "three.md", "no image"), (4, "r", "n.md", None)]
    df = spark.createDataFrame(docs, "i long, root string, path string, t string")
    figures, counts = g.inventory(df, "root", "i", "path", g.images(F.col("t")))
    got = {r["asset_path"]: (r["n_references"], [(x["key"], x["at"], x["alt"]) for x in r["references"]]) for r in figures.collect()}
    assert got == {"d/img/a.png": (3, [(1, 0, "First"), (2, 0, "again"), (2, 1, "First")]), "b.png": (1, [(1, 2, "tag")])}
    assert [(r["external"], r["unresolved"]) for r in counts.collect()] == [(1, 1)]
    ids = {r["asset_path"]: r["figure_id"] for r in figures.collect()}
    said = spark.createDataFrame([(1, ids["b.png"]), (2, ids["b.png"]), (2, ids["d/img/a.png"]), (1, "none")], "i long, figure_id string")
    assert {(r["i"], r["figure_id"]) for r in g.borne_out(said, figures, "i").collect()} == {(1, ids["b.png"]), (2, ids["d/img/a.png"])}
    chunks = g.reviewed_chunks(figures, df.select("i"), "i", F.col("alt")).collect()
    assert sorted((r["i"], r["asset_path"], r["content"]) for r in chunks) == [(1, "b.png", "tag"), (1, "d/img/a.png", "First"), (2, "d/img/a.png", "First"), (2, "d/img/a.png", "again")]
    assert len({r["chunk_id"] for r in chunks}) == 4
