import math
import random

from pyspark.sql import functions as F

from lexarium.functions.text import casefolded, facets, search_terms, terms
from lexarium.operators import graph, lifecycle, retrieval, selection
from lexarium.sources.tables import chunks


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_terms(spark):
    assert one(spark, terms, "a-b c_d 12 v1.2") == ["a-b", "c_d", "12", "v1.2"]
    assert one(spark, terms, "模型训练 a") == ["模型", "型训", "训练", "a"] and one(spark, terms, "模") == ["模"]
    assert one(spark, search_terms, "use_cpu.threads x") == ["use_cpu.threads", "use", "cpu", "threads", "x"]
    assert one(spark, casefolded, "STRAßE Ａ") == "strasse a" and one(spark, casefolded, None) is None


def test_facets(spark):
    assert one(spark, facets, "one thing") == ["one thing"]
    assert one(spark, facets, "1. a;- b\nc；d; e") == ["a", "b", "c", "d；e"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, "green"), (4, None)], "doc_id long, text string").na.fill("")
    asked = spark.createDataFrame([(0, "red RED nothing")], "q long, text string")
    terms = retrieval.query_terms(asked, "q", "text")
    got = retrieval.bm25(retrieval.hits(docs, ["doc_id"], "text", terms), terms, "doc_id", "q").collect()
    idf, avg = math.log(1 + (4 - 1 + 0.5) / 1.5), 5 / 4
    assert [(r["doc_id"], r["n_terms"]) for r in got] == [(1, 1)]
    assert abs(got[0]["score"] - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))) < 1e-9


def test_hits_are_the_same_joined_or_filtered(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Straße red 模型训练"), (2, "STRASSE ｒｅｄ red blue"), (3, None), (4, "x")], "doc_id long, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "strasse red 模型")], "q long, text string"), "q", "text")
    want = {1: (5, ["red", "strasse", "模型"]), 2: (4, ["red", "red", "strasse"]), 4: (1, [])}
    for most in (20_000, 1):
        monkeypatch.setattr(retrieval, "LITERAL_TERMS", most)
        got = {r["doc_id"]: (r["len"], sorted(r["hits"] or [])) for r in retrieval.hits(docs, ["doc_id"], "text", terms).collect()}
        assert {k: v for k, v in got.items() if k != 3} == want and got[3][1] == []
    stats = {r["term"]: (r["df"], r["cf"]) for r in retrieval.term_statistics(docs, "doc_id", "text").collect()}
    assert stats["red"] == (2, 3) and stats["strasse"] == (2, 2)


def test_fusion_and_ties(spark):
    rows = [(0, 0, "a", 1), (0, 0, "b", 2), (0, 1, "b", 1), (0, 1, "a", 2), (0, 1, "a", 5)]
    df = spark.createDataFrame(rows, "q long, list_id int, k string, rank int")
    twice = {r["k"]: r["rrf_score"] for r in retrieval.reciprocal_rank_fusion(df, "q", "k").collect()}
    once = retrieval.reciprocal_rank_fusion(df, "q", "k", once=True)
    assert twice["a"] > twice["b"]
    assert [r["k"] for r in retrieval.top_k(once, "q", 5, *retrieval.best_first("k", "rrf_score")).orderBy("rank").collect()] == ["a", "b"]


def test_budgets(spark):
    rows = [(0, 1, 100), (0, 2, 900), (0, 3, 50), (0, 4, 900)]
    df = spark.createDataFrame(rows, "q long, rank int, chars int")
    got = [r["budget"] for r in retrieval.excerpt_budgets(df, "q", "chars", 500, 1000).orderBy("rank").collect()]
    assert got == [100, 500, 50, 350]


def test_diff_mirrors(spark):
    a = spark.createDataFrame([(1, "x", "one"), (1, "y", "two  words"), (1, "z", "3")], "doc_id long, key string, content string")
    b = spark.createDataFrame([(1, "x", "uno"), (1, "y", "two words"), (1, "w", "4")], "doc_id long, key string, content string")
    there = {r["key"]: r["change"] for r in lifecycle.compare(a, b, ["doc_id", "key"], "content").collect()}
    back = {r["key"]: r["change"] for r in lifecycle.compare(b, a, ["doc_id", "key"], "content").collect()}
    assert there == {"x": "MODIFIED", "y": "UNCHANGED", "z": "REMOVED", "w": "ADDED"}
    swap = {"ADDED": "REMOVED", "REMOVED": "ADDED"}
    assert back == {k: swap.get(c, c) for k, c in there.items()}
    assert lifecycle.duplicates(a.union(a.limit(1)), "doc_id", "key").count() == 1


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (10, 11), (5, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (10,)], "seed long")
    assert {tuple(r) for r in graph.reach(edges, seeds).collect()} == {(1, 2, 1), (1, 3, 2), (1, 4, 3), (10, 11, 1)}
    assert {tuple(r) for r in graph.on_cycles(edges).collect()} == {(1, 3), (2, 3), (3, 3), (5, 1)}
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 9), 110) for _ in range(20)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[110] >= 100


def images(spark, cases, k):
    """with_images of (hits, images) pairs."""
    rows = [(n, [(str(i), c) for i, c in hits], [(str(i), c) for i, c in own]) for n, (hits, own) in enumerate(cases)]
    entry = "array<struct<id:string,source:int>>"
    df = spark.createDataFrame(rows, f"n int, hits {entry}, images {entry}")
    return [[tuple(x) for x in r["kept"]] for r in df.select("n", selection.with_images(F.col("hits"), F.col("images"), k).alias("kept")).orderBy("n").collect()]


def test_images(spark):
    hits = [("a", 1), ("b", 1), ("c", 2)]
    cases = [(hits, [("x", 2)]), (hits, [("x", 9)]), (hits[1:], [("x", 9), ("y", 8)]), (hits, [("b", 2), ("x", 2), ("x", 1)]), ([], [])]
    assert images(spark, cases, 3) == [
        [("a", 1), ("b", 1), ("x", 2)], [("a", 1), ("x", 9), ("c", 2)], [("b", 1), ("c", 2), ("x", 9)], [("a", 1), ("b", 1), ("x", 2)], [],
    ]


def test_images_never_exceed_places(spark):
    rng = random.Random(11)
    for k in range(1, 6):
        cases = [[list({rng.randint(0, 30): rng.randint(0, 4) for _ in range(rng.randint(0, most))}.items()) for most in (12, 6)] for _ in range(60)]
        for (hits, own), kept in zip(cases, images(spark, cases, k)):
            assert len(kept) <= k and len({i for i, _ in kept}) == len(kept)
            assert {c for _, c in hits[:k]} <= {c for _, c in kept} | {c for _, c in own}


def test_context(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 50), (1, 3, 5), (1, 4, 60), (1, 5, 5)], "section int, place int, cost int")

    def taken(hits, budget):
        wanted = selection.around_hits(rows, "section", "place", "cost", F.col("place").isin(hits))
        return [tuple(x) for x in wanted.select(selection.within_budget(F.col("wanted"), budget).alias("taken")).first()["taken"]]

    assert taken([4], 70) == [(4, "hit"), (1, "anchor"), (3, "neighbour")]
    assert taken([4], 1) == [(4, "hit")]
    assert taken([3, 4, 5], 30) == [(3, "hit"), (1, "anchor")]
    assert taken([2, 4], 1000) == [(2, "hit"), (1, "anchor"), (3, "neighbour"), (4, "hit"), (5, "neighbour")]


def test_small_selectors():
    assert selection.greedy_cap([("a", 5), ("b", 9), ("c", 5)], 3, 10) == ["a", "c"]
    assert selection.reserve([{"x": 2}, {"x": 2, "a": 1}, {"x": 1}], {"x": 3, "a": None}) == [None, "x", None]
    assert selection.reserve([{"x": 0.1}], {"x": 0}) == ["x"]
    assert selection.stalls([("s", 1), ("s", 1), ("s", 1), ("s", 1), ("s", 2), ("s", 0), ("s", 0)], 2) == [2, 6]
    assert selection.round_robin([[("a", 1), ("b", 1)], [("a", 1), ("c", 2)]], 3) == [("a", 1), ("c", 2), ("b", 1)]


def test_cases_are_read_row_by_row(spark):
    rng = random.Random(4)
    values = [rng.randint(0, 9) for _ in range(200)]
    assert [i for i, x in enumerate(selection.stalling(iter(values), 3)) if x] == selection.stalls([("s", v) for v in values], 3)
    endless = ({"x": 1} for _ in iter(int, 1))
    denied = selection.reserving(endless, {"x": 2})
    assert [next(denied) for _ in range(4)] == [None, None, "x", "x"]
    for _ in range(300):
        searches = [[(100 * c + i, rng.randint(0, 3)) for i in range(rng.randint(1, 12))] for c in range(rng.randint(1, 5))]
        k = rng.randint(1, 6)
        assert selection.round_robin_of(((c, *hit) for c, own in enumerate(searches) for hit in own), k) == selection.round_robin(searches, k)
    df = spark.range(1000).selectExpr("id % 2 as case", "id")

    def work(rows):
        assert not isinstance(rows, list)
        return ((r.case, r.id) for r in rows if r.id >= 990)

    assert sorted(r["id"] for r in selection.per_case(df, "case", ["id"], work, "case long, id long").collect()) == list(range(990, 1000))


def test_consistency_pairs_are_counted_not_made(spark, tmp_path):
    from lexarium.jobs.lifecycle import j14_consistency_self_join

    heads, ends = ["alike beginning of ", "another beginning "], ["one text", "two texts", "three texts"]
    rng = random.Random(2)
    docs = [(rng.randint(0, 30), "\n".join(rng.choice(heads) + rng.choice(ends) for _ in range(3)), rng.choice(["s", None]), rng.choice(["en", "de", None])) for _ in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = j14_consistency_self_join(spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    lines = chunks(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    want = {}
    for x in lines:
        for y in lines:
            if None not in (x["lang"], x["source"]) and [x[c] for c in ("lang", "source", "n")] == [y[c] for c in ("lang", "source", "n")] and x["doc_id"] < y["doc_id"] and x["content"] != y["content"]:
                pairs, s = want.get(x["lang"], (0, 0))
                want[x["lang"]] = pairs + 1, s + x["n"]
    assert want and {r["lang"]: (r["pairs"], r["s"]) for r in out.collect()} == want


def test_stalls_in_segments_equal_those_of_whole_cases(spark):
    from lexarium.operators.segments import stalled

    rng = random.Random(8)
    rows = [(case, i, rng.choice([None, float("nan"), *map(float, range(12))]) if case else float(i % 5)) for case in range(6) for i in range(rng.randint(1, 90))]
    df = spark.createDataFrame(rows, "case int, i int, value double").repartition(3)
    want = set()
    for case in range(6):
        own = sorted((i, v) for c, i, v in rows if c == case)
        for (i, _), told in zip(own, selection.stalling((float("-inf") if v is None else v for _, v in own), 4)):
            want |= {(case, i)} if told else set()
    for width in (1, 7, 1000):
        got = stalled(df, "case", ["i"], F.col("value"), F.floor(F.col("i") / width), 4)
        assert want and {(r["case"], r["i"]) for r in got.collect()} == want
