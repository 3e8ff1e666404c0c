import math
import random
from collections import Counter

import pytest

from lexarium.operators import retrieval as r
from lexarium.operators import scoring as s


def plain(docs, queries, k=None, k1=1.2, b=0.75, numerator=2.2, multiplicity=False, least=1):
    tf = {i: Counter(t.split()) for i, t in docs.items()}
    n, mean = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    df = Counter(t for c in tf.values() for t in c)
    out = []
    for q, text in queries.items():
        own = Counter(text.split())
        rows = []
        for i, c in tf.items():
            met = [t for t in own if t in c]
            score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * numerator / (c[t] + k1 * (1 - b + b * sum(c.values()) / mean)) * (own[t] if multiplicity else 1) for t in met)
            if met and len(met) >= least:
                rows.append((-round(score, 9), i, len(met)))
        out += [(q, i, m, round(-x, 6)) for x, i, m in sorted(rows)[:k]]
    return sorted(out)


@pytest.fixture
def tables(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    docs = {i: " ".join(rng.choice(words[: 3 + i % 23]) for _ in range(rng.randint(0, 30))) for i in range(120)}
    docs |= {200 + i: docs[5] for i in range(9)}  # ties
    queries = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for i in range(12)} | {50: "unheard", 51: ""}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "q long, text string")
    terms = r.query_terms(q, "q", "text")
    return docs, queries, r.hits(d, ["doc_id"], "text", terms), terms


@pytest.mark.parametrize("k", [1, 4, None])
@pytest.mark.parametrize("at_once,block", [(50, 8), (2_000_000, 200_000)])
def test_equals_plain_bm25(tables, monkeypatch, k, at_once, block):
    docs, queries, found, terms = tables
    monkeypatch.setattr(s, "AT_ONCE", at_once)
    monkeypatch.setattr(s, "BLOCK_TERMS", block)
    best = s.best_rows(found, terms, "doc_id", "q", k)
    best = r.top_k(best, "q", k, *r.best_first("doc_id")) if k else best
    assert sorted((x["q"], x["doc_id"], x["n_terms"], round(x["score"], 6)) for x in best.collect()) == plain(docs, queries, k)


def test_multiplicity_least_terms_and_carried_columns(spark, tables):
    docs, queries, found, terms = tables
    formula = s.Formula(k=1.5, numerator=2.5, multiplicity=True)
    best = s.best_rows(found.withColumn("name", s.F.concat(s.F.lit("d"), "doc_id")), terms, "doc_id", "q", 3, formula, carry=["name"], least_terms=2)
    got = r.top_k(best, "q", 3, *r.best_first("doc_id")).collect()
    assert sorted((x["q"], x["doc_id"], x["n_terms"], round(x["score"], 6)) for x in got) == plain(docs, queries, 3, 1.5, 0.75, 2.5, True, 2)
    assert all(x["name"] == f"d{x['doc_id']}" for x in got)


def test_share_of_a_query(tables):
    docs, queries, found, terms = tables
    got = s.best_rows(found, terms, "doc_id", "q", None, s.Formula(counts=True), least_share=0.5).collect()
    want = sorted((q, i, len(set(text.split()) & set(t.split()))) for q, text in queries.items() for i, t in docs.items() if text and len(set(text.split()) & set(t.split())) / len(set(text.split())) >= 0.5)
    assert sorted((x["q"], x["doc_id"], x["n_terms"]) for x in got) == want


def test_text_keys_and_null_keys(spark):
    terms = spark.createDataFrame([(1, "a", 1)], "q long, term string, qf long")
    found = spark.createDataFrame([("y", 2, ["a"]), ("x", 2, ["a"]), ("z", 2, [])], "id string, len long, hits array<string>").coalesce(1)
    assert [x["id"] for x in s.best_rows(found, terms, "id", "q", 1).collect()] == ["x"]
    found = spark.createDataFrame([(3, 2, ["a"]), (None, 2, ["a"]), (1, 2, ["a"])], "id long, len long, hits array<string>").coalesce(1)
    assert [x["id"] for x in s.best_rows(found, terms, "id", "q", 2).collect()] == [None, 1]
    assert s.best_rows(found.limit(0), terms, "id", "q", 2).count() == 0 and s.best_rows(found, terms.limit(0), "id", "q", 2).count() == 0


def test_dense_search_is_exact_however_queries_are_dealt(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 6)).round(1).astype(np.float32)
    v[100:120] = v[7]  # ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    queries = vectors.where("vec_id % 4 = 0").selectExpr("vec_id AS qid", "embedding AS q")
    want = []
    for i in range(0, 150, 4):
        score = v.astype(float) @ v[i].astype(float)
        want += [(i, int(j)) for j in np.lexsort((np.arange(150), -score.round(9)))[:5]]
    for block, tile in ((4096, 32_768), (3, 40)):
        monkeypatch.setattr(r, "QUERY_BLOCK", block)
        monkeypatch.setattr(r, "TILE_ROWS", tile)
        assert sorted((x["qid"], x["vec_id"]) for x in r.dense_search(vectors, queries, 5).collect()) == sorted(want)
    assert r.dense_search(vectors, queries.limit(0), 5).count() == 0
