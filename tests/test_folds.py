import json
import random

import pytest
from pyspark.sql import functions as F

from lexarium.functions import semistructured as j
from lexarium.operators.aliases import STOP_TERMS, compound_aliases
from lexarium.operators.inheritance import cycles, effective
from lexarium.operators.selection import three_passes


def test_strict_json(spark):
    deep = lambda n: "[" * n + "1" + "]" * n
    texts = {
        '{"a": 1, "b": [1, 2, {}], "c": "x,y]{"}': None, '{"a": 1, "a": 2}': "INVALID", '{"a": {"b": 1, "b": 1}}': "INVALID", '{"a": 1': "INVALID", "": "INVALID", None: "MISSING",
        deep(32): None, deep(33): "TOO_DEEP", "[" * 33 + "]" * 33: None, "[" * 34 + "]" * 34: "TOO_DEEP", json.dumps(list(range(1999))): None, json.dumps(list(range(2000))): "TOO_LARGE", "[]": None, '"[[[["': None, "null": None,
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", j.strict_json(F.col("t")).alias("s")).select("t", "s.reason", F.expr("s.value IS NULL").alias("none")).collect()
    assert {r["t"]: r["reason"] for r in got} == texts
    assert all(r["none"] == (r["reason"] is not None) for r in got)


def test_maps_of_variants(spark):
    rows = [('{"a": 1, "b": -2, "h": "%s"}' % ("A" * 64), '{"a": 7, "t": true}'), ('{"a": 1.5}', None), ("[1]", '{"a": "5"}'), (None, '{"h": "xyz"}')]
    df = spark.createDataFrame(rows, "x string, y string").select(j.merged(j.fields(F.parse_json("x")), j.fields(F.parse_json("y"))).alias("m"))
    got = df.select(*[j.count_or_null(F.col("m")[k]).alias(k) for k in "abt"], j.sha256_or_null(F.col("m")["h"]).alias("h")).collect()
    assert [tuple(r) for r in got] == [(7, None, None, "a" * 64), (None,) * 4, (None,) * 4, (None,) * 4]


def plain_aliases(terms, vocabulary):
    split = []
    for t in terms:
        parts = [p for p in t.split("-") if p]
        split += parts if "-" in t and t not in vocabulary and len(parts) > 1 and set(parts) <= vocabulary else [t]
    out, i = [], 0
    while i < len(split):
        pair = split[i:i + 2]
        if len(pair) == 2 and not set(pair) & set(STOP_TERMS) and "-".join(pair) in vocabulary:
            out.append("-".join(pair))
            i += 2
        else:
            out.append(split[i])
            i += 1
    return out


def test_compound_aliases_equal_plain_ones(spark):
    rng = random.Random(6)
    words = ["lane", "change", "speed", "the", "x-y", "lane-change", "change-speed", "-", "a-b-c", "the-lane"]
    vocabulary = {"lane", "change", "lane-change", "change-speed", "x", "y", "a", "b", "the-lane", "the"}
    queries = [(i, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for i in range(80)] + [(99, None)]
    df = spark.createDataFrame(queries, "i long, terms array<string>")
    vocab = spark.createDataFrame([(w,) for w in vocabulary] * 2, "term string")
    got = {r["i"]: r["aliased"] for r in compound_aliases(df, "i", "terms", vocab).collect()}
    assert got == {i: plain_aliases(t, vocabulary) if t is not None else None for i, t in queries}


def plain_passes(traces, most):
    chosen, documents = {}, set()
    key = lambda t, r: (t["language"] or "all", r["document"] or str(r["id"]))
    for t in traces:
        left = [r for r in t["rows"] if key(t, r) not in documents]
        if left and len(chosen) < most:
            top = max(left, key=lambda r: r["overlap"])
            chosen[top["id"]] = 1
            documents.add(key(t, top))
    for wanted in (True, False):
        for t in traces:
            for r in t["rows"]:
                if len(chosen) < most and (not wanted or (r["id"] not in chosen and key(t, r) not in documents and r["overlap"] > 0)):
                    chosen.setdefault(r["id"], 1)
                    documents.add(key(t, r))
    return list(chosen)


def test_three_passes_equal_plain_ones(spark):
    rng = random.Random(7)
    cases = []
    for i in range(150):
        of = {k: rng.choice(["d1", "d2", "d3", None]) for k in range(12)}
        cases.append((i, [{"language": rng.choice(["zh", "en", None]), "rows": [{"id": k, "document": of[k], "overlap": rng.randint(0, 2)} for k in rng.sample(range(12), rng.randint(0, 6))]} for _ in range(rng.randint(0, 4))]))
    df = spark.createDataFrame(cases, "i long, traces array<struct<language:string,rows:array<struct<id:long,document:string,overlap:int>>>>")
    for most in (2, 8):
        got = {r["i"]: r["selected"] for r in three_passes(df, "traces", most).collect()}
        assert got == {i: plain_passes(t, most) for i, t in cases}


def plain_settings(settings, bases, node, depth, seen=()):
    out = {}
    if depth:
        for base in bases.get(node, []):
            if base != node and base not in seen:
                out |= plain_settings(settings, bases, base, depth - 1, (*seen, node))
    return out | {k: (v, node) for k, v in settings.get(node, {}).items()}


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_inheritance_equals_plain(spark, depth):
    rng = random.Random(depth)
    nodes = range(40)
    bases = {n: rng.sample(range(40), rng.randint(0, 2)) for n in nodes if n % 3}
    bases |= {50 + i: [51 + i] for i in range(12)}
    settings = {n: {k: f"{n}{k}" for k in "abc" if rng.random() < 0.4} for n in (*nodes, *range(50, 63))}
    b = spark.createDataFrame([(n, base, i) for n, own in bases.items() for i, base in enumerate(own)], "node long, base long, at int")
    s = spark.createDataFrame([(n, k, v) for n, own in settings.items() for k, v in own.items()], "node long, key string, value string")
    got = {}
    for r in effective(s, b, depth).collect():
        got.setdefault(r["node"], {})[r["key"]] = (r["value"], r["source"])
    if depth < 8:  # deep random walks meet cycles in many ways; the chain shows the depth
        assert got == {n: w for n in settings if (w := plain_settings(settings, bases, n, depth))}
    assert {n: got.get(n, {}) for n in range(50, 63)} == {n: plain_settings(settings, bases, n, depth) for n in range(50, 63)}
    loops = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0), (4, 4, 0), (5, 1, 0)], "node long, base long, at int")
    assert {r["node"] for r in cycles(loops).collect()} == {1, 2, 3, 4}
