import random
import zlib

import numpy as np
from lexarium.llm import toxicity as t

BAD = ["idiot", "moron", "pathetic", "worthless"]


def corpus(make_prose, n, seed, words=BAD):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        cut = make_prose(rng, rng.choice([10, 60, 200])).split()
        label = int(rng.random() < 0.3)
        if label:
            for _ in range(3):
                cut.insert(rng.randrange(len(cut)), rng.choice(words))
        texts.append(" ".join(cut))
        labels.append(label)
    return texts, labels


def test_held_out_accuracy_and_misspellings(make_prose):
    model = t.fit(*corpus(make_prose, 400, 1))
    texts, labels = corpus(make_prose, 200, 2)
    got = np.array([model.score(x) >= t.THRESHOLD for x in texts])
    assert (got == np.array(labels)).mean() > 0.95
    odd, labels = corpus(make_prose, 200, 3, ["idiiot", "morron", "patheticc", "worthlesss"])
    got = np.array([model.score(x) >= t.THRESHOLD for x in odd])
    assert (got == np.array(labels)).mean() > 0.8
    assert model.score("") < t.THRESHOLD and model.score(" \n") < t.THRESHOLD


def test_rows_of_all_kinds(spark, make_prose, odd_texts):
    texts, labels = corpus(make_prose, 150, 4)
    rows = [(i, x, 1.5) for i, x in enumerate(texts)] + [(1000 + i, x, None) for i, x in enumerate(odd_texts)] + [(None, texts[0], 0.0), (0, texts[0], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([(i, y, "x") for i, y in enumerate(labels)] + [(None, 1, "x"), (3, None, "x"), (5, labels[5], "x")], "doc_id long, toxic int, text string")
    model = t.train(docs, marks, t.learning_rows(t.F.col("doc_id")))
    out = t.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert t.score(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = t.train(docs, marks, t.F.lit(True))
    assert {r["score"] for r in t.score(docs, model).collect()} == {0.0}


def test_long_runs_are_read_whole(make_prose):
    run = "".join(f"{i:x}é" for i in range(500))
    shown = f"<{run}>"
    grams = {zlib.crc32(shown[i : i + k].encode()) & (t.BUCKETS - 1) for k in (3, 4) for i in range(len(shown) - k + 1)}
    assert {b for w in t.words_of(run) for b in t.buckets_of(w)} == grams
    assert t.words_of("a" * t.LONG) == ["a" * t.LONG] and t.words_of("_" * 50) == ["_"]
    model = t.fit(*corpus(make_prose, 400, 1))
    clean = make_prose(random.Random(12), 60).split()
    bad = clean[:30] + BAD * 3 + clean[30:]
    assert model.score("_".join(bad)) == model.score(" ".join(bad)) >= t.THRESHOLD > model.score("_".join(clean))
    assert model.score("".join(bad)) >= t.THRESHOLD and model.score("".join(bad)) > model.score("".join(clean))


def test_columns_called_like_the_operators_own_stay(spark, make_prose):
    model = t.fit(*corpus(make_prose, 60, 2))
    docs = spark.createDataFrame([(1, "ab c", "own", 7, 0.5)], "doc_id long, text string, __text string, __c0 int, __score double")
    (row,) = t.score(docs, model).collect()
    assert (row["doc_id"], row["text"], row["__text"], row["__c0"], row["__score"]) == (1, "ab c", "own", 7, 0.5) and row["score"] == model.score("ab c")
