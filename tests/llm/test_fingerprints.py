import hashlib
import random

from lexarium.llm import fingerprints as f


def test_equals_brute_force(spark, make_prose, odd_texts):
    rng = random.Random(12)
    texts = list(odd_texts) + ["\n".join(make_prose(rng, rng.randint(1, 40)) + "." for _ in range(rng.randint(1, 8))) for _ in range(60)]
    rng.shuffle(texts)
    ids = [*rng.sample(range(-500, 500), len(texts) - 3), None, None, 7]
    ids[0] = ids[1] = 7
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, stretch string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        new = f.edited(t, following)
        own, other, after = f.merkle(t), f.merkle(new), f.merkle(following)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), own, other, f.likeness(own, other), f.likeness(own, after)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, f.fingerprints(docs).collect()), key=key) == sorted(want, key=key)


def test_tree_locates_edits(make_prose):
    rng = random.Random(13)
    text = "\n".join(make_prose(rng, 30) for _ in range(40))
    lines = text.split("\n")
    lines[20] = make_prose(rng, 30)
    a, b = f.merkle(text), f.merkle("\n".join(lines))
    assert f.likeness(a, a) == 1.0 and 0.9 < f.likeness(a, b) < 1.0
    assert 1 <= len(f.differing_sections(a, b)) <= 3
    assert f.likeness(f.merkle(""), f.merkle("")) == 1.0 and f.likeness(f.merkle(""), a) == 0.0
    assert f.merkle("a  b") != f.merkle("a b")


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "one text alone")], "doc_id long, text string")
    (row,) = f.fingerprints(docs).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 14
    assert f.fingerprints(docs.limit(0)).count() == 0
