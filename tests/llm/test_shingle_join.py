import random

from lexarium.llm import shingle_join as s


def brute(docs):
    sets = {}
    for key, text in docs:
        words = (text or "").lower().split()
        sets[key] = (set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else {tuple(words)}) if words else set()
    links = {k: 0 for k in sets}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in keys}


def corpus(make_prose, odd_texts):
    rng = random.Random(8)
    docs = list(odd_texts)
    for size, edits in ((1, 0), (2, 1), (5, 2), (50, 4), (12, 9)):
        base = make_prose(rng, 150).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = make_prose(rng, 1) + "x"
            docs.append(" ".join(words))
            if rng.random() < 0.2:
                docs.append("  ".join(words).upper())
    docs += [make_prose(rng, rng.randint(3, 80)) for _ in range(40)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_equals_brute_force_with_small_and_large_nodes(spark, make_prose, odd_texts, monkeypatch):
    docs = corpus(make_prose, odd_texts)
    want = brute(docs)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, class_id int")
    for small, block in ((32, 256), (4, 8)):
        monkeypatch.setattr(s, "SMALL", small)
        monkeypatch.setattr(s, "BLOCK", block)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in s.linked_documents(df).collect()}
        assert got == want
    assert max(n for _, n in want.values()) > 40
    kept = {r["doc_id"] for r in s.keep_one(df).collect()}
    assert kept == {c for c, _ in want.values()}


def test_prefixes_are_shortened_until_the_recall():
    exact = [0] * (s.BINS - 1) + [100_000]
    near = [30_000] + exact[1:]
    assert s.next_depth(exact, s.DEPTH) == s.DEPTH
    deep = s.next_depth(near, s.DEPTH)
    assert deep < s.next_depth([1000] + exact[1:], s.DEPTH) < s.DEPTH
    assert s.recalls(near, s.DEPTH)[deep] >= s.RECALL > s.recalls(near, s.DEPTH)[deep + 1]
    assert s.next_depth([0] * s.BINS, 4) == 4 and s.next_depth([0] * s.BINS, s.DEPTH) <= 5


def test_recall_of_pairs_at_the_threshold(spark, make_prose):
    rng = random.Random(12)
    docs, pairs = [], 60
    for k in range(pairs):
        words = [f"{w}{k}" for w in make_prose(rng, 200).split()]
        words += [f"x{k}x{i}" for i in range(200 - len(words))]
        other = list(words)
        for at in (25, 65, 105, 145):  # 4 * 5 of 196 shingles differ
            other[at] += "y"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert all(n == (2 * (k // 2), 1) for k, n in brute(docs).items())
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in s.linked_documents(df).collect()} == brute(docs)


def test_candidates_grow_with_the_classes(spark, make_prose):
    rng = random.Random(4)
    base = make_prose(rng, 300).split()
    docs = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(len(words))] = f"odd{i}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = df.selectExpr("doc_id as doc", "xxhash64(text) as mark", "text")
    found = rows.mapInArrow(s._signature_rows, s.SIGNED).selectExpr("cls as rep", "trie", "sketch")
    n = s._met(s._entries(found), 5).count()
    assert 399 <= n <= 2 * 400
    got = s.linked_documents(df).collect()
    assert {r["class_id"] for r in got} == {0} and all(r["n_links"] == 399 for r in got)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A  B c d e f"), (None, "a b c d e f"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["class_id"], r["n_links"]) for r in s.linked_documents(df).collect())
    assert got == [(-1, None, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0)]
    kept = s.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert s.linked_documents(df.limit(0)).count() == 0 and s.keep_one(df.limit(0)).count() == 0


def test_two_texts_of_one_doc_id(spark, make_prose):
    rng = random.Random(3)
    near, clean = make_prose(rng, 150), make_prose(rng, 150)
    for a, b in ((near, clean), (clean, near)):
        rows = [(1, make_prose(rng, 90)), (2, a), (2, b), (3, near + " end"), (0, clean + " end")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(tuple(r) for r in s.linked_documents(df).collect())
        assert got == [(0, 0, 1), (1, 1, 0), (2, 0, 1), (2, 2, 1), (3, 2, 1)]
        kept = sorted((r["doc_id"], r["text"]) for r in s.keep_one(df).collect())
        assert kept == sorted([rows[0], (2, near), (0, clean + " end")])
    lone = spark.createDataFrame([(1, near), (2, near + " end"), (2, clean)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in s.keep_one(lone).collect()) == sorted([(1, near), (2, clean)])
