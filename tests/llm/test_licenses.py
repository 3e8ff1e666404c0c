import random

from lexarium.llm import licenses as c


def brute(text, templates=None, threshold=c.THRESHOLD):
    """Without pruning: lines, whole text, passages."""
    lines = [c.normal(x).split() for x in (text or "").split("\n")]

    def grams(words):
        return set(zip(words, words[1:]))

    found = {}
    for name, template in (templates or c.TEMPLATES).items():
        h = grams(c.normal(template).split())
        units = [grams(w) for w in lines]
        touching = [i for i, g in enumerate(units) if g and 2 * len(g & h) >= len(g)]
        if len(lines) > 1:
            units.append(grams([w for line in lines for w in line]))
        groups = []
        for i in touching:
            if groups and i - groups[-1][-1] <= c.GAP + 1:
                groups[-1].append(i)
            else:
                groups.append([i])
        units += [grams([w for line in lines[g[0] : g[-1] + 1] for w in line]) for g in groups]
        best = max((2 * len(g & h) / (len(g) + len(h)) for g in units if g), default=0)
        if best >= threshold:
            found[name] = best
    best = min(((-d, n) for n, d in found.items()), default=(0, None))
    return len(lines), len(found), ",".join(sorted(found)), best[1], round(-best[0], 6)


def test_equals_brute_force(spark, make_prose, odd_texts):
    rng = random.Random(9)
    texts = list(odd_texts)
    for template in c.TEMPLATES.values():
        words = template.split()
        for drop in (0, 1, max(1, len(words) // 12), len(words) // 4):
            cut = list(words)
            for _ in range(drop):
                cut.pop(rng.randrange(len(cut)))
            texts.append(make_prose(rng, 12) + "\n" + " ".join(cut).upper() + "\n" + make_prose(rng, 5))
        texts.append("\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)))
    docs = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id long, text string, lines string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in c.scan(docs).collect()}
    assert len(rows) == len(texts)
    for i, x in enumerate(texts):
        assert rows[i] == brute(x), x
    assert sum(r[1] > 0 for r in rows.values()) > 40
    assert c.scan(docs.limit(0)).count() == 0


def test_notices_wrapped_within_longer_texts(spark, make_prose):
    rng = random.Random(2)
    texts, names = [], [n for n, t in c.TEMPLATES.items() if len(t.split()) > 12]
    for name in names:
        words = c.TEMPLATES[name].split()
        width = rng.randint(6, 11)
        block = [" * " + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
        if len(words) > 40:
            block.insert(len(block) // 2, " * Copyright (c) 2020 Some Body Else")
        prose = [make_prose(rng, rng.randint(5, 15)) for _ in range(40)]
        texts.append("\n".join([*prose, "/*", *block, " */", *prose]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in c.scan(docs).collect()}
    for i, name in enumerate(names):
        assert rows[i] == brute(texts[i])
        assert name in rows[i][2].split(",")


def test_long_repeated_notices_are_found(spark):
    texts = [" ".join([c.TEMPLATES["MIT-text"]] * 6), "\n".join(["All rights reserved."] * 400), " ".join(f"software{i} reserved" for i in range(500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in c.scan(docs).collect()}
    assert [rows[i] for i in range(3)] == [brute(x) for x in texts]
    assert rows[0][1:3] == (1, "MIT-text") and rows[1][2] == "All-Rights-Reserved" and rows[2][1] == 0


def test_repeated_rows_null_ids_and_own_templates(spark):
    rows = [(1, "Do as you like."), (1, "Do as you like."), (1, "no"), (None, "Do as you like."), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = c.scan(docs, {"own": "Do as you like."}).collect()
    assert sorted((r["doc_id"] or -1, r["n_matches"], r["best_license"] or "") for r in got) == [(-1, 0, ""), (-1, 1, "own"), (1, 0, ""), (1, 1, "own"), (1, 1, "own"), (2, 0, "")]


def test_needed_words_lose_nothing():
    own = {n: c.bigrams(t) for n, t in c.TEMPLATES.items()}
    needed = set(c.needed_words(own, c.THRESHOLD))
    rng = random.Random(1)
    for grams in own.values():
        must = -(-len(grams) * 2 // 3)
        for _ in range(50):
            assert any(needed & set(g.split()) for g in rng.sample(grams, must))
