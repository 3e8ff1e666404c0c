import random
from itertools import combinations

from lexarium.llm import line_dedup as l


def lines_of(text):
    return [(i, " ".join(x.lower().split())) for i, x in enumerate((text or "").split("\n")) if x.split()]


def blocks(texts, least):
    """Bounds of the stretches of lines with at least ``least`` words."""
    sizes = [len(t.split()) for t in texts]
    return [(i, j) for i, j in combinations(range(len(texts) + 1), 2) if sum(sizes[i:j]) >= least]


def plain_patience(a, b):
    """Recursively: equal heads and tails, then the longest chain of lines unique on both sides."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_patience(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    unique = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    length = []
    for k, (_, y) in enumerate(unique):
        length.append(1 + max((length[m] for m in range(k) if unique[m][1] < y), default=0))
    chain, wanted = [], max(length, default=0)
    for k in reversed(range(len(unique))):  # of equally long chains the one that ends last
        if length[k] == wanted and (not chain or unique[k][1] < chain[0][1]):
            chain.insert(0, unique[k])
            wanted -= 1
    out, at = [], (0, 0)
    for i, j in [*chain, (len(a), len(b))]:
        if chain:
            out += [(x + at[0], y + at[1]) for x, y in plain_patience(a[at[0] : i], b[at[1] : j])]
        at = (i, j)
    return out


def brute(docs):
    """Every block of enough words that any earlier document holds, and what plain patience diff aligns with any of them."""
    known = {key: lines_of(text) for key, text in docs}
    out = {}
    for key in known:
        mine = [t for _, t in known[key]]
        gone, sizes = set(), [len(t.split()) for t in mine]
        stretches = {j: tuple(mine[j[0] : j[1]]) for j in blocks(mine, l.BLOCK_WORDS)}
        for other in sorted(k for k in known if k < key):
            theirs = [t for _, t in known[other]]
            for bounds, block in stretches.items():
                if any(tuple(theirs[i : i + len(block)]) == block for i in range(len(theirs))):
                    gone.update(range(*bounds))
            pairs = plain_patience(theirs, mine)
            while pairs:
                n = 1
                while n < len(pairs) and pairs[n] == (pairs[0][0] + n, pairs[0][1] + n):
                    n += 1
                if sum(sizes[j] for _, j in pairs[:n]) >= l.BLOCK_WORDS:
                    gone.update(j for _, j in pairs[:n])
                pairs = pairs[n:]
        out[key] = sorted(known[key][j][0] for j in gone)
    return out


def corpus(make_prose):
    rng = random.Random(5)
    passages = ["\n".join(make_prose(rng, rng.choice([2, 5, 11, 30, 60])) for _ in range(rng.randint(1, 4))) for _ in range(8)]
    short, twelve = make_prose(rng, 6), make_prose(rng, 12)
    docs = []
    for i in range(50):
        parts = [make_prose(rng, 20) for _ in range(rng.randint(1, 3))] + rng.sample(passages, rng.randint(0, 3)) + [short] * rng.randint(0, 2) + [twelve] * (i % 5 == 0)
        rng.shuffle(parts)
        docs.append((i, "\n".join(parts)))
    docs.append((60, docs[3][1]))
    docs.append((61, "\n".join([passages[0]] * 3)))
    return docs


def test_equals_brute_force(spark, make_prose):
    docs = corpus(make_prose)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    got = {r["doc"]: r["gone"] for r in l.deleted_lines(df).collect()}
    for key, lines in want.items():
        assert got.get(key, []) == lines, key
    assert sum(map(len, want.values())) > 50
    kept = {r["doc_id"]: r["text"] for r in l.dedup(df).collect()}
    for key, text in docs:
        left = [x for i, x in enumerate(text.split("\n")) if i not in set(want[key])]
        if want[key] and not "".join(left).strip():
            assert key not in kept
        else:
            assert kept[key] == "\n".join(left)


def test_alignment_equals_plain_patience():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = l.patience(a, b)
        assert got == plain_patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))


def test_blocks_of_enough_words_are_complete():
    rng = random.Random(7)
    for _ in range(300):
        early, late = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        sizes = [10 + x for x in late]
        gone = set(l.common_lines((early, [10 + x for x in early]), (late, sizes), 25))
        want = set()
        for i, j in combinations(range(len(late) + 1), 2):
            if sum(sizes[i:j]) >= 25 and any(early[k : k + j - i] == late[i:j] for k in range(len(early))):
                want.update(range(i, j))
        assert gone == want


def test_moved_blocks_go_too():
    lines = {c: n for n, c in enumerate("abcdefgh")}
    early, late = [lines[c] for c in "abcde"], [lines[c] for c in "fbcdga"]
    assert l.common_lines((early, [12] * 5), (late, [12] * 6)) == [1, 2, 3, 5]
    assert l.common_lines((early, [4] * 5), (late, [4] * 6)) == [1, 2, 3]  # the moved line alone is too short


def test_other_documents_change_nothing(spark):
    """A block goes if any earlier document holds it, whether or not a third one holds a part of it; and if its lines are all short."""
    line, x, y = " ".join(f"l{i}" for i in range(14)), "five words stand right here", "another five words stand here"
    first, third, second = (1, line), (3, f"third own\n{x}\n{line}\n{y}"), (2, f"second own\n{x}\n{line}\n{y}")
    for docs, want in (([first, second, third], {2: [2], 3: [1, 2, 3]}), ([second, third], {3: [1, 2, 3]})):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert {r["doc"]: r["gone"] for r in l.deleted_lines(df).collect()} == want
    short = "six words are in this line\nand six more are in this\nthe last six words are here"
    df = spark.createDataFrame([(1, "head\n" + short), (2, short + "\ntail")], "doc_id long, text string")
    assert {r["doc"]: r["gone"] for r in l.deleted_lines(df).collect()} == {2: [0, 1, 2]}


def test_odd_rows(spark, odd_texts):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, 1, "a", "b") for i, t in enumerate(odd_texts)] + [(None, long, 1, "", ""), (None, long, 2, "", ""), (50, long, 1, "", ""), (50, long, 1, "", ""), (51, long.upper(), 7, "", ""), (50, "other", 1, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, __gone string, __lines string")
    out = l.dedup(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(r["doc_id"] is None for r in got) == 2
    assert sum(r["doc_id"] == 50 for r in got) == 3 and not [r for r in got if r["doc_id"] == 51]
    assert len(got) == len(rows) - 1 and {(r["__gone"], r["__lines"]) for r in got} == {("a", "b"), ("", ""), ("x", "y")}
    assert l.dedup(df.limit(0)).count() == 0


def test_very_long_text(spark):
    lines = [f"line {i} of a text with enough words to be one of the anchors" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["first", *lines[5:], "last"]))], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in l.dedup(docs).collect()}[2] == "first\nlast"
