import math
import random
from collections import Counter, defaultdict

import numpy as np
from lexarium.llm import ppm


class Plain:
    """PPM by dictionaries, byte by byte."""

    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        for t in texts:
            cells = [0] * ppm.ORDER + list(t.encode()) + [ppm.END]
            for p in range(ppm.ORDER, len(cells)):
                for k in range(ppm.ORDER + 1):
                    self.seen[k][tuple(cells[p - k : p])][cells[p]] += 1

    def probability(self, context, symbol):
        out, gone = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            own = self.seen[k].get(tuple(context[len(context) - k :]))
            if own is None:
                continue
            rest = {s: c for s, c in own.items() if s not in gone}
            if not rest:
                continue
            total = sum(rest.values()) + len(rest)
            if symbol in rest:
                return out + math.log10(rest[symbol] / total)
            out += math.log10(len(rest) / total)
            gone |= set(rest)
        return out - math.log10(ppm.SYMBOLS - len(gone))

    def score(self, t):
        cells = [0] * ppm.ORDER + list((t or "").encode()) + [ppm.END]
        return sum(self.probability(cells[p - ppm.ORDER : p], cells[p]) for p in range(ppm.ORDER, len(cells)))


def corpus(make_prose, odd_texts):
    rng = random.Random(3)
    return [t if t is None or len(t) < 300 else t[:300] for t in odd_texts] + [make_prose(rng, rng.randint(1, 40)) for _ in range(40)]


def test_scores_equal_plain_ppm_and_base(spark, make_prose, odd_texts):
    texts = corpus(make_prose, odd_texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    held = ppm.crc_bucket(ppm.F.col("doc_id"), 10) == 0
    rows = {r["doc_id"]: r for r in ppm.score(docs, held).collect()}
    small = {r["doc_id"]: r for r in ppm.score(docs, held, shard=200).collect()}
    learn = [t or "" for i, t in enumerate(texts) if not rows[i]["held_out"]]
    assert 0 < len(learn) < len(texts) == len(rows)
    plain = Plain(learn)
    counts = Counter(w for t in learn for w in t.encode().lower().split())
    counts[None] = len(learn)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        r = rows[i]
        tokens = [*(t or "").encode().lower().split(), None]
        assert r["n_tokens"] == len(tokens) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)) < 1e-6 * len(tokens)
        assert abs(r["score"] - plain.score(t)) < 1e-4 * (len((t or "").encode()) + 1)
        assert abs(r["score"] - small[i]["score"]) < 1e-4 * (len((t or "").encode()) + 1)
        assert r["n_known"] == small[i]["n_known"]


def test_probabilities_sum_to_one(make_prose):
    rng = random.Random(4)
    texts = [make_prose(rng, 30) for _ in range(10)]
    cells, start, stop = ppm.cells_of(texts)
    good = ppm._scored_cells(len(cells), start, stop)
    keys, n = np.unique(ppm.keys_of(cells, ppm.ORDER, len(cells))[good[ppm.ORDER :]], return_counts=True)
    low, m = ppm._grouped(keys & np.uint64((1 << 17) - 1), n)
    trie = ppm.Trie(keys, n, (low, m), None)
    for context in (b"the o", b"zzzzz", b"\0\0\0\0\0", b"tion "):
        head = np.uint64(0)
        for b in context:
            head = head << np.uint64(8) | np.uint64(b)
        every = head << np.uint64(9) | np.arange(ppm.SYMBOLS, dtype=np.uint64)
        assert abs((10 ** trie.log10(every)).sum() - 1) < 1e-5


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc"), (None, None)], "doc_id long, text string")
    rows = ppm.score(docs, ppm.F.lit(True)).collect()
    assert len(rows) == 2
    assert abs(min(r["score"] for r in rows) + 4 * math.log10(ppm.SYMBOLS)) < 1e-4
    assert ppm.score(docs.limit(0), ppm.F.lit(False)).count() == 0
