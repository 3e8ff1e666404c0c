import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexarium.llm import language_id as g

SYLLABLES = {"aa": ["ba", "lo", "mi", "ra", "to", "en"], "bb": ["sch", "ung", "ver", "ein", "öß", "tz"], "cc": ["ción", "que", "ado", "los", "ñar", "en"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def plain(counts, order=g.ORDER):
    """Interpolated Kneser-Ney by dictionaries of strings: a function of (context, character)."""
    raw = [Counter() for _ in range(order + 1)]
    for w, c in counts.items():
        s = f"\x02{w}\x03"
        for i in range(len(s)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0 and i > 0:
                    raw[k][s[i - k + 1:i + 1]] += c
    number = [Counter() for _ in range(order + 1)]
    number[order] = raw[order]
    for k in range(1, order):
        left = Counter(x[1:] for x in raw[k + 1])
        number[k] = Counter({x: raw[k][x] if x[0] == "\x02" else left[x] for x in raw[k]})
    discount, sums, kinds = [0.0] * (order + 1), defaultdict(float), Counter()
    for k in range(1, order + 1):
        n1, n2 = (sum(v == m for v in number[k].values()) for m in (1, 2))
        discount[k] = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
        for x, v in number[k].items():
            sums[k, x[:-1]] += v
            kinds[k, x[:-1]] += 1

    def p(context, c):
        k = len(context) + 1
        lower = p(context[1:], c) if context else 1 / g.ALPHABET
        if not sums[k, context]:
            return lower
        return (max(number[k][context + c] - discount[k], 0) + discount[k] * kinds[k, context] * lower) / sums[k, context]

    def score(word):
        s = f"\x02{word}\x03"
        return sum(math.log(p(s[max(0, i - order + 1):i], s[i])) for i in range(1, len(s)))

    return score


def test_equals_plain_kneser_ney():
    rng = random.Random(2)
    counts = Counter(speak(rng, "bb", 400).split())
    score, model = plain(counts), g.fit(counts)
    words = [*list(counts)[:60], "q", "verq", "öß", "x" * 30, "eintzq漢", "ver" * 20]
    assert g.word_scores(words, [model])[:, 0] == pytest.approx([score(w) for w in words], rel=1e-4)


def test_probabilities_sum_to_one():
    rng = random.Random(3)
    counts = Counter(speak(rng, "cc", 300).split())
    model, letters = g.fit(counts), sorted(set("".join(counts)))
    for context in ("", "ci", "qu", "zz"):
        ends = [f"{context}{c}" for c in letters]
        logs = g.word_scores(ends + [context or "a"], [model])[:, 0]
        assert np.isfinite(logs).all()
    score = plain(counts)
    assert score("que") > score("xyz")


def table(spark, path, rows, schema="doc_id long, text string, lang string, score int, held_out string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return g.op11_language_id(spark, str(path)).collect()


def test_held_out_accuracy_and_odd_texts(spark, tmp_path, odd_texts):
    rng = random.Random(4)
    rows = [(i, speak(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(6, 120)), lang, 1, "x") for i in range(300)]
    rows += [(1000 + i, t, "aa" if i % 2 else None, None, None) for i, t in enumerate(odd_texts)] + [(None, "ba lo", "aa", 1, ""), (2000, "123 !!", "aa", 1, ""), (2001, "²½", None, 1, "")]
    rows += [(3000, rows[0][1], rows[0][2], 1, "")] * 3
    out = table(spark, tmp_path, rows)
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    for doc_id, text, lang, *_ in rows:
        r = got[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["cross_entropy"]) == ("und", 0.0, None)
        else:
            assert r["lang_pred"] in SYLLABLES
        if doc_id is not None and doc_id < 300:
            assert r["lang_pred"] == lang or not r["held_out"]
            assert r["score"] > 0.8


def test_foreign_text_is_rejected(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, speak(rng, lang := "ab"[i % 2] * 2, 80), lang) for i in range(120)], "doc_id long, text string, lang string")
    model = g.train(docs, g.F.lit(True))
    some = spark.createDataFrame([(1, speak(rng, "aa", 60)), (2, speak(rng, "bb", 60)), (3, "щука жила в реке и ела рыбу " * 5), (4, "zxqj wvkk qqxz jjkw " * 8)], "doc_id long, text string")
    assert {r["doc_id"]: r["rejected"] for r in g.identify(some, model).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_empty_tables_and_no_labels(spark, tmp_path):
    assert table(spark, tmp_path / "a", []) == []
    out = table(spark, tmp_path / "b", [(1, "ba lo mi", None, 1, ""), (2, None, None, 1, "")])
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    out = table(spark, tmp_path / "c", [(i, "ba lo mi", "aa", 1, "") for i in range(8)])
    assert {r["lang_pred"] for r in out} == {"aa"}


def test_pieces_of_long_texts_keep_words(monkeypatch):
    monkeypatch.setattr(g, "PIECE", 10)
    text = "alpha beta-gamma déjà " * 7 + "x" * 35 + " end"
    assert g.words_of(text) == Counter(g.WORD.findall(text))
