import hashlib
import random
import re

from lexarium.llm import decontamination as d


def brute(text, items):
    words = re.findall(d.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item_id, item in items:
        own = re.findall(d.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in item or ""))
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def corpus(make_prose, odd_texts):
    rng = random.Random(2)
    items = [(i, make_prose(rng, rng.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(100, None), (101, ""), (102, "?!"), (7, "Ärger über 12 Öl"), (8, "same text")]
    texts = list(odd_texts)
    for _ in range(30):
        item = rng.choice(items)[1] or ""
        cut = item.split()
        part = cut[rng.randint(0, len(cut)) :] if rng.random() < 0.4 else cut
        texts.append(make_prose(rng, 15) + "\n" + ", ".join(part).upper() + " -- " + make_prose(rng, 15))
    return texts, items


def test_query_equals_brute_force(spark, make_prose, odd_texts):
    texts, items = corpus(make_prose, odd_texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in d.scan(docs, bench).collect()}
    hits = 0
    for i, t in enumerate(texts):
        n, n_hit, found = brute(t, items)
        r = rows[i]
        assert (r["n_words"], r["items"]) == (n, found)
        assert len({p for a in r["hits"] for p in range(a["lo"], a["hi"])}) == n_hit
        for span, a in zip(r["spans"], r["hits"]):
            assert [w.decode() for w in d.words_of(t[span["start"] : span["stop"]])] == [w.decode() for w in d.words_of(t)][a["lo"] : a["hi"]]
        hits += n_hit
    assert hits > 50


def test_parts_of_a_large_benchmark_give_the_same(spark, make_prose, odd_texts, monkeypatch):
    texts, items = corpus(make_prose, odd_texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: r for r in d.scan(docs, bench).collect()}
    monkeypatch.setattr(d, "MAX_CHARS", 400)
    parts = {r["doc_id"]: r for r in d.scan(docs, bench).collect()}
    for i in whole:
        assert parts[i]["items"] == whole[i]["items"] and parts[i]["n_words"] == whole[i]["n_words"]
        assert {p for a in parts[i]["hits"] for p in range(a["lo"], a["hi"])} == {p for a in whole[i]["hits"] for p in range(a["lo"], a["hi"])}


def test_filter_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three", "n"), (2, "clean", "n"), (None, None, None)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    kept = d.decontaminate(docs, bench)
    assert kept.dtypes == docs.dtypes and sorted((str(r["doc_id"]), str(r["items"])) for r in kept.collect()) == [("2", "n"), ("None", "None")]
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs, none).count() == 3
    assert d.scan(docs.limit(0), bench).count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
