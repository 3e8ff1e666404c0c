import random

import corpus_pipeline as p


def test_stages_take_effect(spark, make_prose, tmp_path):
    rng = random.Random(16)
    item = make_prose(rng, 30)
    passage = make_prose(rng, 70)
    texts = [make_prose(rng, 60) for _ in range(120)]
    toxic = {i for i in range(0, 120, 4)}
    for i in toxic:
        cut = texts[i].split()
        for at in (3, 9, 20, 25, 40, 50):
            cut.insert(at, rng.choice(["idiot", "moron"]))
        texts[i] = " ".join(cut)
    texts[1] += "\n" + item
    texts[2] += "\n" + passage
    texts[3] += "\n" + passage
    clean = texts[5].split()
    clean[30] = "changed"
    texts.append(" ".join(clean))
    texts += [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name == "toxicity":
            assert len(ids & toxic) <= 3 and len(ids) >= len(texts) - len(toxic) - 5
        if name == "line dedup":
            assert passage not in now.where("doc_id = 3").first()["text"] and passage in now.where("doc_id = 2").first()["text"]
        if name.startswith("n-gram"):
            assert 120 not in ids and 5 in ids
        if name.startswith("benchmark"):
            assert 1 not in ids
    assert now.count() == p.run(spark, str(tmp_path)).count() > 80


def test_odd_rows_and_an_empty_table(spark, make_prose, odd_texts, tmp_path):
    rng = random.Random(3)
    long = " ".join(make_prose(rng, 40) for _ in range(500))
    same = make_prose(rng, 30)
    rows = [(i, t) for i, t in enumerate([*odd_texts, long])] + [(900, same), (900, same), (901, same), (None, make_prose(rng, 30))]
    docs = spark.createDataFrame([(i, t, "de", None, None, "mine", 0.5, "other") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __gone string, score double, __doc string")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        now = given
        for k, (name, stage) in enumerate(p.STAGES):
            out = stage(spark, now, str(tmp_path))
            assert k == len(p.STAGES) - 1 or out.columns == docs.columns, name
            folder = f"{tmp_path}/{name}-{given is docs}"
            out.write.parquet(folder)
            now = spark.read.parquet(folder)
        ids = [r["doc_id"] for r in now.collect()]
        if given is docs:
            assert ids.count(900) == 1 and 901 not in ids and None in ids and len(odd_texts) in ids
        else:
            assert ids == []
