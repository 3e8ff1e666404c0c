import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from lexarium.llm import byte_bpe


def plain():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken_and_round_trips(spark, odd_texts, make_prose):
    rng = random.Random(1)
    texts = odd_texts + [make_prose(rng, 60) for _ in range(20)] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), 10, 0x1F600])) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = {r["doc_id"]: r for r in byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True).collect()}
    assert len(rows) == len(texts)
    encoding = plain()
    for i, t in enumerate(texts):
        want = encoding.encode_ordinary(t or "")
        assert rows[i]["token_ids"] == want
        assert rows[i]["n_tokens"] == len(want)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert rows[i]["text"] == t


def test_empty_table_and_gapless_ranks(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    bad = tmp_path / "v.tiktoken"
    bad.write_bytes(b"YQ== 0\nYg== 2\n")
    try:
        byte_bpe.read_ranks(str(bad))
    except ValueError:
        return
    raise AssertionError("a gap in the ranks must fail")


def test_columns_called_like_the_operators_own_stay(spark):
    docs = spark.createDataFrame([(1, "ab c", "own", 7)], "doc_id long, text string, __text string, __c0 int")
    (row,) = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert (row["doc_id"], row["text"], row["__text"], row["__c0"]) == (1, "ab c", "own", 7) and row["n_tokens"] == len(plain().encode_ordinary("ab c"))
