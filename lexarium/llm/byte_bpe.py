"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The ranks of a byte-level vocabulary are written as a sentencepiece BPE model:
each token's bytes become one visible character each (the usual byte map), its
score is the negative rank, and normalisation is the identity. Pre-tokens are
encoded by that model; ids decode by the inverse byte map.

Null and empty texts have no tokens and decode to nothing. Repeated rows are
encoded alike, very long texts whole. Further columns of the input are kept by
``encode`` unless they bear an output column's name, which the output replaces.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import spread, table, text_or_empty

#: Pre-tokens that a Python worker remembers with their ids; then it starts anew.
CACHE = 200_000
#: Documents whose new pre-tokens are encoded in one call, and whose results are held together.
GROUP = 128
ROWS_OUT = 4 * GROUP
#: A vocabulary file is broadcast; one that is larger than this is refused.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_map() -> list[str]:
    """The visible character of each byte: itself if it is printable Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    import struct

    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model: piece 0 is unknown, piece r + 1 the token of rank r with score -r."""
    chars = byte_map()
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        shown = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, shown) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of ``base64 rank`` lines on the driver."""
    with open(path, "rb") as lines:
        data = lines.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    ranked = {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in data.splitlines() if x.strip())}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranked[r] for r in range(len(ranked))]


class Codec:
    """Encodes pre-tokens by the sentencepiece model and decodes ids by the inverse map."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.find = regex.compile(pattern).findall
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_map())})
        back = {c: b for b, c in enumerate(byte_map())}
        # inverse mapping: each id's piece, character by character back to bytes
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i + 1)) for i in range(len(tokens))]
        self.seen: dict[str, tuple[str, bytes]] = {}
        self.whole = {token: rank for rank, token in enumerate(tokens)}

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.seen]
        if not fresh:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        for word, data, ids in zip(fresh, raw, self.model.encode([b.decode("latin-1").translate(self.shown) for b in raw], num_threads=1)):
            rank = self.whole.get(data)
            ids = [rank] if rank is not None else [i - 1 for i in ids]
            self.seen[word] = (" ".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids]))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """(ids joined by a space, the bytes that they decode to) of each text."""
        for lo in range(0, len(texts), GROUP):
            cut = [self.find(t or "") for t in texts[lo : lo + GROUP]]
            if len(self.seen) > CACHE:
                self.seen.clear()
            self.learn(set().union(*cut))
            at = self.seen.__getitem__
            for words in cut:
                found = list(map(at, words))
                yield " ".join([f[0] for f in found]), b"".join([f[1] for f in found])


_CODECS: dict[tuple, Codec] = {}


def codec_of(tokens: list[bytes], pattern: str) -> Codec:
    """One codec for each Python worker: its tasks share the model and what it remembers."""
    key = (hashlib.sha256(b"\n".join(tokens)).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def _worker(tokens_on, pattern: str, out: pa.Schema, ids_wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokens_on.value, pattern)
        for rows in (whole.slice(at, ROWS_OUT) for whole in batches for at in range(0, whole.num_rows, ROWS_OUT)):
            made: list[list] = [[] for _ in range(3 + ids_wanted)]
            for ids, decoded in codec.encode(rows.column(rows.num_columns - 1).to_pylist()):
                row = [ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                # token ids as machine integers: as objects they'd take ten times the memory
                for column, value in zip(made, row + [np.array(ids.split(), dtype=np.int32)] * ids_wanted):
                    column.append(value)
            arrays = [rows.column(i) for i in range(rows.num_columns - 1)] + [pa.array(c, f.type) for c, f in zip(made, list(out)[rows.num_columns - 1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out])

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` (without text unless ``keep_text``) with n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, the token ids themselves."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    new = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    new += [StructField("token_ids", ArrayType(IntegerType()))] * ids
    names = {f.name.lower() for f in new}
    own = [c for c in docs.columns if c.lower() not in names and (keep_text or c.lower() != "text")]
    # under names of their own, columns that are called like the operator's stay what they were
    kept = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(own)], text_or_empty().alias("__text"))
    schema = StructType(list(kept.schema)[:-1] + new)
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    encoded = kept.mapInArrow(_worker(tokens, pattern, to_arrow_schema(schema), ids), schema)
    return encoded.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(own)], *[f.name for f in new])


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)
