"""Column functions on text."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StringType, StructField, StructType

#: Terms are ASCII words, digit runs and runs of Han characters.
TERM = "([a-z][a-z0-9_.-]*|[0-9]+|[㐀-鿿]+)"


def _fold(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


#: Texts of a batch that are held as Python's own at once.
TEXTS_AT_ONCE = 200


@F.arrow_udf(StringType())
def casefolded(texts: pa.Array) -> pa.Array:
    """NFKC and case folding, which Spark lacks; ``lower`` differs for letters such as sharp s."""
    def piece(own: pa.Array) -> pa.Array:
        return pa.array((None if (t := x.as_py()) is None else _fold(t) for x in own), pa.string())

    return pa.concat_arrays([piece(texts.slice(lo, TEXTS_AT_ONCE)) for lo in range(0, max(len(texts), 1), TEXTS_AT_ONCE)])


def folded(text: Column) -> Column:
    """``casefolded``, but texts of ASCII characters alone do not go to Python."""
    return F.coalesce(casefolded(F.when(F.length(text) != F.octet_length(text), text)), F.lower(text))


def index_terms(text: Column) -> Column:
    """Terms of folded text; the step per term is taken only where there are Han characters."""
    return F.when(text.rlike("[㐀-鿿]"), terms(text)).otherwise(latin_terms(text))


def terms(text: Column) -> Column:
    """Terms of lower-cased text in order; a Han run becomes its bigrams, a single Han character itself."""
    runs = F.regexp_extract_all(text, F.lit(TERM), F.lit(1))
    return F.flatten(F.transform(runs, lambda t: F.when(t.rlike("^[㐀-鿿]{2,}"), _bigrams(t)).otherwise(F.array(t))))


def _bigrams(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))


def latin_terms(text: Column) -> Column:
    """The same for text without Han characters, without the step per term."""
    return F.regexp_extract_all(text, F.lit("([a-z][a-z0-9_.-]*|[0-9]+)"), F.lit(1))


def search_terms(text: Column) -> Column:
    """Terms, each followed by the distinct parts of two letters or more between its dots and underscores."""
    def with_parts(t: Column) -> Column:
        parts = F.array_distinct(F.filter(F.split(t, "[_.]+"), lambda p: (F.length(p) >= 2) & (p != t)))
        return F.concat(F.array(t), parts)

    return F.flatten(F.transform(terms(text), with_parts))


def readable(html: Column) -> Column:
    """Markup stripped, common references decoded, white space collapsed."""
    bare = F.regexp_replace(html, "<[^>]*>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))


def facets(query: Column, most: int = 4) -> Column:
    """Clauses between ; full-width ; and line breaks without list marks; those beyond ``most`` joined again; a single one is the query."""
    parts = F.filter(F.transform(F.split(query, "[;；\n]+"), lambda p: F.trim(F.regexp_replace(F.trim(p), "^([-*•]|[0-9]+[.)、])[ ]*", ""))), lambda p: p != "")
    tail = F.concat(F.slice(parts, 1, most - 1), F.array(F.array_join(F.slice(parts, most, 2**30), "；")))
    return F.when(F.size(parts) <= 1, F.array(query)).when(F.size(parts) > most, tail).otherwise(parts)


def hex_bucket(text: Column, buckets: int) -> Column:
    """The first four bytes of SHA-256, read as a number, modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long") % buckets


BUCKETS = 512
#: Characters of texts that are counted at once (few enough for the caches of a core), and different characters whose runs are looked up in a table; runs with others go through ``_bucket_of``.
CHARS_AT_ONCE, ALPHABET = 100_000, 160


class _Grams:
    """Buckets of runs of one to three characters, found out once for each run and Python worker."""

    def __init__(self) -> None:
        self.known = np.full(0x110000, -1, np.int64)  # place of a character in the alphabet
        self.letters = np.zeros(0, np.int64)
        self.tables = [np.full(ALPHABET**width, -1, np.int16) for width in (1, 2, 3)]

    def learn(self, points: np.ndarray) -> None:
        new = np.flatnonzero(np.bincount(points[self.known[points] < 0]))[: ALPHABET - len(self.letters)]
        self.known[new] = len(self.letters) + np.arange(len(new))
        self.letters = np.concatenate([self.letters, new])

    def buckets(self, points: np.ndarray, width: int) -> np.ndarray:
        """The bucket of the run that begins at each place but the last ``width`` - 1."""
        n, table = len(points) - width + 1, self.tables[width - 1]
        if n <= 0:
            return np.zeros(0, np.int64)
        places = self.known[points]
        code, inside = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            code = code * ALPHABET + places[i:i + n]
            inside &= places[i:i + n] >= 0
        code[~inside] = 0
        lacking = np.flatnonzero(inside & (table[code] < 0))
        for c, at in zip(*np.unique(code[lacking], return_index=True)):
            start = lacking[at]
            table[c] = _bucket_of("".join(map(chr, points[start:start + width].tolist()))) % BUCKETS
        found = table[code].astype(np.int64)
        for at in np.flatnonzero(~inside).tolist():
            found[at] = _bucket_of("".join(map(chr, points[at:at + width].tolist()))) % BUCKETS
        return found


_GRAMS: list[_Grams] = []


def _bucket_counts(bare: list[str]) -> np.ndarray:
    """Vectors of texts without white space, a row each."""
    if not _GRAMS:
        _GRAMS.append(_Grams())
    points = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    _GRAMS[0].learn(points)
    row = np.repeat(np.arange(0, len(bare) * BUCKETS, BUCKETS), np.fromiter(map(len, bare), np.int64, len(bare)))
    cells = []
    for width in (1, 2, 3):
        n = max(len(points) - width + 1, 0)
        cell = row[:n] + _GRAMS[0].buckets(points, width)
        cells.append(cell[row[:n] == row[width - 1:]] if width > 1 else cell)  # runs do not cross from a text into the next
    vectors = np.bincount(np.concatenate(cells), minlength=len(bare) * BUCKETS).astype(np.float64).reshape(len(bare), BUCKETS)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)


@lru_cache(maxsize=200_000)
def _bucket_of(gram: str) -> int:
    return int.from_bytes(hashlib.sha256(gram.encode("utf-8", "surrogatepass")).digest()[:4], "big")


@F.arrow_udf(ArrayType(FloatType()))
def _hash_vector(texts: pa.Array) -> pa.Array:
    flat, bare, held = [], [], 0

    def count() -> None:
        nonlocal bare, held
        flat.append(_bucket_counts(bare).reshape(-1))
        bare, held = [], 0

    for text in texts:
        bare.append("".join(_fold(text.as_py() or "").split()))
        held += len(bare[-1])
        if held >= CHARS_AT_ONCE or len(bare) >= TEXTS_AT_ONCE:
            count()
    if bare:
        count()
    values = np.concatenate(flat) if flat else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, BUCKETS, dtype=np.int32)), pa.array(values))


def hash_vector(text: Column) -> Column:
    """Unit vector of 512 buckets of the text's runs of one to three characters, folded and without white space; of zeros if there are none."""
    return _hash_vector(text)


def _entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all vectors that aren't null, and how many each vector has; null entries are not a number."""
    if pa.types.is_binary(vectors.type):
        return np.frombuffer(b"".join(vectors.drop_null().to_pylist()), np.float32), pc.fill_null(pc.binary_length(vectors), 0).to_numpy() // 4
    return vectors.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


@F.arrow_udf(BinaryType())
def packed(vectors: pa.Array) -> pa.Array:
    """Each vector as the bytes of its 32-bit floats: one value to a file or a shuffle, not one for each entry."""
    values, sizes = _entries(vectors)
    made = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(_starts(4 * sizes)), pa.py_buffer(np.ascontiguousarray(values, np.float32))])
    return pc.if_else(pc.is_valid(vectors), made, pa.scalar(None, pa.binary()))


@F.arrow_udf(ArrayType(FloatType()))
def unpacked(stored: pa.Array) -> pa.Array:
    """The vectors behind ``packed`` ones."""
    values, sizes = _entries(stored)
    return pa.ListArray.from_arrays(pa.array(_starts(sizes)), pa.array(values), mask=pc.is_null(stored))


#: Different entries that a vector may have for a byte to tell them apart.
LEVELS = 256


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of ``values``, each of so many bytes."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(_starts(sizes)), pa.py_buffer(np.ascontiguousarray(values))])


def _leveled(values: np.ndarray, n: int) -> pa.StructArray:
    """``leveled`` of ``n`` vectors of one length; if one of them has more than LEVELS different entries, all stay as they are."""
    bits = values.view(np.uint32).reshape(n, -1)
    ranked = np.sort(bits, axis=1)
    first = np.ones(bits.shape, bool)
    first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    counts = first.sum(axis=1)
    most = counts.max(initial=0)
    if most > LEVELS:
        return pa.StructArray.from_arrays([_binaries(bits, np.full(n, 4 * bits.shape[1])), pa.nulls(n, pa.binary())], ["levels", "places"])
    levels, places = np.full((n, most), np.iinfo(np.uint32).max, np.uint32), np.zeros(bits.shape, np.uint8)
    levels[np.arange(most) < counts[:, None]] = ranked[first]
    for k in range(most - 1):
        places += bits > levels[:, k:k + 1]
    return pa.StructArray.from_arrays([_binaries(ranked[first], 4 * counts), _binaries(places, np.full(n, bits.shape[1]))], ["levels", "places"])


@F.arrow_udf(StructType([StructField("levels", BinaryType()), StructField("places", BinaryType())]))
def leveled(vectors: pa.Array) -> pa.Array:
    """Each vector as its different entries, in rising order of their bits, and a byte for each entry that says which; without these bytes the entries follow as they are.

    Vectors of counts have few different entries: a file takes two thirds of what it takes with ``packed`` ones.
    """
    values, sizes = _entries(vectors)
    values, starts = np.ascontiguousarray(values, np.float32), _starts(sizes)
    made, lo = [pa.array([], pa.struct([("levels", pa.binary()), ("places", pa.binary())]))], 0
    while lo < len(sizes):
        hi = lo + 1
        while hi < min(len(sizes), lo + TEXTS_AT_ONCE) and sizes[hi] == sizes[lo]:
            hi += 1
        made.append(_leveled(values[starts[lo]:starts[hi]], hi - lo))
        lo = hi
    return pc.if_else(pc.is_valid(vectors), pa.concat_arrays(made), pa.scalar(None, made[0].type))


@F.arrow_udf(BinaryType())
def unleveled(stored: pa.Array) -> pa.Array:
    """``packed`` vectors of ``leveled`` ones."""
    levels, places = (stored.field(c).to_pylist() for c in ("levels", "places"))
    rows = (v if p is None else np.frombuffer(v, np.uint32)[np.frombuffer(p, np.uint8)].tobytes() for v, p in zip(levels, places))
    return pa.array([v if there else None for v, there in zip(rows, pc.is_valid(stored).to_pylist())], pa.binary())


def dimensions(vectors: DataFrame, name: str = "vector") -> Column:
    """How many entries each vector has, be it an array, packed or leveled."""
    if isinstance(vectors.schema[name].dataType, StructType):
        return F.coalesce(F.octet_length(f"{name}.places"), (F.octet_length(f"{name}.levels") / 4).cast("int"))
    return (F.octet_length(name) / 4).cast("int") if vectors.schema[name].dataType == BinaryType() else F.size(name)


@F.arrow_udf(DoubleType())
def norm(vectors: pa.Array) -> pa.Array:
    """Length of each vector, an array or packed, in doubles; null for null, not a number if an entry is null."""
    values, sizes = _entries(vectors)
    there = sizes > 0
    sums = np.zeros(len(sizes))
    if there.all() and len(set(sizes.tolist())) == 1:
        table = values.reshape(len(sizes), -1)
        sums = np.einsum("ij,ij->i", table, table, dtype=np.float64)
    elif there.any():
        sums[there] = np.add.reduceat(np.square(values, dtype=np.float64), _starts(sizes)[:-1][there])
    return pc.if_else(pc.is_valid(vectors), pa.array(np.sqrt(sums)), None)
