"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text.

Texts and items are lower-cased (A-Z) and cut into words of digits, letters and
non-ASCII characters. A window is 10 consecutive item words (all words of a
shorter item). The automaton holds every window; a text is normalised once,
scanned once, and each hit is mapped back to word positions and to character
offsets of the original text.

Null and empty texts have no words and are never contaminated; items without
words have no window. Very long texts are scanned whole. An empty table of texts gives
no rows, an empty benchmark no hits. Repeated rows get equal results; further columns do not
enter. The automaton is broadcast only up to ``MAX_CHARS`` characters of
windows; a larger benchmark is cut by item into parts of at most that size,
each scanned in turn, and the hits of the parts are put together per document row.
The driver holds one part at a time, a worker one automaton.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import durable, spread, table, text_or_empty

WINDOW = 10
#: Characters of windows in one broadcast automaton.
MAX_CHARS = 5_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER_LETTERS = {c: c + 32 for c in range(0x41, 0x5B)}
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Scanner:
    """patterns: normalised window -> item ids (as text)."""

    def __init__(self, patterns: dict[bytes, list[str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for window, items in patterns.items():
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, len(window) + 1, tuple(items)))
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges [from, to), items found."""
        words = words_of(text)
        if not words or not len(self.automaton):
            return len(words), [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), [], set()
        ends = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (n, _, own) in found:
            last = int(np.searchsorted(ends, end))
            items.update(own)
            if ranges and last - n <= ranges[-1][1] and last - n >= ranges[-1][0]:
                ranges[-1] = (ranges[-1][0], max(last, ranges[-1][1]))
            else:
                ranges.append((last - n, last))
        return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets, in the text as it was, of word ranges."""
    import re

    at = [m.span() for m in re.finditer(WORD, text.translate(_LOWER_LETTERS))]
    return [(at[lo][0], at[hi - 1][1]) for lo, hi in ranges]


def _patterns(items: DataFrame, size: int) -> Iterator[dict[bytes, list[str]]]:
    """Windows by part, one part after the other; each has at most MAX_CHARS characters (or one item)."""
    part: dict[bytes, list[str]] = {}
    room = MAX_CHARS
    for item_id, text in items.select(F.col("item_id").cast("string"), text_or_empty()).toLocalIterator():
        own = set(windows_of(words_of(text), size))
        cost = sum(map(len, own))
        if cost > room and part:
            yield part
            part, room = {}, MAX_CHARS
        room -= cost
        for w in own:
            part.setdefault(w, []).append(str(item_id))
    yield part


#: The automaton that a worker built last, by its broadcast: tasks of one pass share it.
_built: dict[str, Scanner] = {}


def scanner_of(key: str, patterns_on) -> Scanner:
    if key not in _built:
        _built.clear()
        _built[key] = Scanner(patterns_on.value)
    return _built[key]


OUT = "__row long, n_words long, hits array<struct<lo:int,hi:int>>, spans array<struct<start:int,stop:int>>, items array<string>"


def _worker(key: str, patterns_on, n_kept: int, schema: pa.Schema, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(key, patterns_on)
        for rows in batches:
            n, hits, at, items = [], [], [], []
            for text in rows.column(n_kept).to_pylist():
                words, ranges, found = scanner.scan(text)
                n.append(words)
                hits.append([{"lo": lo, "hi": hi} for lo, hi in ranges])
                at.append([{"start": a, "stop": b} for a, b in original_spans(text, ranges)] if spans and ranges else [])
                items.append(sorted(found))
            arrays = [rows.column(i) for i in range(n_kept)] + [pa.array(c, schema.field(n_kept + i).type) for i, c in enumerate((n, hits, at, items))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW, spans: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` (without text unless ``keep_text``) with n_words, hits (word ranges), spans (offsets in the text) and items (ids, sorted as text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    made = [f for f in _parse_datatype_string(OUT) if f.name != "__row"]
    names = {f.name for f in made}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    kept = kept.withColumn("__text", text_or_empty())
    if not keep_text:
        kept = kept.drop("text")
    parts = [(uuid.uuid4().hex, spark.sparkContext.broadcast(p)) for p in _patterns(items, size)]
    if len(parts) > 1:
        kept = durable(kept.withColumn("__row", F.monotonically_increasing_id()))
    with_text = kept.select(*[F.col(f"`{c}`") for c in kept.columns if c != "__text"], "__text")
    kept = kept.drop("__text")
    schema = type(kept.schema)(list(kept.schema) + made)
    passes = [with_text.mapInArrow(_worker(key, p, len(kept.columns), to_arrow_schema(schema), spans), schema) for key, p in parts]
    if len(parts) == 1:
        return passes[0]
    found = passes[0].select("__row", "n_words", "hits", "spans", "items")
    for p in passes[1:]:
        found = found.union(p.select("__row", "n_words", "hits", "spans", "items"))
    joined = found.groupBy("__row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return kept.join(joined, "__row").drop("__row")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with the columns of ``docs``."""
    # under names of their own, columns that are called like the scan's stay what they were
    own = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    found = scan(docs.select(*own, text_or_empty().alias("text")), items, size, spans=False, keep_text=False)
    return found.where(F.size("items") == 0).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def covered(ranges: Column) -> Column:
    """Words in sorted ranges [lo, hi), which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(state: Column, r: Column) -> Column:
        new = F.greatest(F.lit(0), r["hi"] - F.greatest(r["lo"], state["upto"]))
        return F.struct((state["n"] + new).cast("long").alias("n"), F.greatest(state["upto"], r["hi"]).alias("upto"))

    return F.aggregate(ranges, start, step)["n"]


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = scan(docs, table(spark, sf_dir, "benchmark"), spans=False, keep_text=False)
    n_hit = covered(F.col("hits"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: DuckDB: document positions whose next words equal a window, by the window's length.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, win.n FROM pos JOIN win USING (n, k)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""
