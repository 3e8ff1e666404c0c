"""Document fingerprints: a Merkle tree over segments, paragraphs and sections of each text.

A paragraph is a line that is not blank. Its leaves are its sentences, cut
further at 24 words; a paragraph's hash is that of its leaves, a section's that
of its paragraphs, the root's that of its sections and of the exact text. A
section ends at a blank line, or after a paragraph whose hash is 0 modulo 8, so
that an edit moves no later border.

The fingerprint is ``root|section:leaf.weight,leaf.weight;section:...``: equal
roots mean equal texts, and differing sections and leaves locate an edit.
``likeness`` is the Dice coefficient of the leaves' weights (their characters),
1 for equal roots, and 0 where only one text is empty.

Null is the empty text. An empty table gives no rows. Rows of one doc_id stand in the order of their texts;
a null doc_id comes first. Very long texts are hashed whole. Further columns do
not enter.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import table, text_or_empty

LEAF_WORDS = 24
SECTION_EVERY = 8
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def leaves_of(paragraph: str) -> list[str]:
    out = []
    for sentence in _SENTENCE.split(paragraph.strip()):
        words = sentence.split()
        if len(words) <= LEAF_WORDS:
            out.append(sentence)
        else:
            out += [" ".join(words[i : i + LEAF_WORDS]) for i in range(0, len(words), LEAF_WORDS)]
    return [x for x in out if x]


def merkle(text: str) -> str:
    sections: list[list[tuple[str, list[str]]]] = [[]]
    digest = xxhash.xxh3_64_hexdigest
    for paragraph in text.split("\n"):
        leaves = leaves_of(paragraph)
        if not leaves:
            sections.append([])
            continue
        own = [f"{digest(x)[:10]}.{len(x):x}" for x in leaves]
        top = digest(",".join(own))
        sections[-1].append((top, own))
        if int(top, 16) % SECTION_EVERY == 0:
            sections.append([])
    shown = []
    for section in sections:
        if section:
            shown.append(f"{digest(','.join(top for top, _ in section))[:12]}:{','.join(x for _, own in section for x in own)}")
    exact = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    root = hashlib.blake2b(exact + "".join(x.partition(":")[0] for x in shown).encode(), digest_size=16).hexdigest()
    return f"{root}|{';'.join(shown)}"


def leaf_weights(fingerprint: str) -> Counter:
    out: Counter = Counter()
    for section in fingerprint.partition("|")[2].split(";"):
        for leaf in section.partition(":")[2].split(","):
            if leaf:
                out[leaf] += int(leaf.rpartition(".")[2], 16)
    return out


def _dice(a: str, b: str, of_a: Counter, of_b: Counter) -> float:
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    total = sum(of_a.values()) + sum(of_b.values())
    if not total:
        return 0.0
    small, large = (of_a, of_b) if len(of_a) <= len(of_b) else (of_b, of_a)
    return 2.0 * sum(min(w, large[k]) for k, w in small.items() if k in large) / total


def likeness(a: str, b: str) -> float:
    return _dice(a, b, leaf_weights(a), leaf_weights(b))


def differing_sections(a: str, b: str) -> list[str]:
    """Section hashes of ``b`` that ``a`` lacks: where an edit lies."""
    there = {x.partition(":")[0] for x in a.partition("|")[2].split(";")}
    return [x.partition(":")[0] for x in b.partition("|")[2].split(";") if x and x.partition(":")[0] not in there]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each document with the text that follows it in its stretch of doc_ids."""
    held = None
    for rows in batches:
        for part, border, doc_id, text in zip(*(c.to_pylist() for c in rows.columns)):
            if held is not None:
                if held[0] != part:
                    raise ValueError(f"stretch {held[0]} lacks its border row")
                yield held[2], held[3], text
            held = None if border else (part, border, doc_id, text)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
    made, last = [], ("", "", Counter())

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    def tree(text):
        mark = merkle(text)
        return text, mark, leaf_weights(mark)

    for doc_id, text, following in _pairs(batches):
        own = last if last[0] == text and last[1] else tree(text)
        last = tree(following)
        new = edited(text, following)
        _, mark, weights = tree(new)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        made.append((doc_id, len(text), sha, own[1], mark, _dice(own[1], mark, own[2], weights), _dice(own[1], last[1], own[2], last[2])))
        if len(made) >= 1000:
            yield flush()
            made = []
    if made:
        yield flush()


def with_next(docs: DataFrame) -> DataFrame:
    """(stretch, border, doc_id, text) so dealt and sorted that each row's next document is the row below it.

    Stretches are ranges of doc_id between quantiles. The first document of a
    stretch goes as a border row to the end of the stretch before it (that of
    the first stretch to the last one), so no window over all rows is needed;
    only one short id per stretch reaches the driver.
    """
    spark = docs.sparkSession
    wanted = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    stretch = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_bucket(cuts))
    # the first id of each stretch that has rows: at most one row for each shuffle partition
    least = rows.select(stretch.alias("s"), "doc_id").groupBy("s").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("doc_id")).orderBy("s").collect()
    if not least:
        return rows.select(F.lit(0).alias("stretch"), F.lit(False).alias("border"), "doc_id", "text")
    full = [r["s"] for r in least]
    before = {s: full[i - 1] for i, s in enumerate(full)}
    is_first = F.lit(False)
    ids = [r["doc_id"] for r in least if r["doc_id"] is not None]
    if ids:
        is_first = is_first | F.coalesce(F.col("doc_id").isin(ids), F.lit(False))
    if any(r["doc_id"] is None for r in least):
        is_first = is_first | F.col("doc_id").isNull()
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    # several rows may share the first id: the least text of them is the first
    borders = (
        rows.where(is_first).withColumn("s", stretch).groupBy("s", "doc_id").agg(F.min("text").alias("text"))
        .select(to[F.col("s")].alias("stretch"), F.lit(True).alias("border"), "doc_id", "text")
    )
    own = rows.select(stretch.alias("stretch"), F.lit(False).alias("border"), "doc_id", "text")
    return (
        own.union(borders).repartitionById(wanted, "stretch")
        .sortWithinPartitions("stretch", "border", F.col("doc_id").asc_nulls_first(), "text")
    )


def _bucket(cuts: list[int]):
    """Number of cuts below or at the id, by halving: a search of log2(n) comparisons."""

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def fingerprints(docs: DataFrame) -> DataFrame:
    return with_next(docs).mapInArrow(_fingerprint_rows, SCHEMA)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
