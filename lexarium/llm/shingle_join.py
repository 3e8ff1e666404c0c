"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of five-word shingles (lower case, cut at white space; a
shorter text is one shingle). Texts with the same words are one class from the
start, named by the hash of the words; its text is that of its first document,
by doc_id and hash of the text.

The MinHash signature of a class has ``DEPTH`` values in each of ``TREES``
trees. A tree is a sorted prefix trie: Spark sorts the entries (tree, values,
class) over its partitions, so that classes with a common prefix stand
together, however many they are. Classes meet first where they share all
``DEPTH`` values of some tree. What meets is compared exactly, and the
similarities of the links found so tell how many links prefixes of that length
miss: a pair of similarity s shares a prefix of d values in some tree with
probability 1 - (1 - s^d)^TREES. While the share that is missed exceeds
1 - ``RECALL``, prefixes are shortened to the most values at which those
similarities reach the recall, and what meets then is compared too.

Classes of a trie node of at most ``SMALL`` are tied where chains of pairs that
their sketches don't rule out join them, those of a larger node all to its
first, so candidates grow with the classes, never with their pairs.
Connected candidates form a family, and within each family every pair is
compared exactly, block against block: each block of about ``BLOCK`` classes (fewer
if long) meets each other block in a task of its own, which sends on counts and
a spanning forest, never the pairs. No task holds more than two blocks, and no
link is lost to a cap. A family that a shorter prefix leaves as it was is not
compared again.

Result: one row per document with class_id (least doc_id of its connected
near-duplicates) and n_links (other documents at the threshold or above).

Null, empty and wordless texts are classes of their own without links. Repeated
rows count as documents; rows without doc_id are not compared (class_id null).
Further columns do not enter. An empty table gives an empty result. Very long texts are
read whole; a class of one is a block of its own if it is as long as a block may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.llm._shared import components, durable, spread, table, text_or_empty

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.9999
#: Values of two bits in a class's sketch, and how many two sketches must share; a pair at the threshold shares fewer in one of ten million cases.
SKETCH = TREES * DEPTH
AGREED = 112
SMALL = 32
BLOCK = 256
#: Shingles of a block, on average.
BLOCK_SHINGLES = 500_000
#: Members of families that are broadcast (some 80 bytes each); beyond it their texts are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bins of the similarities of links, from the threshold to 1.
BINS = 20


#: Hashes of words that a worker remembers; beyond HASHED it starts anew.
HASHED = 200_000
_hashed: dict[str, int] = {}


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; none for a text without words."""
    cut = text.lower().split()
    if not cut:
        return np.zeros(0, dtype=np.uint64)
    if len(_hashed) > HASHED:
        _hashed.clear()
    for w in set(cut).difference(_hashed):
        _hashed[w] = xxhash.xxh3_64_intdigest(w)
    one = np.fromiter(map(_hashed.__getitem__, cut), dtype=np.uint64, count=len(cut))
    n = max(1, len(one) - words + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, len(one))):
        mixed = (mixed ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def class_key(text: str) -> int | None:
    """Tells word sequences apart; None without words."""
    cut = text.lower().split()
    return xxhash.xxh3_64_intdigest(" ".join(cut)) - (1 << 63) if cut else None


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that a pair shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def recalls(links: list[int], depth: int) -> dict[int, float]:
    """Of each depth up to ``depth`` the share of links it meets, told from the ``links`` (by bin of similarity) that ``depth`` has met.

    Each link met stands for 1 / chance of them. One more at the threshold is
    added: few links prove little about those that were missed.
    """
    at = [THRESHOLD + k * (1 - THRESHOLD) / BINS for k in range(BINS)]
    weight = [n / chance(s, depth) for n, s in zip(links, at)]
    weight[0] += 1
    return {d: sum(w * chance(s, d) for w, s in zip(weight, at)) / sum(weight) for d in range(1, depth + 1)}


def next_depth(links: list[int], depth: int) -> int:
    """``depth`` if its recall suffices, else the most values that reach it."""
    known = recalls(links, depth)
    return max((d for d, r in known.items() if r >= RECALL), default=1)


class Forest:
    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        self.trees, self.depth = trees, depth
        rng = np.random.default_rng(seed)
        n = self.trees * self.depth
        self.turn = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1) | np.uint32(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Of each of trees * depth hashings of the set the least value, mixed to 16 bits."""
        out = np.full(len(self.turn), np.iinfo(np.uint32).max, dtype=np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(short), 1024):
            some = short[lo : lo + 1024][None, :] ^ self.turn[:, None]
            some *= self.times[:, None]
            np.minimum(out, some.min(axis=1), out=out)
        out *= np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(13)
        return (out & np.uint32(0xFFFF)).astype(np.uint16)

    def entries(self, signature: np.ndarray) -> list[bytes]:
        """Of each tree its number and the class's values there: byte strings whose order is the trie's."""
        grid = signature.reshape(self.trees, self.depth).astype(">u2")
        return [bytes([t]) + grid[t].tobytes() for t in range(self.trees)]


def sketch(signature: np.ndarray) -> bytes:
    """Two bits of each value."""
    two = (signature & 3).astype(np.uint8).reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


_EQUAL_PAIRS = np.array([sum((b >> k & 3) == 0 for k in (0, 2, 4, 6)) for b in range(256)], dtype=np.int16)


def agreements(sketches: np.ndarray) -> np.ndarray:
    """How many values each two sketches (rows of bytes) share."""
    return _EQUAL_PAIRS[sketches[:, None, :] ^ sketches[None, :, :]].sum(axis=2)


def stars(likely: np.ndarray) -> list[tuple[int, int]]:
    """Of each component of a small graph an edge from its first node to each other."""
    left, out = set(range(len(likely))), []
    while left:
        first = min(left)
        left.remove(first)
        line = [first]
        while line:
            near = [b for b in left if likely[line[-1], b]]
            line.pop()
            left.difference_update(near)
            line += near
            out += [(first, b) for b in near]
    return out


SIGNED = "doc long, mark long, cls long, size int, trie array<binary>, sketch binary"


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("cls", pa.int64()), ("size", pa.int32()), ("trie", pa.list_(pa.binary())), ("sketch", pa.binary())])
    seen: dict[int, tuple] = {}
    for rows in batches:
        cells: list[list] = [[], [], [], []]
        for text in rows.column(2).to_pylist():
            key = class_key(text)
            if key is None:
                made = (None, None, None, None)
            elif (made := seen.get(key)) is None:
                own = shingles(text)
                signature = forest.signature(own)
                made = (key, len(own), forest.entries(signature), sketch(signature))
                if len(seen) > 2000:
                    seen.clear()
                seen[key] = made
            for cell, value in zip(cells, made):
                cell.append(value)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, f.type) for c, f in zip(cells, list(schema)[2:]))], schema=schema)


MET = "a long, b long, part int, side int, entry binary"


def _met_rows(depth: int):
    """Of sorted entries (entry, rep, sketch) the edges (a, b) among those that share ``depth`` values, and each partition's first and last entry (in a: its class)."""
    width = 1 + 2 * depth
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("side", pa.int32()), ("entry", pa.binary())])

    def edges_of(reps: np.ndarray, sketches: np.ndarray, whole: bool) -> list[tuple[int, int]]:
        if len(reps) < 2:
            return []
        if whole or len(reps) > SMALL:
            return [(int(reps[0]), b) for b in reps[1:].tolist()]
        return [(int(reps[i]), int(reps[j])) for i, j in stars(agreements(sketches) >= AGREED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # the first and the last node of a partition may go on in its neighbours: they are taken whole, and so is the rest of a large node
        held, whole, ends = None, True, []
        for rows in batches:
            if not rows.num_rows:
                continue
            entries, reps = rows.column(0).to_pylist(), rows.column(1).to_numpy()
            if not ends:
                ends.append((entries[0], int(reps[0])))
            ends[1:] = [(entries[-1], int(reps[-1]))]
            keys = np.frombuffer(b"".join(entries), np.uint8).reshape(len(entries), -1)[:, :width]
            sketches = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(len(entries), -1)
            if held is not None:
                keys, reps, sketches = np.concatenate([held[0], keys]), np.concatenate([held[1], reps]), np.concatenate([held[2], sketches])
            bounds = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            found = []
            for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
                if k < len(bounds) - 2:
                    lo, hi = bounds[k], bounds[k + 1]
                    found += edges_of(reps[lo:hi], sketches[lo:hi], whole and k == 0)
            if len(bounds) > 2:
                whole = False
            lo = bounds[-2]
            if len(keys) - lo > SMALL:
                found += edges_of(reps[lo:], sketches[lo:], True)
                whole = True
                held = keys[lo : lo + 1], reps[lo : lo + 1], sketches[lo : lo + 1]
            else:
                held = keys[lo:], reps[lo:], sketches[lo:]
            yield _edge_batch(found, schema)
        if held is not None:
            yield _edge_batch(edges_of(held[1], held[2], True), schema)
            first, last = ends[0], ends[-1]
            columns = [[first[1], last[1]], [None, None], [part, part], [0, 1], [first[0], last[0]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _edge_batch(edges: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    n = len(edges)
    pairs = np.array(edges, dtype=np.int64).reshape(n, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(n, schema.field(i).type) for i in (2, 3, 4))], schema=schema)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        sets = [shingles(t).tobytes() for t in rows.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *(rows.column(i) for i in range(1, rows.num_columns))], names=["shingles", *rows.schema.names[1:]])


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by matrix products over stretches of the shingles both sides know."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    row_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    row_b = np.repeat(np.arange(len(b)), [len(x) for x in b])
    at_a, at_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
    ok_a = (at_a < len(shared)) & (shared[np.minimum(at_a, len(shared) - 1)] == flat_a) if len(shared) else np.zeros(len(flat_a), bool)
    ok_b = (at_b < len(shared)) & (shared[np.minimum(at_b, len(shared) - 1)] == flat_b) if len(shared) else np.zeros(len(flat_b), bool)
    row_a, at_a, row_b, at_b = row_a[ok_a], at_a[ok_a], row_b[ok_b], at_b[ok_b]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    row_a, at_a, row_b, at_b = row_a[order_a], at_a[order_a], row_b[order_b], at_b[order_b]
    for lo in range(0, len(shared), 4096):
        ia, ja = np.searchsorted(at_a, (lo, lo + 4096))
        ib, jb = np.searchsorted(at_b, (lo, lo + 4096))
        left, right = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        left[row_a[ia:ja], at_a[ia:ja] - lo] = 1
        right[row_b[ib:jb], at_b[ib:jb] - lo] = 1
        out += left @ right.T
    return out


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id in each member's component of a small graph."""
    root = ids.copy()
    while True:
        near = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, near)
        if (new == root).all():
            return root
        root = new


LINKED = "family long, n long, rep long, root long, links long, seen array<long>"


def compare_blocks(pdf):
    """All pairs of one block with another (or of one with itself): per class its partial number of links and a root; last, in a row without class, the links by bin of similarity."""
    import pandas as pd

    i, j, family, n = (int(pdf[c].iloc[0]) for c in ("i", "j", "family", "n"))
    left, right = pdf[pdf["block"] == i], pdf[pdf["block"] != i]
    same = i == j
    names = ["family", "n", "rep", "root", "links", "seen"]
    if not same and (left.empty or right.empty):
        return pd.DataFrame({c: pd.Series([], dtype="object" if c == "seen" else "Int64") for c in names})
    sets_a = [np.frombuffer(t, np.uint64) for t in left["shingles"]]
    sets_b = sets_a if same else [np.frombuffer(t, np.uint64) for t in right["shingles"]]
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    both = _intersections(sets_a, sets_b)
    likeness = both / (size_a[:, None] + size_b[None, :] - both)
    linked = likeness >= THRESHOLD - 1e-7
    if same:
        np.fill_diagonal(linked, False)
        reps, whole = left["rep"].to_numpy(), linked
        links = linked @ left["copies"].to_numpy()
        told = likeness[np.triu(linked)]
    else:
        reps = np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
        k = len(left)
        whole = np.zeros((len(reps), len(reps)), dtype=bool)
        whole[:k, k:], whole[k:, :k] = linked, linked.T
        links = np.concatenate([linked @ right["copies"].to_numpy(), linked.T @ left["copies"].to_numpy()])
        told = likeness[linked]
    seen = np.bincount(np.clip(((told - THRESHOLD) / (1 - THRESHOLD) * BINS).astype(int), 0, BINS - 1), minlength=BINS)
    out = pd.DataFrame({"family": family, "n": n, "rep": reps, "root": _roots(whole, reps), "links": links, "seen": None})
    out = out[out["links"] > 0].astype({"rep": "Int64", "root": "Int64", "links": "Int64"})
    last = pd.DataFrame({"family": [family], "n": [n], "rep": pd.array([None], "Int64"), "root": pd.array([None], "Int64"), "links": pd.array([None], "Int64"), "seen": [seen.tolist()]})
    return pd.concat([out, last], ignore_index=True)[names] if len(out) else last[names]


def _entries(classes: DataFrame) -> DataFrame:
    """The tries: (entry, rep, sketch) sorted over all partitions; equal entries may lie in several."""
    rows = classes.select(F.explode("trie").alias("entry"), "rep", "sketch")
    return durable(rows.repartitionByRange("entry", "rep").sortWithinPartitions("entry", "rep"))


def _met(entries: DataFrame, depth: int) -> DataFrame:
    """(a, b): edges that connect the classes which share ``depth`` values in a tree, unless their sketches rule a pair out."""
    made = durable(entries.mapInArrow(_met_rows(depth), MET))
    # two rows of each partition: few enough for one window
    line = Window.orderBy("part", "side")
    width = 1 + 2 * depth
    ends = made.where("part is not null").select("a", "side", F.substring("entry", 1, width).alias("own"), F.lag("a").over(line).alias("b"), F.lag(F.substring("entry", 1, width)).over(line).alias("before"))
    over = ends.where("side = 0 and own = before").select("a", "b")
    edges = made.where("part is null").select("a", "b").union(over).where("a <> b")
    # a class has at most one first class in each tree; it keeps the least, which is tied to the others: trees that hold the same classes fall together
    tied = edges.groupBy("b").agg(F.collect_set("a").alias("firsts")).select("b", "firsts", F.array_min("firsts").alias("a"))
    return tied.select("a", "b").union(tied.select("a", F.explode("firsts").alias("b")).where("a <> b").distinct())


def _compared(rows: DataFrame, classes: DataFrame, families: DataFrame) -> DataFrame:
    """LINKED rows of ``families`` (rep, family, n, blocks)."""
    members = durable(
        families.join(classes.select("rep", F.col("first.doc").alias("doc"), F.col("first.mark").alias("mark"), "copies"), "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )
    wanted = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    # a class's text is that of its first document; repeated rows of it are equal
    texts = rows.join(wanted, ["doc", "mark"]).select("text", "rep", "copies", "family", "n", "blocks", "block").dropDuplicates(["rep"])
    sets = texts.mapInArrow(_shingle_rows, "shingles binary, rep long, copies long, family long, n long, blocks int, block int")
    dealt = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "shingles", "rep", "copies", "family", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    return durable(dealt.groupBy("family", "i", "j").applyInPandas(compare_blocks, LINKED))


def _links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """LINKED rows of all families, prefixes shortened until the recall is reached."""
    entries = _entries(classes)
    depth, parts = DEPTH, None
    while True:
        named = components(_met(entries, depth)).withColumnRenamed("node", "rep").withColumnRenamed("root", "family").join(classes.select("rep", "size"), "rep")
        sized = named.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        sized = sized.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")).drop("shingles")
        fresh = sized
        if parts is not None:
            # a family keeps its least member and grows: with the same number it is the same
            known = parts.select("family", "n").distinct()
            fresh = sized.join(known, ["family", "n"], "left_anti")
            parts = parts.join(sized.select("family", "n"), ["family", "n"], "left_semi")
        new = _compared(rows, classes, named.select("rep", "family").join(fresh, "family"))
        parts = new if parts is None else durable(parts.union(new))
        seen = {r["bin"]: r["links"] for r in parts.where("seen is not null").select(F.posexplode("seen").alias("bin", "k")).groupBy("bin").agg(F.sum("k").alias("links")).collect()}
        if (shorter := next_depth([seen.get(k, 0) for k in range(BINS)], depth)) == depth:
            return parts.where("rep is not null")
        depth = shorter


def _mark():
    """Tells rows of one doc_id apart: equal texts are equal."""
    return F.xxhash64(text_or_empty())


def _linked_rows(docs: DataFrame) -> DataFrame:
    """(doc, mark, least, n_links) of each row of ``docs`` with a doc_id; least: the first (doc, mark) of its connected near-duplicates."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), _mark().alias("mark"), text_or_empty().alias("text"))
    found = durable(rows.mapInArrow(_signature_rows, SIGNED))
    # signatures are equal within a class; the hash of one word sequence is one class, and names it: a doc_id may have several
    classes = found.where("cls is not null").groupBy("cls").agg(F.min(F.struct("doc", "mark")).alias("first"), F.count("*").alias("copies"), F.min(F.struct("size", "sketch", "trie")).alias("s"))
    classes = durable(classes.select(F.col("cls").alias("rep"), "first", "copies", "s.size", "s.sketch", "s.trie"))
    parts = _links(rows, classes)
    roots = components(parts.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = durable(roots.select(F.col("node").alias("rep"), "root").join(classes.select("rep", "first"), "rep"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.select("rep", "root").join(least, "root").select("rep", "least")
    told = (
        classes.select("rep", "first", "copies").join(named, "rep", "left").join(links, "rep", "left")
        .select(F.col("rep").alias("cls"), F.coalesce("least", "first").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return found.select("doc", "mark", "cls").join(told, "cls", "left").select("doc", "mark", F.coalesce("least", F.struct("doc", "mark")).alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def linked_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of ``docs``."""
    known = _linked_rows(docs).select(F.col("doc").alias("doc_id"), F.col("least.doc").alias("class_id"), "n_links")
    return known.union(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each class, the least doc_id (of its texts there, the first by hash); of repeated rows of it, one."""
    gone = _linked_rows(docs).where("n_links > 0 and (doc <> least.doc or mark <> least.mark)").select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).distinct()
    left = docs.join(gone, (docs["doc_id"].cast("long") == gone["__doc"]) & (_mark() == gone["__mark"]), "left_anti")
    twice = durable(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__doc")).count().where("count > 1").select("__doc"))
    if twice.limit(1).count() == 0:
        return left
    repeated = left["doc_id"].cast("long") == twice["__doc"]
    return left.join(twice, repeated, "left_anti").unionByName(left.join(twice, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: DuckDB: every pair that shares a shingle, counted exactly, and the components of the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-7),
walk(node, pos) AS (SELECT a, b FROM l UNION SELECT node, b FROM walk JOIN l ON a = pos),
c AS (SELECT node, least(node, min(pos)) AS root FROM walk GROUP BY node),
m AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT doc_id, coalesce(root, doc_id) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links FROM documents LEFT JOIN c ON node = doc_id LEFT JOIN m ON a = doc_id
"""
