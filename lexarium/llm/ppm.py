"""LM scoring by prediction by partial matching (PPM) over bytes.

A byte-context trie of order ``ORDER`` is counted over all learning texts: Spark
sums the counts of every (context, byte) pair. Escapes are estimated as in
method C (a context with q distinct successors in n visits escapes with
q / (n + q)), and after an escape the bytes that the longer context knows are
excluded. A text's score is the sum, over its bytes and an end mark, of the
log10 probability of each after the longest known context, so it is the log10
probability of the text under a model that was learnt once (pretrained).

The trie is scored in shards of at most about ``SHARD`` (context, byte) pairs, by the
last two bytes of the context; orders 0 and 1 (at most 66,049 pairs) are
in every shard. A corpus whose trie fits one shard is scored in one pass over
the texts; a larger one takes a pass for each shard, and the parts of a text's
score are added. So a broadcast has a fixed bound, and no count is dropped.

The base is a unigram of words. Tokens that make up at least a millionth of all
(so at most a million of them) are broadcast; the other tokens of each text are
joined to the counts.

Null and empty texts are one end mark. An empty table gives no rows. Nothing is ranked, so
there are no ties. Rows with equal ids are scored each for
itself; a null doc_id is learnt from and scored. Very long texts are scored
whole, in slices. Further columns do not enter. With no learning text every
byte has the same probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import crc_bucket, durable, spread, table, text_or_empty

ORDER = 5
END = 256
SYMBOLS = 257
SHARD = 4_000_000
HEAVY = 1_000_000
#: Cells that are scored at once, distinct pairs that a task holds before it sends them on.
SLICE = 1 << 19
HELD = 1_000_000
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def cells_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each after ORDER zero cells and before an END cell; where each begins and ends."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    gap = b"\0" * (ORDER + 1)
    joined = b"\0" * ORDER + gap.join(data) + b"\0"
    size = np.array([len(d) for d in data], dtype=np.int64)
    start = np.cumsum(size + ORDER + 1) - size - 1
    cells = np.frombuffer(joined, np.uint8).astype(np.uint16)
    cells[start + size] = END
    return cells, start, start + size + 1


def keys_of(cells: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For cells lo..hi (lo >= ORDER): the ORDER bytes before each and the cell itself, in one number."""
    key = np.zeros(hi - lo, dtype=_U)
    for back in range(ORDER, 0, -1):
        key <<= _U(8)
        key |= cells[lo - back : hi - back].astype(_U) & _U(255)
    key <<= _U(9)
    key |= cells[lo:hi].astype(_U)
    return key


def _scored_cells(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, dtype=np.int8)
    step[start] += 1
    step[stop] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, null, count) of each (context, byte) and (null, token, count), summed over much of a task."""
    schema = pa.schema([("gram", pa.int64()), ("token", pa.binary()), ("n", pa.int64())])
    tokens: Counter = Counter()
    grams: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        keys = np.concatenate([k for k, _ in grams])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], np.concatenate([c for _, c in grams])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        grams[:] = [(keys[first], np.add.reduceat(n, first))]

    def send() -> Iterator[pa.RecordBatch]:
        if grams:
            merge()
            keys, n = grams.pop()
            for i in range(0, len(keys), 200_000):
                k = keys[i : i + 200_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(n[i : i + 200_000])], schema=schema)
        if tokens:
            names, n = list(tokens), list(tokens.values())
            tokens.clear()
            for i in range(0, len(names), 100_000):
                part = names[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(part, pa.binary()), pa.array(n[i : i + 100_000], pa.int64())], schema=schema)

    for rows in batches:
        texts = rows.column(0).to_pylist()
        for t in texts:
            tokens.update(tokens_of(t))
        for group in _groups(texts, 2 * SLICE):
            cells, start, stop = cells_of(group)
            good = _scored_cells(len(cells), start, stop)
            for lo in range(ORDER, len(cells), 2 * SLICE):
                hi = min(len(cells), lo + 2 * SLICE)
                grams.append(np.unique(keys_of(cells, lo, hi)[good[lo:hi]], return_counts=True))
            if len(grams) > 8:
                merge()
        if len(tokens) > HELD or grams and len(grams[0][0]) > HELD:
            yield from send()
    yield from send()


class Lookup:
    """Places of keys in a hashed order, or -1; values are to be kept in ``order``."""

    def __init__(self, keys: np.ndarray):
        mixed = keys * _MIX
        self.order: np.ndarray | None = np.argsort(mixed, kind="stable").astype(np.int32)
        # a zero stands behind the last, so that a look beyond it is allowed
        self.keys = np.concatenate([mixed[self.order], np.zeros(1, _U)])
        self.bits = max(1, int(np.ceil(np.log2(max(2, len(keys))))))
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << self.bits, dtype=_U) << _U(64 - self.bits)).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(keys))).max()) if len(keys) else 0

    def arranged(self, values: np.ndarray) -> np.ndarray:
        return values.astype(np.float32)[self.order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.keys) - 1
        if not n:
            return np.full(len(keys), -1, dtype=np.int32)
        mixed = keys * _MIX
        at = self.first[(mixed >> _U(64 - self.bits)).astype(np.int64)]
        miss = self.keys[at] != mixed
        miss |= at >= n
        todo = np.flatnonzero(miss)
        step = at[todo]
        at[todo] = -1
        for _ in range(self.most):
            step += 1
            # keys are sorted: beyond the wanted one there is nothing
            live = step < n
            live &= self.keys[np.minimum(step, n)] <= mixed[todo]
            todo, step = todo[live], step[live]
            if not len(todo):
                break
            same = self.keys[step] == mixed[todo]
            at[todo[same]] = step[same]
            todo, step = todo[~same], step[~same]
        return at


def _of_order(key: np.ndarray, order: int) -> np.ndarray:
    """The key with only the last ``order`` context bytes, marked by the order."""
    context = (key >> _U(9)) & _U((1 << 8 * order) - 1)
    return _U(order << 50) | context << _U(9) | key & _U(511)


def _of_context(key: np.ndarray, order: int) -> np.ndarray:
    return _U(order << 50) | ((key >> _U(9)) & _U((1 << 8 * order) - 1)) << _U(9) | _U(511)


def _grouped(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


class Trie:
    """The lookup tables of one shard.

    For each pair of order 0 to ORDER the log10 of its count; for each context:
    its own log denominator and escape, and those of the context one byte
    shorter once the bytes known here are excluded.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], mine: np.ndarray | None):
        """grams, n: of order ORDER; low: the pairs of order 1 of all shards; mine: which pairs of last bytes are in the shard."""
        self.mine = mine
        levels = {1: _grouped(_of_order(low[0], 1), low[1])}
        levels[0] = _grouped(_of_order(low[0], 0), low[1])
        for order in range(2, ORDER + 1):
            levels[order] = _grouped(_of_order(grams, order), n)
        pair_keys, pair_values, contexts = [], [], {k: [] for k in ("key", "size", "escape", "short_size", "short_escape")}
        stats: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for order in range(ORDER + 1):
            keys, count = levels[order]
            head = _of_context(keys, order)
            first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(count, first) if len(keys) else count
            kinds = np.diff(np.append(first, len(keys)))
            stats[order] = (head[first], first, total, kinds)
            pair_keys.append(keys)
            pair_values.append(np.log10(count.astype(np.float64)))
        for order in range(ORDER + 1):
            heads, first, total, kinds = stats[order]
            size = np.log10((total + kinds).astype(np.float64))
            contexts["key"].append(heads)
            contexts["size"].append(size)
            contexts["escape"].append(np.log10(kinds.astype(np.float64)) - size)
            if order == 0:
                left = np.maximum(SYMBOLS - kinds, 1).astype(np.float64)
                short_size, short_escape = np.log10(left), np.zeros(len(heads))
            else:
                keys, _ = levels[order]
                below_keys, below_count = levels[order - 1]
                below_heads, _, below_total, below_kinds = stats[order - 1]
                known = below_count[np.searchsorted(below_keys, _of_order(keys, order - 1))] if len(keys) else below_count
                at = np.searchsorted(below_heads, _of_context(heads, order - 1))
                rest = below_total[at] - (np.add.reduceat(known, first) if len(keys) else known)
                new = below_kinds[at] - kinds
                short_size = np.log10(np.maximum(rest + new, 1).astype(np.float64))
                short_escape = np.where(new > 0, np.log10(np.maximum(new, 1)) - short_size, 0.0)
            contexts["short_size"].append(short_size)
            contexts["short_escape"].append(short_escape)
        self.pairs = Lookup(np.concatenate(pair_keys[:ORDER]))
        self.count = self.pairs.arranged(np.concatenate(pair_values[:ORDER]))
        self.contexts = Lookup(np.concatenate(contexts["key"]))
        for name in ("size", "escape", "short_size", "short_escape"):
            setattr(self, name, np.append(self.contexts.arranged(np.concatenate(contexts[name])), np.float32(0)))  # the last stands for no context
        # the common case in one look: the whole probability of a pair of the highest order
        keys, _ = levels[ORDER]
        heads = stats[ORDER][0]
        own = np.repeat(contexts["size"][ORDER], stats[ORDER][3]) if len(heads) else np.zeros(0)
        self.top = Lookup(keys)
        self.top_value = self.top.arranged(pair_values[ORDER] - own)
        self.pairs.order = self.contexts.order = self.top.order = None

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte after its context."""
        out = np.zeros(len(key))
        at = self.top.find(_of_order(key, ORDER))
        hit = at >= 0
        out[hit] = self.top_value[at[hit]]
        todo = np.flatnonzero(~hit)
        key = key[todo]
        gone = np.zeros(len(todo))
        # the context above: -1 while none was known, so that nothing is excluded
        above = self.contexts.find(_of_context(key, ORDER))
        gone += np.where(above >= 0, self.escape[above], 0.0)
        for order in range(ORDER - 1, -1, -1):
            if not len(todo):
                return out
            pair = self.pairs.find(_of_order(key, order))
            here = self.contexts.find(_of_context(key, order))
            size = np.where(above >= 0, self.short_size[above], np.where(here >= 0, self.size[here], 0.0))
            hit = pair >= 0
            out[todo[hit]] = gone[hit] + self.count[pair[hit]] - size[hit]
            gone += np.where(above >= 0, self.short_escape[above], np.where(here >= 0, self.escape[here], 0.0))
            todo, key, gone, above = todo[~hit], key[~hit], gone[~hit], np.where(here >= 0, here, above)[~hit]
        out[todo] = gone - np.where(above >= 0, self.short_size[above], np.log10(SYMBOLS))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        cells, start, stop = cells_of(texts)
        out = np.zeros(len(texts))
        good = _scored_cells(len(cells), start, stop)
        for lo in range(ORDER, len(cells), SLICE):
            hi = min(len(cells), lo + SLICE)
            own = good[lo:hi].copy()
            key = keys_of(cells, lo, hi)
            if self.mine is not None:
                own &= self.mine[((key >> _U(9)) & _U(0xFFFF)).astype(np.int64)]
            part = np.zeros(hi - lo + 1)
            part[1:][own] = self.log10(key[own])
            part = np.cumsum(part)
            i, j = int(np.searchsorted(stop, lo, "right")), int(np.searchsorted(start, hi, "left"))
            out[i:j] += part[np.minimum(stop[i:j], hi) - lo] - part[np.maximum(start[i:j], lo) - lo]
        return out


def _groups(texts: list[str], most: int) -> Iterator[list[str]]:
    """Neighbouring texts of together about ``most`` characters, or one longer text."""
    own: list[str] = []
    room = most
    for t in texts:
        if own and len(t) > room:
            yield own
            own, room = [], most
        own.append(t)
        room -= len(t) + ORDER + 1
    if own:
        yield own


class Words:
    """The unigram base for tokens that are broadcast."""

    def __init__(self, heavy: dict[bytes, int], total: int, distinct: int):
        self.size = float(np.log10(total + 0.1 * (distinct + 1)))
        self.known = {t: float(np.log10(c + 0.1)) - self.size for t, c in heavy.items()}


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>"


def _score_rows(trie_on, words_on):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_on.value
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
        for rows in batches:
            texts = rows.column(2).to_pylist()
            score = np.concatenate([trie.scores(group) for group in _groups(texts, 2 * SLICE)]) if texts else np.zeros(0)
            if words_on is None:
                n = len(texts)
                columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), score, pa.nulls(n, schema.field(6).type), pa.nulls(n, schema.field(7).type)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), columns[0], columns[0], columns[1], pa.array(score), *columns[3:]], schema=schema)
                continue
            get = words_on.value.known.get
            n_tokens, n_known, base, rare, times = [], [], [], [], []
            for t in texts:
                tokens = tokens_of(t)
                found = [get(w) for w in tokens]
                other: Counter = Counter(w for w, f in zip(tokens, found) if f is None) if None in found else Counter()
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(tokens) - sum(other.values()))
                base.append(sum(f for f in found if f is not None))
                rare.append(list(other))
                times.append(list(other.values()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, schema.field(i + 2).type) for i, c in enumerate((n_tokens, n_known, base, score, rare, times)))], schema=schema)

    return run


def _counts(learn: DataFrame) -> DataFrame:
    part = learn.select(text_or_empty().alias("text")).mapInArrow(_count_rows, "gram long, token binary, n long")
    return durable(part.groupBy("gram", "token").agg(F.sum("n").alias("n")))


def _shards(counts: DataFrame, size: int) -> list[list[int]]:
    """Pairs of last context bytes, dealt so that each shard has about ``size`` pairs at most; at most 65,536 rows are read."""
    by_tail = counts.where("gram is not null").groupBy(F.shiftright("gram", 9).bitwiseAND(0xFFFF).alias("tail")).count().orderBy(F.desc("count"), "tail").collect()
    n = max(1, -(-sum(r["count"] for r in by_tail) // size))
    shards: list[list[int]] = [[] for _ in range(n)]
    load = [0] * n
    for r in by_tail:
        k = load.index(min(load))
        shards[k].append(r["tail"])
        load[k] += r["count"]
    return shards


def _trie(counts: DataFrame, shards: list[list[int]], k: int) -> Trie:
    """Shard ``k``; the first also answers for tails that no learning text has."""
    grams = counts.where("gram is not null")
    low = grams.groupBy(F.col("gram").bitwiseAND((1 << 17) - 1).alias("gram")).agg(F.sum("n").alias("n"))
    mine = None
    if len(shards) > 1:
        mine = np.full(1 << 16, k == 0)
        for other, tails in enumerate(shards):
            mine[tails] = other == k
        tails = shards[k]
        grams = grams.join(F.broadcast(counts.sparkSession.createDataFrame([(t,) for t in tails], "tail long")), F.shiftright("gram", 9).bitwiseAND(0xFFFF) == F.col("tail"))
    own = _columns(grams)
    return Trie(*own, _columns(low), mine)


def _columns(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = grams.select("gram", "n").toArrow()
    return rows["gram"].to_numpy().view(_U), rows["n"].to_numpy()


def score(docs: DataFrame, held_out: Column, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty().alias("text"))
    learn = rows.where(~F.col("held_out"))
    counts = _counts(learn)
    ends = learn.count()
    words = counts.where("token is not null").select("token", "n")
    n, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = n + ends, kinds + (ends > 0)
    heavy = {bytes(r["token"]): r["n"] for r in words.where(F.col("n") * HEAVY >= total).toLocalIterator()} if total else {}
    base = Words(heavy, total, distinct)
    shards = _shards(counts, shard)
    tries = [spark.sparkContext.broadcast(_trie(counts, shards, k)) for k in range(len(shards))]
    own = spark.sparkContext.broadcast(base)
    if len(shards) == 1:
        parts = durable(rows.mapInArrow(_score_rows(tries[0], own), SCORED).withColumn("__row", F.monotonically_increasing_id()))
    else:
        numbered = durable(rows.withColumn("__row", F.monotonically_increasing_id()))
        runs = [numbered.select(F.col("__row").alias("doc_id"), "held_out", "text").mapInArrow(_score_rows(trie, own if k == 0 else None), SCORED) for k, trie in enumerate(tries)]
        added = runs[0].select(F.col("doc_id").alias("__row"), "score")
        for r in runs[1:]:
            added = added.union(r.select(F.col("doc_id").alias("__row"), "score"))
        added = added.groupBy("__row").agg(F.sum("score").alias("score"))
        first = runs[0].select(F.col("doc_id").alias("__row"), "n_tokens", "n_known", "base", "rare", "times")
        parts = durable(numbered.select("__row", "doc_id", "held_out").join(first, "__row").join(added, "__row"))
    size = F.lit(base.size)
    rare = parts.where(F.size("rare") > 0).select("__row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("__row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    light = words.where(F.col("n") * HEAVY < total)
    rest = (
        rare.join(light, "token", "left")
        .groupBy("__row").agg(
            F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) - size)).alias("more"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        )
    )
    end = F.lit(float(np.log10(ends + 0.1)) - base.size)
    return parts.join(rest, "__row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0)) + end).alias("base_score"), "score",
    )


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score(docs, F.coalesce(crc_bucket(F.col("doc_id"), 10) == 0, F.lit(False)))
