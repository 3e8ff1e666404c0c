"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character 3- and 4-grams and
of the word itself (hashed into ``BUCKETS`` rows), so an unseen misspelling
shares most of a known word's vectors. A run of over ``LONG`` letters is read
whole, parted at underscores and else in overlapping pieces that count as
words. A text is read in windows of ``WINDOW``
words, each the average of its words' vectors put through a linear softmax; the
text's score is that of its most toxic window, so that a few words in a long
text are not averaged away. Embeddings and softmax are trained together by
Adam on whole labelled texts; which window speaks for a text is learnt with
them. The score is calibrated by models of parts of the labelled texts on those they were not fitted to.

Learning rows: at most ``SAMPLE`` of each label, those with the least hash of
doc_id, of at most ``MAX_CHARS`` characters each. These two bounds are the size
of what the driver ever holds. Scoring reads every text whole.

Null, empty and wordless texts get the score of no evidence, below the
threshold. Equal texts get equal scores; ties in the learning order are broken by
doc_id. An empty table gives no rows. With no label of one of the kinds
every text scores 0. A label row with nulls is not learnt from; a document with
several labels counts as toxic if one says so. Further columns do not enter.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import crc_bucket, spread, table, text_or_empty

BUCKETS = 1 << 17
DIM = 12
WINDOW = 16
STRIDE = 8
SAMPLE = 2500
MAX_CHARS = 20_000
THRESHOLD = 0.3
EPOCHS = 70
#: Parts of the learning texts; each is scored by a model of the others to calibrate the score.
FOLDS = 5
MOST_FALSE = 0.02
#: Added to Adam's root: an n-gram that few texts share learns slowly.
EPSILON = 1e-4
#: Words that a task remembers; then it starts anew.
CACHE = 250_000
#: Letters beyond which a run is no word, those of each of the overlapping pieces that then count as words, and their mark.
LONG = 40
PIECE = 12
INSIDE = "\0"
#: Words that are looked up at once.
AT_ONCE = 50_000
_WORDS = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    found = _WORDS(text.lower())
    if max(map(len, found), default=0) <= LONG:
        return found
    return [piece for word in found for piece in pieces(word)]


def pieces(word: str) -> list[str]:
    """The words of a run of over LONG letters: it is parted at underscores, and a part that is still as long
    (a script without spaces) goes in overlapping pieces that hold each of its 3- and 4-grams. INSIDE begins a piece."""
    if len(word) <= LONG:
        return [word]
    if (parts := [p for p in word.split("_") if p]) != [word]:
        return [piece for p in parts for piece in pieces(p)] or ["_"]
    shown = f"<{word}>"
    return [INSIDE + shown[i : i + PIECE] for i in range(0, len(shown) - 3, PIECE - 3)]


def buckets_of(word: str) -> list[int]:
    """The word's own bucket and those of its 3- and 4-grams between boundary marks; of a piece only those of its n-grams."""
    inside = word[0] == INSIDE
    shown = word[1:] if inside else f"<{word}>"
    n = len(shown)
    if shown.isascii():
        data, crc = shown.encode(), zlib.crc32
        grams = [crc(data), *[crc(data[i : i + 3]) for i in range(n - 2)], *[crc(data[i : i + 4]) for i in range(n - 3)]]
    else:
        grams = [zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in (shown, *(shown[i : i + k] for k in (3, 4) for i in range(n - k + 1)))]
    return [g & (BUCKETS - 1) for g in grams[inside:]]


def window_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return starts, np.minimum(starts + WINDOW, n)


class Model:
    def __init__(self, embeddings: np.ndarray, softmax: np.ndarray, bias: float, scale: float, shift: float):
        self.side = (embeddings @ (softmax[1] - softmax[0])).astype(np.float64)
        self.bias, self.scale, self.shift = float(bias), scale, shift
        self.known: dict[str, float] = {}

    def probability(self, logit: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.scale * logit + self.shift, -35, 35))))

    def logit(self, text: str) -> float | None:
        words = words_of(text)
        if not words:
            return None
        known = self.known
        if len(known) > CACHE:
            known.clear()
        if fresh := [w for w in set(words) if w not in known]:
            for lo in range(0, len(fresh), AT_ONCE):
                some = fresh[lo : lo + AT_ONCE]
                rows = [buckets_of(w) for w in some]
                width = np.array([len(r) for r in rows])
                sums = np.add.reduceat(self.side[np.array([b for r in rows for b in r])], np.cumsum(width) - width)
                known.update(zip(some, (sums / width).tolist()))
        upto = np.concatenate([[0.0], np.cumsum([known[w] for w in words])])
        starts, ends = window_bounds(len(words))
        # a short text is averaged over a full window: one odd word alone proves little
        return float(((upto[ends] - upto[starts]) / np.maximum(ends - starts, WINDOW // 2)).max()) + self.bias

    def score(self, text: str) -> float:
        logit = self.logit(text)
        return min(self.probability(self.bias), THRESHOLD / 2) if logit is None else self.probability(logit)


class Nothing:
    """Stands for a model where there is nothing to learn from."""

    def score(self, text: str) -> float:
        return 0.0


def fit(texts: list[str], labels: list[int], prior: float | None = None, seed: int = 7):
    """A calibrated model. ``prior``: the share of label 1 among all labels.

    Each of ``FOLDS`` parts of the texts (by a hash) is scored by a model of the
    others, which calibrates the model that is fitted to all of them.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Nothing()
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts])
    read = Texts(texts)
    z, seen = np.zeros(len(y)), np.zeros(len(y), dtype=bool)
    for k in range(FOLDS):
        mine, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[mine])) < 2 or not len(rest):
            continue
        read.logits(_train(read, mine, y[mine], seed), rest, z, seen)
    model = _train(read, np.arange(len(texts)), y, seed)
    if len(set(y[seen])) < 2:  # too few texts to hold any back
        read.logits(model, np.arange(len(texts)), z, seen)
    if seen.any():
        model.scale, model.shift = calibration(z[seen], y[seen], prior)
    return model


class Texts:
    """Learning texts, read once: the numbers of their words, and of each word its buckets."""

    def __init__(self, texts: list[str]):
        types: dict[str, int] = {}
        self.tokens = [np.array([types.setdefault(w, len(types)) for w in words_of(t)], dtype=np.int32) for t in texts]
        flat, self.width = array("i"), np.zeros(len(types), dtype=np.int64)
        for k, word in enumerate(types):
            own = buckets_of(word)
            self.width[k] = len(own)
            flat.extend(own)
        self.bucket = np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, np.int32)
        self.at = np.cumsum(self.width) - self.width

    def logits(self, model: Model, rows: np.ndarray, z: np.ndarray, seen: np.ndarray) -> None:
        """Put into ``z`` what ``model.logit`` gives for those of the ``rows`` that have words."""
        word = np.add.reduceat(model.side[self.bucket], self.at) / self.width if len(self.at) else np.zeros(0)
        for i in rows:
            if n := len(self.tokens[i]):
                upto = np.concatenate([[0.0], np.cumsum(word[self.tokens[i]])])
                starts, ends = window_bounds(n)
                z[i], seen[i] = ((upto[ends] - upto[starts]) / np.maximum(ends - starts, WINDOW // 2)).max() + model.bias, True


def _train(read: Texts, rows: np.ndarray, y: np.ndarray, seed: int) -> Model:
    """Embeddings and softmax together, by Adam over the texts ``rows``."""
    fitted = [k for k, i in enumerate(rows) if len(read.tokens[i])]
    if not fitted:
        return Model(np.zeros((BUCKETS, DIM)), np.zeros((2, DIM)), 0.0, 1.0, 0.0)
    # words that these texts have, numbered anew, and their buckets: what no learning text has stays zero and says nothing
    types, stream = np.unique(np.concatenate([read.tokens[rows[k]] for k in fitted]), return_inverse=True)
    width = read.width[types]
    at = np.cumsum(width) - width
    used, bucket = np.unique(read.bucket[np.repeat(read.at[types] - at, width) + np.arange(width.sum())], return_inverse=True)
    starts, ends, owner, base = [], [], [], 0
    for k, i in enumerate(fitted):
        n = len(read.tokens[rows[i]])
        s, e = window_bounds(n)
        starts.append(s + base)
        ends.append(e + base)
        owner.append(np.full(len(s), k))
        base += n
    starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
    length = np.maximum(ends - starts, WINDOW // 2).astype(np.float64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    target = y[fitted]
    weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(used), DIM))
    soft = rng.normal(0, 0.3, (2, DIM))
    bias = 0.0
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("emb", emb), ("soft", soft), ("bias", np.zeros(1)))}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, step: int, rate: float) -> np.ndarray:
        m, v = state[name]
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += 0.01 * grad * grad
        return value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPSILON)

    for step in range(1, EPOCHS + 1):
        side = soft[1] - soft[0]
        word = np.add.reduceat((emb @ side)[bucket], at) / width
        upto = np.concatenate([[0.0], np.cumsum(word[stream])])
        logit = (upto[ends] - upto[starts]) / length + bias
        # attention over a text's windows, from all alike at first to the strongest alone
        sharp = 12.0 * step / EPOCHS
        top = np.maximum.reduceat(logit, first)[owner]
        share = np.exp(np.clip(sharp * (logit - top), -50, 0))
        share /= np.add.reduceat(share, first)[owner]
        bag = np.add.reduceat(share * logit, first)
        error = (1 / (1 + np.exp(-bag)) - target) * weight
        pull = share * error[owner] / length
        cover = np.bincount(starts, pull, len(stream) + 1) - np.bincount(ends, pull, len(stream) + 1)
        by_type = np.bincount(stream, weights=np.cumsum(cover)[:-1], minlength=len(types)) / width
        by_bucket = np.bincount(bucket, weights=np.repeat(by_type, width), minlength=len(used))
        grad_side = by_bucket @ emb + 1e-5 * side
        rate = 0.08 * (1 - 0.8 * step / EPOCHS)
        emb = adam("emb", emb, np.outer(by_bucket, side) + 1e-7 * emb, step, rate)
        soft = adam("soft", soft, np.stack([-grad_side, grad_side]), step, rate)
        bias = float(adam("bias", np.array([bias]), np.array([error.sum()]), step, rate)[0])
    whole = np.zeros((BUCKETS, DIM))
    whole[used] = emb
    return Model(whole, soft, bias, 1.0, 0.0)


def calibration(z: np.ndarray, y: np.ndarray, prior: float | None = None) -> tuple[float, float]:
    """(scale, shift): a logistic slope, and THRESHOLD put where F1 over the calibration rows is best, false alarms bounded."""
    a, b = 1.0, 0.0
    spread = max(float(z.std()), 1e-6)
    x = z / spread
    share = min(max(prior if prior is not None else float(y.mean()), 1e-4), 1 - 1e-4)
    weight = np.where(y == 1, share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum()))
    for _ in range(400):
        error = weight * (1 / (1 + np.exp(-np.clip(a * x + b, -35, 35))) - y)
        a -= 1.0 * float((error * x).sum())
        b -= 1.0 * float(error.sum())
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + share)
    best = int(np.argmax(f1))
    low = z[order[best]]
    high_below = z[order[best + 1]] if best + 1 < len(z) else low - spread
    cut = (low + high_below) / 2
    # of few rows the best F1 says little: at most MOST_FALSE of the clean ones may lie above the cut
    clean = np.sort(z[y == 0])
    if len(clean):
        cut = max(cut, float(clean[min(len(clean) - 1, int(np.ceil(len(clean) * (1 - MOST_FALSE))))]))
    scale = max(a, 0.5) / spread
    return scale, float(np.log(THRESHOLD / (1 - THRESHOLD)) - scale * cut)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column):
    """A model from at most SAMPLE labelled documents of each kind where ``may_learn`` (of doc_id) holds."""
    known = (
        labels.where("doc_id is not null and toxic is not null").where(may_learn)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    )
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(SAMPLE) for k in (0, 1)]
    picked = docs.select("doc_id", text_or_empty().alias("text")).where(F.length("text") <= MAX_CHARS)
    sample = picked.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(2 * SAMPLE)
    prior = known.agg(F.avg("toxic")).first()[0]
    rows = sample.select("text", "toxic").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], prior)


def _score_rows(model_on, n_kept: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_on.value
        for rows in batches:
            scores = [model.score(t) for t in rows.column(n_kept).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(n_kept)), pa.array(scores, pa.float64())], schema=schema)

    return run


def score(docs: DataFrame, model, column: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` (without text unless ``keep_text``) with a column of scores."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType

    names = [c for c in docs.columns if c.lower() != column.lower() and (keep_text or c.lower() != "text")]
    # under names of their own, columns that are called like the operator's stay what they were
    kept = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], text_or_empty().alias("__text"))
    schema = type(kept.schema)(list(kept.schema)[:-1]).add("__score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = kept.mapInArrow(_score_rows(shared, len(names), to_arrow_schema(schema)), schema)
    return scored.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], F.col("__score").alias(column))


def learning_rows(doc_id: Column) -> Column:
    return crc_bucket(doc_id, 4) != 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), learning_rows(F.col("doc_id")))
    return score(spread(docs), model, keep_text=False).select(
        "doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
