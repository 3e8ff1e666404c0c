"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as its words: runs of letters (and their marks) in lower case, each
between a begin and an end mark. A language's model holds, for each order up to
``ORDER``, the hashes of its n-grams in a sorted array, and beside it log
probabilities and backoff weights. The text's language is the one of lowest
cross-entropy per character over all words of the whole text; of equal ones,
the first by name.

Learning: at most ``SAMPLE`` different texts of each language, those of least hash,
from each a passage of at most ``PASSAGE`` characters at a place that the hash
gives. Every fifth text calibrates, the others are fitted, each language in a
task of its own. A model has at most ``SAMPLE * (PASSAGE + 2) * ORDER`` entries of 16
bytes, whatever the size of the corpus; models are broadcast.

Calibration, on pieces of 1 to 256 words and whole passages: ``score`` is the
probability that the prediction is right, a logistic function of the lead over
the second language; ``known`` is the probability that the text is of any learned
language, learned by leaving each text's own language out once. Below ``REJECT``
the prediction is marked as rejected.

Null texts and texts without a letter are ``und`` with score 0 and without
cross-entropy, and so is every text if no language was learned. A null id counts
as the empty id where rows are parted by it. Repeated texts are learned once
and predicted alike. An empty table gives no rows. Very long texts are read
whole, in pieces. Columns of the input that are called like a new one are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.llm._shared import crc_bucket, durable, spread, strings, table

ORDER = 5
SAMPLE = 1000
PASSAGE = 2000
CALIBRATE_EVERY = 5
#: So many times the sample's texts are ranked: fewer than the sample are among them with a probability below 1e-100.
MARGIN = 4
#: Rows of (language, hash) of the sample up to which they are broadcast.
BROADCAST_ROWS = 200_000
REJECT = 0.5
UNDETERMINED = "und"
#: Characters that a model gives a share to besides those it has seen.
ALPHABET = 100_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BREAK = regex.compile(r"[^\p{L}\p{M}]")
#: Characters that are split into words, or scored, at once.
PIECE = 1 << 20
SCORED = 400_000
#: Words whose scores a task remembers, and their usual greatest length.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 40
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> Counter:
    """Words of a text with their counts; long texts are cut between words."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            gap = BREAK.search(text, at + PIECE)
            end = gap.start() if gap else len(text)
        found.update(WORD.findall(text[at:end].lower()))
        at = end
    return found


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start of each word, place of each character in its word, and hashes of the n-grams that end there, by order."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    one = codes + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # spread the bits of each character
        one = (one ^ (one >> np.uint64(shift))) * np.uint64(factor)
    hashes = [one]
    for _ in range(ORDER - 1):
        longer = one.copy()
        longer[1:] += hashes[-1][:-1] * _BASE
        hashes.append(longer)
    return starts, place, hashes


@dataclass
class Order:
    """N-grams of one length: sorted hashes, log probabilities, log weights of what backs off from them."""

    hashes: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 for those that aren't there."""
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == wanted, at, -1)


def fit(counts: Counter) -> tuple[list[Order], float]:
    """Interpolated Kneser-Ney estimates, and the log probability of an unseen character."""
    words = sorted(counts)
    _, place, hashes = grams(words)
    weight = np.repeat([counts[w] for w in words], [len(w) + 2 for w in words]).astype(np.float64)
    distinct, example, number = [], [], []
    top = min(ORDER, int(place.max()) + 1)  # short words alone have no longer n-grams
    for k in range(1, top + 1):
        at = np.flatnonzero(place >= k - 1)
        h, first, inverse = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
        distinct.append(h)
        example.append(at[first])
        number.append(np.bincount(inverse, weight[at]))
    for k in range(1, top):  # below the highest order: the number of different characters before it, unless a word begins so
        before = np.bincount(np.searchsorted(distinct[k - 1], hashes[k - 1][example[k]]), minlength=len(distinct[k - 1]))
        number[k - 1] = np.where(place[example[k - 1]] == k - 1, number[k - 1], before)
    number[0][place[example[0]] == 0] = 0  # the begin mark is never predicted
    orders, below, unseen = [], np.empty(0), 0.0
    for k in range(1, top + 1):
        a = number[k - 1]
        n1, n2 = float((a == 1).sum()), float((a == 2).sum())
        discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
        there = (a > 0).astype(np.float64)
        if k == 1:
            lower, context = np.full(len(a), 1 / ALPHABET), np.zeros(len(a), np.int64)
            sums, kinds = np.array([a.sum()]), np.array([there.sum()])
            unseen = float(discount * kinds[0] / sums[0] / ALPHABET)
        else:
            lower = below[np.searchsorted(distinct[k - 2], hashes[k - 2][example[k - 1]])]
            context = np.searchsorted(distinct[k - 2], hashes[k - 2][example[k - 1] - 1])
            sums, kinds = (np.bincount(context, x, minlength=len(distinct[k - 2])) for x in (a, there))
            share = np.divide(discount * kinds, sums, out=np.ones(len(sums)), where=sums > 0)
            orders[-1].backoff = np.log(share).astype(np.float32)
        below = (np.maximum(a - discount, 0) + discount * kinds[context] * lower) / sums[context]
        orders.append(Order(distinct[k - 1], np.log(np.maximum(below, 1e-30)).astype(np.float32), np.zeros(len(a), np.float32)))
    return orders, float(np.log(unseen))


def word_scores(words: list[str], models: list[tuple[list[Order], float]]) -> np.ndarray:
    """Log probability of each word under each model."""
    starts, place, hashes = grams(words)
    out = np.empty((len(words), len(models)))
    for m, (orders, unseen) in enumerate(models):
        at = orders[0].find(hashes[0])
        logp = np.where(at >= 0, orders[0].logp[at], unseen)
        for k in range(2, len(orders) + 1):
            context = np.r_[-1, at[:-1]]
            back = np.where(context >= 0, orders[k - 2].backoff[context], 0.0)
            longer = np.full(len(at), -1)
            possible = np.flatnonzero((at >= 0) & (place >= k - 1))  # an n-gram is there only if its end is
            longer[possible] = orders[k - 1].find(hashes[k - 1][possible])
            logp = np.where(longer >= 0, orders[k - 1].logp[longer], np.where(place >= k - 1, logp + back, logp))
            at = longer
        logp[starts] = 0.0
        out[:, m] = np.add.reduceat(logp, starts)
    return out


@dataclass
class Identifier:
    """Languages, their models, and what calibration has found."""

    languages: list[str]
    models: list[tuple[list[Order], float]]
    lead: tuple[float, float] = (0.0, 1.0)
    known: tuple[float, float] = (9.0, 0.0)
    usual: list[tuple[float, float]] = field(default_factory=list)  # mean and deviation of the cross-entropy of a language's own texts
    known_words: dict[str, int] = field(default_factory=dict)  # rows of ``scores`` of words that this process has met
    scores: np.ndarray | None = None

    def entropies(self, texts: list[Counter]) -> list[tuple[np.ndarray, int] | None]:
        """(cross-entropy under each model, characters) of each text; None without words."""
        if self.scores is None or len(self.known_words) > REMEMBERED or sum(map(len, self.known_words)) > REMEMBERED_LENGTH * REMEMBERED:
            self.known_words, self.scores = {}, np.empty((0, len(self.models)))
        fresh = list(set().union(*texts).difference(self.known_words))
        made, first, size = [self.scores], 0, 0
        for i, w in enumerate(fresh):
            size += len(w) + 2
            if size >= SCORED or i + 1 == len(fresh):
                made.append(word_scores(fresh[first:i + 1], self.models))
                first, size = i + 1, 0
        self.known_words.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
        self.scores = np.concatenate(made)
        out: list[tuple[np.ndarray, int] | None] = []
        for t in texts:
            rows = np.fromiter(map(self.known_words.__getitem__, t), np.int64, len(t))
            n = sum(map(int.__mul__, map(len, t), t.values())) + t.total()
            out.append((-(np.fromiter(t.values(), np.float64, len(t)) @ self.scores[rows]) / n, n) if n else None)
        return out

    def decide(self, h: np.ndarray, n: int) -> tuple[int, float, float]:
        """(place of the language, probability that it's right, probability that the language is a learned one)."""
        best = int(np.argmin(h))
        second = np.min(np.delete(h, best)) if len(h) > 1 else h[best] + 1.0
        return best, logistic(self.lead, lead(second - h[best], n)), logistic(self.known, self.excess(best, h[best], n))

    def excess(self, language: int, h: float, n: int) -> float:
        mean, deviation = self.usual[language] if self.usual else (h, 1.0)
        return (h - mean) / deviation * min(1.0, (n / 200) ** 0.5)


def lead(difference: float, n: int) -> float:
    return float(np.log1p(difference * n))


def logistic(line: tuple[float, float], x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(line[0] + line[1] * x, -50, 50))))


def fit_line(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Logistic regression on one number; the ridge keeps separable data finite."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learning_sample(docs: DataFrame, allowed: Column, sample: int = SAMPLE, passage: int = PASSAGE) -> DataFrame:
    """(lang, place, passage) of at most ``sample`` different texts with letters of each language."""
    rows = spread(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    kinds = durable(rows.select("lang", "h").distinct())
    u = F.pmod("h", F.lit(1 << 31))
    # u is uniform: of a language of many texts about MARGIN times the sample enter the ranking, however many there are
    sizes = _small(durable(kinds.groupBy("lang").agg(F.count("*").alias("all"))))
    near = kinds.join(sizes, "lang").where(u * F.col("all") < F.lit(MARGIN * sample * float(1 << 31))).select("lang", "h")
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(u, "h"))).where(F.col("place") <= sample)
    first = _small(durable(first))  # so that texts that aren't in the sample stay where they are
    start = F.greatest(F.lit(0), F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - passage))) + 1
    # copies are combined within each task before the shuffle
    return rows.join(first, ["lang", "h"]).groupBy("lang", "place").agg(F.any_value(F.substring("text", start.cast("int"), F.lit(passage))).alias("passage"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of few rows; more are left to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


MODEL = "lang string, unseen double, hashes array<binary>, logp array<binary>, backoff array<binary>"


def _fit_language(rows: pa.Table) -> pa.Table:
    counts = sum(map(words_of, rows.column("passage").to_pylist()), Counter())
    if not counts:
        return pa.table({"lang": pa.array([], pa.string()), "unseen": pa.array([], pa.float64()), **{c: pa.array([], pa.list_(pa.binary())) for c in ("hashes", "logp", "backoff")}})
    orders, unseen = fit(counts)
    return pa.table({
        "lang": rows.column("lang").slice(0, 1).cast(pa.string()), "unseen": [unseen],
        **{c: pa.array([[getattr(o, c).tobytes() for o in orders]], pa.list_(pa.binary())) for c in ("hashes", "logp", "backoff")},
    })


def pieces(text: str) -> list[Counter]:
    """Runs of 1 to 256 words at the beginning, and the whole text."""
    words = WORD.findall(text.lower())
    return [Counter(words[:n]) for n in (1, 2, 4, 8, 16, 32, 64, 128, 256) if n < len(words)] + ([Counter(words)] if words else [])


def train(docs: DataFrame, allowed: Column, sample: int = SAMPLE, passage: int = PASSAGE) -> Identifier:
    """An identifier from the rows of ``docs`` (text, lang) where ``allowed`` holds."""
    rows = durable(learning_sample(docs, allowed, sample, passage))
    fitted = F.col("place") % CALIBRATE_EVERY != 0
    found = rows.where(fitted).groupBy("lang").applyInArrow(_fit_language, MODEL).toArrow()  # bounded, see above
    models = []
    for r in sorted(found.to_pylist(), key=lambda r: r["lang"]):
        parts = zip(*([np.frombuffer(x, dtype) for x in r[c]] for c, dtype in (("hashes", np.uint64), ("logp", np.float32), ("backoff", np.float32))))
        models.append(([Order(*p) for p in parts], r["unseen"]))
    model = Identifier(sorted(found.column("lang").to_pylist()), models)
    if len(models) < 2:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, text in zip(strings(b.column(0)), strings(b.column(1))):
                if lang in shared.value.languages:
                    out += [(shared.value.languages.index(lang), h.tolist(), n) for h, n in filter(None, shared.value.entropies(pieces(text)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.list_(pa.float64()), pa.int64()))], names=["own", "h", "n"])

    seen = rows.where(~fitted).select("lang", "passage").mapInArrow(run, "own int, h array<double>, n long").toArrow().to_pylist()
    shared.unpersist()
    seen.sort(key=lambda r: (r["own"], r["n"], r["h"]))
    for i in range(len(models)):
        own = [r["h"][i] for r in seen if r["own"] == i and r["n"] >= 200] or [r["h"][i] for r in seen if r["own"] == i] or [2.0, 3.0]
        model.usual.append((float(np.mean(own)), float(np.std(own)) + 0.05))
    if seen:
        calibrate(model, [(r["own"], np.array(r["h"]), r["n"]) for r in seen])
    return model


def calibrate(model: Identifier, seen: list[tuple[int, np.ndarray, int]]) -> None:
    """Both logistic lines from labelled pieces."""
    leads, right, excess, known = [], [], [], []
    for own, h, n in seen:
        best = int(np.argmin(h))
        leads.append(lead(np.min(np.delete(h, best)) - h[best], n))
        right.append(best == own)
        other = int(np.argmin(np.where(np.arange(len(h)) == own, np.inf, h)))  # as if its language weren't there
        excess += [model.excess(own, h[own], n), model.excess(other, h[other], n)]
        known += [True, False]
    model.lead = fit_line(np.array(leads), np.array(right, float))
    model.known = fit_line(np.array(excess), np.array(known, float))


NEW = "lang_pred string, score double, cross_entropy double, known double, rejected boolean"


def identify(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with lang_pred, score, cross_entropy (nats a character), known and rejected."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = _parse_datatype_string(NEW)
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), *made.names}]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = type(made)(list(rows.schema)[:-1] + list(made))
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at = 0
            texts = b.column(len(kept))
            while at < b.num_rows:  # some texts at a time: their words are held together
                end, size, found = at, 0, []
                while end < b.num_rows and (end == at or size < PIECE):
                    t = texts[end].as_py() or ""
                    found.append(words_of(t))
                    size, end = size + len(t), end + 1
                out = []
                for e in m.entropies(found) if m.models else [None] * len(found):
                    if e is None:
                        out.append((UNDETERMINED, 0.0, None, 0.0, True))
                        continue
                    best, score, known = m.decide(*e)
                    out.append((m.languages[best], score, float(e[0][best]), known, known < REJECT))
                own = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([own.column(i) for i in range(len(kept))] + [pa.array(c, f.type) for c, f in zip(zip(*out), list(arrow)[len(kept):])], schema=arrow)
                at = end

    return rows.mapInArrow(run, schema).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], *made.names)


def held_out(doc_id: Column) -> Column:
    return crc_bucket(F.coalesce(doc_id.cast("string"), F.lit("")), 4) == 2


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id")))
    return identify(spread(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")), model)
