"""Selectors whose next step depends on what was taken before.

Those for the hits of one query (``with_images``, ``within_budget``) are folds
of column functions over an array. The others run over cases that Spark deals
and sorts; they read a case's rows one by one and hold a bounded state.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_images(hits: Column, images: Column, k: int) -> Column:
    """Arrays of (id, source) in order: the first ``k`` hits, into which each new image is put.

    It takes the place of the last entry of its own source, else of the last entry whose source
    stands there more than once, else a free place, else none.
    """
    def put(places: Column, image: Column) -> Column:
        sources = F.transform(places, lambda h: h["source"])
        mine = F.array_max(F.transform(places, lambda h, i: F.when(h["source"] == image["source"], i)))
        spare = F.array_max(F.transform(places, lambda h, i: F.when(F.size(F.filter(sources, lambda x: x == h["source"])) > 1, i)))
        at = F.coalesce(mine, spare, F.when(F.size(places) < k, F.size(places)))
        taken = F.exists(places, lambda h: h["id"] == image["id"]) | at.isNull()
        return F.when(taken, places).otherwise(F.concat(F.slice(places, 1, at), F.array(image), F.slice(places, at + 2, F.size(places))))

    return F.aggregate(images, F.slice(hits, 1, k), put)


def around_hits(rows: DataFrame, section: str, place: str, cost: str, hit: Column, around: int = 1) -> DataFrame:
    """(section, wanted): for each hit of a section, in order, itself, the section's first row and its neighbours, the nearer first.

    ``wanted`` is an array of (place, cost, role).
    """
    line = Window.partitionBy(section).orderBy(place)
    own = F.struct(F.col(place).alias("place"), F.col(cost).alias("cost"))
    near = [f(own, step).over(line) for step in range(1, around + 1) for f in (F.lag, F.lead)]
    roles = [(own, "hit"), (F.first(own).over(line), "anchor"), *((n, "neighbour") for n in near)]
    wanted = F.array(*[F.when(c.isNotNull(), F.struct(c["place"].alias("place"), c["cost"].alias("cost"), F.lit(role).alias("role"))) for c, role in roles])
    met = rows.select(section, place, hit.alias("hit"), F.filter(wanted, lambda x: x.isNotNull()).alias("wanted")).where("hit")
    ordered = F.array_sort(F.collect_list(F.struct(place, "wanted")))
    return met.groupBy(section).agg(F.flatten(F.transform(ordered, lambda x: x["wanted"])).alias("wanted"))


def within_budget(wanted: Column, budget: int) -> Column:
    """Array of (place, role): what of ``wanted`` (place, cost, role) fits, each place once.

    The first is always taken; a hit that doesn't fit ends the selection, anything else that doesn't is passed over.
    """
    nothing = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("ended"), F.array().cast("array<struct<place:bigint,role:string>>").alias("taken"))

    def step(state: Column, x: Column) -> Column:
        taken, used = state["taken"], state["used"]
        fresh = ~F.exists(taken, lambda t: t["place"] == x["place"])
        fits = (F.size(taken) == 0) | (used + x["cost"] <= budget)
        take = ~state["ended"] & fresh & fits
        return F.struct(
            F.when(take, used + x["cost"]).otherwise(used).cast("long").alias("used"),
            (state["ended"] | (fresh & ~fits & (x["role"] == "hit"))).alias("ended"),
            F.when(take, F.concat(taken, F.array(F.struct(x["place"].cast("long").alias("place"), x["role"].alias("role"))))).otherwise(taken).alias("taken"),
        )

    return F.aggregate(wanted, nothing, step)["taken"]


def round_robin(searches: list[list[tuple]], k: int) -> list[tuple]:
    """``searches``: each check's (id, source) by rank. By rank over all checks, new sources first, then the rest."""
    return _first_new([hit for rank in range(max(map(len, searches), default=0)) for own in searches if rank < len(own) for hit in [own[rank]]], k)


def round_robin_of(hits: Iterable[tuple], k: int) -> list[tuple]:
    """As ``round_robin``, of (check, id, source) check by check in order of rank, each id once in a check.

    Held are each check's first k hits and its first of each source: no other
    can be taken, as k hits of its check or one of its source stand before it.
    """
    line = []
    for c, (_, own) in enumerate(groupby(hits, key=lambda hit: hit[0])):
        sources: set = set()
        for rank, (_, key, source) in enumerate(own):
            if rank < k or source not in sources:
                line.append((rank, c, key, source))
            sources.add(source)
    return _first_new([(key, source) for _, _, key, source in sorted(line, key=lambda hit: hit[:2])], k)


def _first_new(line: list[tuple], k: int) -> list[tuple]:
    out, ids, sources = [], set(), set()
    for fresh in (True, False):
        for hit in line:
            if len(out) < k and hit[0] not in ids and not (fresh and hit[1] in sources):
                out.append(hit)
                ids.add(hit[0])
                sources.add(hit[1])
    return out


def greedy_cap(files: Iterable[tuple[str, int]], most: int, total: int) -> list[str]:
    """Names in order up to ``most`` files and ``total`` bytes; one that is too large is passed over, later ones may fit."""
    out, used = [], 0
    for name, size in files:
        if len(out) == most:
            break
        if used + size <= total:
            out.append(name)
            used += size
    return out


def reserve(requests: list[dict[str, float]], limits: dict[str, float | None]) -> list[str | None]:
    """A budget of several dimensions: of each request the first dimension (by name) that denies it, or None.

    A limit of None is no limit, of 0 denies; a denied request uses nothing.
    """
    return list(reserving(requests, limits))


def reserving(requests: Iterable[dict[str, float]], limits: dict[str, float | None]) -> Iterator[str | None]:
    used: Counter = Counter()
    for request in requests:
        denied = next((d for d in sorted(request) if limits.get(d) is not None and used[d] + request[d] > limits[d]), None)
        yield denied
        if denied is None:
            used.update(request)


def stalls(signals: list[tuple[str, float]], window: int) -> list[int]:
    """Positions at which a run has made no progress for ``window`` signals: (state, value); told once until progress."""
    return [i for i, stalled in enumerate(stalling((value for _, value in signals), window)) if stalled]


def stalling(values: Iterable[float], window: int) -> Iterator[bool]:
    """Of each value whether ``stalls`` tells of it."""
    best, since, told = float("-inf"), 0, False
    for value in values:
        if value > best:
            best, since, told = value, 0, False
        else:
            since += 1
        stalled = since >= window and not told
        told = told or stalled
        yield stalled


def per_case(rows: DataFrame, case: str, order: list[str], work, schema: str) -> DataFrame:
    """Apply ``work`` (iterator of the rows of one case, in ``order`` -> iterable of rows) to each case.

    Cases are dealt by key and stand one after the other in a task, which hands
    their rows to ``work`` one by one; many small cases cost one frame, not one
    each. A case is one task's, however long; what is held of it is up to ``work``.
    """
    columns = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple] = []
        lines = (row for pdf in frames for row in pdf.itertuples(index=False))
        for _, own in groupby(lines, key=lambda row: getattr(row, case)):
            for row in work(own):
                made.append(row)
                if len(made) >= 10_000:
                    yield pd.DataFrame(made, columns=columns)
                    made = []
        yield pd.DataFrame(made, columns=columns)

    return rows.repartition(case).sortWithinPartitions(case, *order).mapInPandas(run, schema)


def three_passes(requests: DataFrame, traces: str, most: int = 8) -> DataFrame:
    """``requests`` with ``selected``: ids chosen in three passes over ``traces``, an array of (language, rows: array of (id, document, overlap)) of bounded length.

    First each trace gives its best row by overlap (the first of equal ones) whose document its
    language has not given yet; then rows with any overlap of documents that their language has
    not given; then any row. Column folds only.
    """
    document = lambda t, r: F.concat_ws("\x00", F.coalesce(t["language"], F.lit("all")), F.coalesce(r["document"].cast("string"), r["id"].cast("string")))
    kind = requests.schema[traces].dataType.elementType["rows"].dataType.elementType["id"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("ids"), F.array().cast("array<string>").alias("documents"))

    def put(state: Column, ids: Column, documents: Column) -> Column:
        return F.struct(F.array_union(state["ids"], ids).alias("ids"), F.array_union(state["documents"], documents).alias("documents"))

    def best(state: Column, t: Column) -> Column:
        numbered = F.transform(t["rows"], lambda r, i: F.struct(r["overlap"].alias("overlap"), (-i).alias("before"), r["id"].alias("id"), document(t, r).alias("document")))
        top = F.array_max(F.filter(numbered, lambda r: ~F.array_contains(state["documents"], r["document"])))
        return F.when(top.isNull() | (F.size(state["ids"]) >= most), state).otherwise(put(state, F.array(top["id"]), F.array(top["document"])))

    rows = F.flatten(F.transform(traces, lambda t: F.transform(t["rows"], lambda r: F.struct(r["id"].alias("id"), document(t, r).alias("document"), r["overlap"].alias("overlap")))))

    def unseen(state: Column, r: Column) -> Column:
        fits = (F.size(state["ids"]) < most) & ~F.array_contains(state["ids"], r["id"]) & ~F.array_contains(state["documents"], r["document"]) & (r["overlap"] > 0)
        return F.when(fits, put(state, F.array(r["id"]), F.array(r["document"]))).otherwise(state)

    first = F.aggregate(traces, start, best)
    second = requests.withColumn("__first", first).withColumn("__second", F.aggregate(rows, F.col("__first"), unseen))
    filled = F.slice(F.array_union(F.col("__second")["ids"], F.transform(rows, lambda r: r["id"])), 1, most)
    return second.withColumn("selected", filled).drop("__first", "__second")
