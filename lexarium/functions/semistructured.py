"""JSON texts from outside: read strictly or put aside with a reason, and maps of them put together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DEPTH, MOST_NODES = 32, 2000


def strict_json(text: Column, depth: int = MOST_DEPTH, nodes: int = MOST_NODES) -> Column:
    """struct(value variant, reason): the value, or why there is none.

    MISSING: null. INVALID: no JSON, or a key twice in one object (which value counts would be a guess). TOO_DEEP and
    TOO_LARGE: a tree of over ``depth`` levels below its root or over ``nodes`` values. Depth and size are read off the
    brackets and commas outside of strings, so no tree is walked.
    """
    value = F.try_parse_json(text)
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "s"), r"\s", "")
    full = F.regexp_replace(bare, r"\[\]|\{\}", "0")
    marks = F.regexp_replace(full, r"[^\[\]{},]", "")
    opened, commas = F.length(F.regexp_replace(marks, r"[^\[{]", "")), F.length(F.regexp_replace(marks, "[^,]", ""))
    levels = F.filter(F.split(F.regexp_replace(marks, ",", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    deepest = F.aggregate(levels, start, step)["most"]
    reason = (
        F.when(text.isNull(), "MISSING").when(value.isNull(), "INVALID").when(deepest > depth, "TOO_DEEP")
        .when(F.lit(1) + commas + opened > nodes, "TOO_LARGE")  # each filled container has one value more than commas
    )
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def fields(value: Column) -> Column:
    """The fields of a variant object as a map; null for anything else."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value.cast("map<string,variant>"))


def merged(first: Column, last: Column) -> Column:
    """Both maps in one; where both have a key, the last counts. A null map is an empty one."""
    none = F.create_map().cast("map<string,variant>")
    a, b = F.coalesce(first, none), F.coalesce(last, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def sha256_or_null(value: Column) -> Column:
    """A variant string that is a SHA-256 in hexadecimal digits, in lower case."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.lower(F.try_variant_get(value, "$", "string")))
    return F.when(text.rlike("^[0-9a-f]{64}$"), text)


def count_or_null(value: Column) -> Column:
    """A variant integer of 0 or more; no truth value, fraction or text."""
    number = F.when(F.schema_of_variant(value).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), F.try_variant_get(value, "$", "long"))
    return F.when(number >= 0, number)
