"""Spans of regular expressions in whole texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,kind:string,found:string,before:string,after:string>>"
CONTEXT = 24  # characters kept on either side


def empty() -> Column:
    return F.array().cast(SPAN)


def find(df: DataFrame, text: str, kind: str, pattern: str, guard: Column | None = None) -> DataFrame:
    """Adds a column named as the kind: the places of all matches of a pattern in df[text], leftmost and not overlapping, in code points, end exclusive.

    The texts between matches, which split() gives under the same pattern as regexp_extract_all(), add up to the places.
    guard is a cheap condition that holds for every text with a match; a text without matches is not split. The matches
    are a column of their own first, so that they are not searched for again wherever they are used.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if guard is not None:
        found = F.when(guard, found).otherwise(F.array().cast("array<string>"))
    m = F.col("_found")
    gaps = F.when(F.size(m) > 0, F.split(text, pattern, -1))
    g = F.col("_gaps")
    both = F.arrays_zip(m.alias("m"), F.slice(g, 1, F.size(m)).alias("g"), F.slice(g, 2, F.greatest(F.size(m), F.lit(1))).alias("h"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["g"])
        stop = start + F.char_length(x["m"])
        one = F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), x["m"].alias("found"), F.right(x["g"], F.lit(CONTEXT)).alias("before"), F.left(x["h"], F.lit(CONTEXT)).alias("after"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).cast(SPAN).alias("out"))

    walk = F.aggregate(both, F.struct(F.lit(0).alias("at"), empty().alias("out")), add, lambda acc: acc["out"])
    found_in = df.withColumn("_found", found)
    return found_in.withColumn("_gaps", gaps).withColumn(kind, F.when(F.size(m) > 0, walk).otherwise(empty())).drop("_found", "_gaps")


def digest(items: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then by the order of kinds, comma-joined."""
    rank = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(items, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def apart(items: Column, others: Column) -> Column:
    """Those spans of items that overlap none of others."""
    return F.filter(items, lambda s: ~F.exists(others, lambda o: (s["start"] < o["stop"]) & (o["start"] < s["stop"])))


def count(items: Column, kind: str) -> Column:
    return F.size(F.filter(items, lambda s: s["kind"] == kind)).cast("long")
