"""Where a pattern matches in a text column, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` (which matches no empty
    text) as (start, end, text) in code points, end exclusive.

    The pieces between the matches come from ``split`` by the same pattern, so
    a running sum of lengths gives every position.
    """
    def place(found: Column) -> Column:
        before = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
        steps = F.zip_with(before, found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

        def step(acc: Column, x: Column) -> Column:
            start = acc["pos"] + x["gap"]
            end = start + F.length(x["hit"])
            one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))
            return F.struct(end.alias("pos"), F.concat(acc["out"], one.cast(SPANS)).alias("out"))

        zero = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))
        return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(
            F.aggregate(steps, zero, step, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
