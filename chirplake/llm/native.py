"""Column expressions that several native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are placed together: appending to an array copies it, so a long list is placed in parts.
PART = 64
PLACED = "array<struct<start:bigint,end:bigint,match:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda would compute an expression anew at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def placed(text: Column, pattern: Column | str, width: Callable[[Column], Column] = F.length) -> Column:
    """(start, end, match) of all matches of a pattern that never matches the empty string.

    Matches and the gaps between them alternate, so the running sum of their
    widths is every place: in code points, or in what ``width`` counts.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    long = lambda c: c.cast("long")

    def walk(pairs: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PART).cast("int"))
        part = lambda c: F.slice(pairs, c * PART + 1, F.lit(PART))
        widths = F.transform(parts, lambda c: F.aggregate(part(c), long(F.lit(0)), lambda a, x: a + x["gap"] + x["width"]))
        zero = F.struct(long(F.lit(0)).alias("at"), F.array().cast("array<bigint>").alias("out"))
        begins = F.aggregate(widths, zero, lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def step(state: Column, pair: Column) -> Column:
            begin = state["at"] + pair["gap"]
            end = begin + pair["width"]
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match")))).alias("out"))

        def place(at: Column, c: Column) -> Column:
            start = F.struct(at.alias("at"), F.array().cast(PLACED).alias("out"))
            return F.aggregate(part(c), start, step, lambda s: s["out"])

        return F.when(F.size(pairs) > 0, F.flatten(F.transform(begins, place))).otherwise(F.array().cast(PLACED))

    measured = lambda m, g: F.struct(m.alias("match"), long(width(m)).alias("width"), long(width(g)).alias("gap"))
    return let(both, lambda b: let(F.zip_with(b["m"], F.slice(b["g"], 1, F.size(b["m"])), measured), walk))
