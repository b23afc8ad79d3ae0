"""Regular-expression spans as native array expressions: (start, kind, end), code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLD = 256
SPAN = "array<struct<s:int,k:int,e:int>>"


def with_hits(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds for each name: ``name`` (the matches' texts) and ``name_gaps`` (the texts between them)."""
    df = df.withColumns({n: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()})
    return df.withColumns({f"{n}_gaps": F.when(F.size(n) > 0, F.split(text, p, -1)) for n, p in patterns.items()})


def placed(name: str, make: Callable[[Column, Column, Column, Column], Column], kind: str) -> Column:
    """An array with ``make(match, its number, start, end)`` (of type ``kind``) for each match of ``name``, in order."""
    # the starts are running sums, folded ``FOLD`` at a time: an append copies its array, so a long one would cost its square
    none = F.expr("cast(array() as array<int>)")
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(f"{name}_gaps", i))
        return F.struct((start + F.length(F.get(name, i))).alias("at"), F.array_append(acc["out"], start).alias("out"))

    def steps(acc: Column, lo: Column) -> Column:
        some = F.aggregate(F.sequence(lo, F.least(lo + FOLD, F.size(name)) - 1), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.get(F.transform(F.array(some), lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out"))), F.lit(0))

    places = F.when(F.size(name) > 0, F.sequence(F.lit(0), F.size(name) - 1, F.lit(FOLD))).otherwise(none)
    starts = F.flatten(F.aggregate(places, zero, steps, lambda acc: acc["out"]))
    return F.transform(starts, lambda s, i: make(F.get(name, i), i, s, s + F.length(F.get(name, i)))).cast(f"array<{kind}>")


def span(start: Column, kind: int | Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), (F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("k"), end.cast("int").alias("e"))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def replaced(text: str, spans: Column, kinds: tuple[str, ...]) -> Column:
    """The text with every span (sorted by start) replaced by ``<KIND>``; of overlapping spans the first counts, and the rest
    of a later one goes with it."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in kinds))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = x["s"] >= acc["at"]
        piece = F.array(F.substring(F.col(text), acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(new, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(F.col(text))
