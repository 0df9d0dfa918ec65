"""Folds over long arrays, and values bound once. An array grows by copying, so a fold that collects as it goes costs the square of
the array's length; these collect a block at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Text, col

BLOCK = 32


def bound(value: Text, *bodies: Callable[[Column], Column]) -> Column:
    """The last of ``bodies``, each of which gets the result of the one before it, the first ``value``; every
    result is computed once, however often the next body uses it, also inside its lambdas. Several bodies in
    a row rather than one inside another: an item's type is derived again at each access, with all that is nested in it."""
    out = F.array(col(value))
    for body in bodies:
        out = F.transform(out, body)
    return F.get(out, 0)


def _blocks(values: Column) -> Column:
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(values, s, BLOCK))


def scan(values: Text, state: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each element ``out(state, element)``, where the state goes on by ``step(state, element)``;
    ``kind`` is the type of the results. The values are bound, as every block would compute them all again."""
    none = lambda of: F.array().cast(f"array<{of}>")

    def one(a: Column, x: Column) -> Column:
        return F.struct(F.concat(a["out"], F.array(out(a["at"], x))).alias("out"), step(a["at"], x).alias("at"))

    def block(a: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.struct(none(kind).alias("out"), a["at"].alias("at")), one, lambda d: F.struct(F.concat(a["out"], F.array(d["out"])).alias("out"), d["at"].alias("at")))

    whole = lambda vs: F.aggregate(_blocks(vs), F.struct(none(f"array<{kind}>").alias("out"), state.alias("at")), block, lambda a: a["out"])
    return F.flatten(F.flatten(F.transform(F.array(col(values)), whole)))


def running(lengths: Text) -> Column:
    """The sum of the integers before each."""
    return scan(lengths, F.lit(0), lambda at, x: at + x, lambda at, x: at, "int")
