"""Sentences and bounded chunks, lossless and with their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound
from .text import Text, col, is_blank, word_count

_NONE = "array<string>"


def _cut(c: Column, after: str) -> Column:
    """Cut after ``after`` before white space or the end; only a blank rest is dropped."""
    return F.filter(F.split(c, rf"(?U)(?<={after})(?=\s|$)"), lambda p: ~is_blank(p))


def word_chunks(c: Text, size: int) -> Column:
    """Pieces of ``size`` words; white space stays with the word before it."""
    c = col(c)
    lead = F.regexp_extract(c, r"(?U)^\s*", 0)

    def pieces(tokens: Column) -> Column:
        last = F.greatest(F.ceil(F.size(tokens) / F.lit(size)).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.when(i == 0, lead).otherwise(F.lit("")), F.array_join(F.slice(tokens, i * size + 1, F.lit(size)), "")))

    # Bound, as inside the lambda all tokens would be found again for every piece.
    return F.when(is_blank(c), F.array().cast(_NONE)).otherwise(bound(F.regexp_extract_all(c, F.lit(r"(?U)\S+\s*"), F.lit(0)), pieces))


def _bounded(pieces: Column, size: int, then) -> Column:
    return F.flatten(F.transform(pieces, lambda p: F.when(word_count(p) > size, then(p)).otherwise(F.array(p))))


def force_split(c: Text, size: int) -> Column:
    """A long sentence: after commas, and what is still too long by words."""
    return _bounded(_cut(col(c), ","), size, lambda p: word_chunks(p, size))


def chunks(c: Text, size: int = 256) -> Column:
    """Sentences of at most ``size`` words, as texts. A blank text has none."""
    return F.when(is_blank(c), F.array().cast(_NONE)).otherwise(_bounded(_cut(col(c), "[.?!;]"), size, lambda p: force_split(p, size)))


def segment(c: Text, size: int = 256) -> Column:
    """The same as (text, start, end), half-open."""
    state = F.struct(F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"), F.lit(0).alias("at"))
    step = lambda a, p: F.struct(F.concat(a["out"], F.array(F.struct(p.alias("text"), a["at"].alias("start"), (a["at"] + F.length(p)).alias("end")))).alias("out"), (a["at"] + F.length(p)).alias("at"))
    return F.aggregate(chunks(c, size), state, step, lambda a: a["out"])
