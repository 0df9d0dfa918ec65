"""Correctors, the durable cache, and what is restored after a correction."""

from __future__ import annotations

import difflib
import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import align_trailing_punctuation, bullet, has_letter, is_blank, nfc, restore_whitespace, without_bullet
from ..schemas import CACHE
from ..sources.workspace import store

log = logging.getLogger("proofline")


class Corrector(Protocol):
    """A model: as many texts out as in, in their order. ``name`` tells models and their settings
    apart in the cache."""

    name: str

    def correct(self, texts: list[str]) -> list[str]: ...


@dataclass
class WordCorrector:
    """Replaces words by a map; the default where no model is at hand."""

    words: dict[str, str] = field(default_factory=dict)
    name: str = "words"

    def correct(self, texts: list[str]) -> list[str]:
        return [re.sub(r"\w+", lambda m: self.words.get(m[0], self.words.get(m[0].lower(), m[0])), t) for t in texts]


@dataclass
class DecodingSweep:
    """One corrector per decoding setting, each with its own name, so that none reads another's
    cached results. ``make`` builds a corrector from a setting."""

    make: object
    #: The settings that are compared.
    settings: tuple[dict, ...] = (
        {"num_beams": 1},
        {"num_beams": 2, "repetition_penalty": 1.05},
        {"num_beams": 2, "repetition_penalty": 1.2},
        {"num_beams": 4, "repetition_penalty": 1.1},
        {"do_sample": True, "temperature": 0.7, "top_p": 0.9},
    )

    def correctors(self) -> Iterator[Corrector]:
        for s in self.settings:
            c = self.make(s)
            c.name = f"{c.name}:{sorted(s.items())}"
            yield c


def _source_places(a: str, b: str) -> list[int]:
    """For each character of ``b``, the place in ``a`` that it stems from, or -1."""
    out = [-1] * len(b)
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a.lower(), b.lower()).get_opcodes():
        for c in range(k, m):
            if kind == "insert":
                out[c] = max(i - 1, 0)
            elif kind != "delete":
                out[c] = i + (c - k if j - i == m - k else min(int((c - k) / (m - k) * (j - i)), j - i - 1))
    return out


#: Letters among the characters up to U+1FFF, as one expression finds them; beyond, each character is asked.
_FAR = 0x2000
_LETTERS = re.compile("[" + "".join(c for c in map(chr, range(_FAR)) if c.isalpha()) + "]+")


def _letter_runs(text: str) -> list[tuple[int, int]]:
    if not text or ord(max(text)) < _FAR:
        return [m.span() for m in _LETTERS.finditer(text)]
    out, at = [], 0
    for letters, part in groupby(text, str.isalpha):
        n = len(list(part))
        if letters:
            out.append((at, at + n))
        at += n
    return out


def _between(text: str, runs: list[tuple[int, int]]) -> list[str]:
    ends = [0, *[x for run in runs for x in run], len(text)]
    return [text[a:z] for a, z in zip(ends[::2], ends[1::2])]


def _cased(old: str, new: str) -> str:
    """A word in the case of the one in its place."""
    if old == new:
        return new
    if len(old) > 1 and old.isupper():
        return new.upper()
    return (new[0].upper() if old[0].isupper() else new[0].lower() if old[0].islower() else new[0]) + new[1:]


def restored_case(original: str, corrected: str) -> str:
    """The corrected text with the original's capitals: words that stem from capitals are capitals,
    others take the case of the first letter they stem from. Where only words differ, and nothing between
    them, each stems from the one in its place; alignment by characters is for other texts, as it costs up to the
    square of their length and may pair letters of other words in long ones."""
    if original == corrected:
        return corrected
    if original.isupper():
        return corrected.upper()
    if original.islower():
        return corrected.lower()
    runs, new = _letter_runs(original), _letter_runs(corrected)
    if len(runs) == len(new) and (gaps := _between(original, runs)) == _between(corrected, new):
        cased = [_cased(original[a:z], corrected[b:y]) for (a, z), (b, y) in zip(runs, new)]
        return gaps[0] + "".join(w + gap for w, gap in zip(cased, gaps[1:]))
    if len(original.lower()) != len(original) or len(corrected.lower()) != len(corrected):
        return corrected
    initial = {a for a, _ in runs}
    shouted = {i for a, z in runs if z - a > 1 and original[a:z].isupper() for i in range(a, z)}
    source = _source_places(original, corrected)
    out = list(corrected)
    for a, z in new:
        known = [source[c] for c in range(a, z) if source[c] >= 0]
        if 2 * sum(s in shouted for s in known) >= z - a:
            out[a:z] = [c.upper() for c in out[a:z]]
        elif known:
            model = original[next((s for s in known if s in initial), known[0])]
            out[a] = out[a].upper() if model.isupper() else out[a].lower() if model.islower() else out[a]
    return "".join(out)


@pandas_udf(StringType())
def restore_capitalization(original: pd.Series, corrected: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else restored_case(a, b) for a, b in zip(original, corrected)])


def _run(corrector: Corrector, batch_size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out = b["source"].tolist(), []
            for i in range(0, len(texts), batch_size):
                part = texts[i : i + batch_size]
                try:
                    new = corrector.correct(part)
                    if len(new) != len(part):
                        raise ValueError(f"{len(part)} texts in, {len(new)} out")
                except Exception as e:  # a failed batch keeps its texts
                    log.warning("a batch of %d texts was not corrected: %s", len(part), e)
                    new = [None] * len(part)
                out += new
            yield pd.DataFrame({"source": texts, "raw": out})

    return run


def with_sources(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_nfc``, ``bullet`` and ``source`` (what a corrector sees; null if it has no letters)."""
    c = chunks.withColumn("_nfc", nfc(text)).withColumn("bullet", bullet("_nfc")).withColumn("_s", without_bullet("_nfc"))
    return c.withColumn("source", F.when(~is_blank("_s") & has_letter("_s"), F.col("_s"))).drop("_s")


def cache_split(found: DataFrame, cache: DataFrame | None, corrector: str) -> tuple[DataFrame, DataFrame]:
    """Of distinct sources in ``found``: those the cache has for this corrector (source, corrected), and
    those it lacks (source)."""
    asked = found.where("source is not null").select("source").distinct()
    if cache is None:
        return found.sparkSession.createDataFrame([], CACHE).select("source", "corrected"), asked
    known = cache.where(F.col("corrector") == corrector).select("source", "corrected").dropDuplicates(["source"])
    return asked.join(known, "source"), asked.join(known, "source", "left_anti")


def correct(chunks: DataFrame, corrector: Corrector, cache: DataFrame | None = None, text: str = "text", batch_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """``chunks`` with ``corrected``, and the rows to append to the cache (corrector, source, corrected), a
    stored table. Each distinct text that the cache lacks is corrected once; failures are not cached. A
    corrector with ``correct_table`` gets all texts as a table, others get batches."""
    found = with_sources(chunks, text)
    known, missing = cache_split(found, cache, corrector.name)
    whole = getattr(corrector, "correct_table", None)
    raw = whole(missing) if whole else missing.mapInPandas(_run(corrector, batch_size), "source string, raw string")
    fresh = raw.where("raw is not null").withColumn("corrected", restore_capitalization("source", align_trailing_punctuation("source", "raw"))).select(F.lit(corrector.name).alias("corrector"), "source", "corrected")
    fresh = store(fresh, "corrections")
    done = found.join(known.unionByName(fresh.select("source", "corrected")), "source", "left")
    out = F.when(F.col("source").isNull(), F.col("_nfc")).when(F.col("corrected").isNull(), F.col(text)).otherwise(restore_whitespace(text, F.concat("bullet", F.col("corrected"))))
    return done.withColumn("corrected", out).select(*chunks.columns, "corrected"), fresh
