"""Rules on single edits: whether one is safe to apply, and what kind it is."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..config import SafetyRules
from ..schemas import EDITS
from .arrays import bound
from .text import Text, col, strip, word_count, words

#: ASCII punctuation and white space only, or nothing.
_MARKS_ONLY = r"^(?:[!-/:-@\[-`{-~]|(?U:\s))*$"
_FEW = "".join(map(chr, range(0x21, 0x7F)))


def lexicon_violation(original: Text, corrected: Text, lexicon: tuple[str, ...]) -> Column:
    """A listed name is in the original and no longer in the corrected text."""
    a, b = F.lower(col(original)), F.lower(col(corrected))
    out = F.lit(False)
    for w in lexicon:
        out = out | (F.contains(a, F.lit(w.lower())) & ~F.contains(b, F.lit(w.lower())))
    # Few texts have any; the others are lowered once, not for each name.
    return F.when(a.rlike("|".join(re.escape(w.lower()) for w in lexicon)), out).otherwise(F.lit(False)) if lexicon else out


def length_delta(original: Text, corrected: Text) -> Column:
    n = F.length(col(original))
    return F.abs(F.length(col(corrected)) - n) / F.greatest(F.lit(1), n)


def _letter(place: Column) -> Column:
    """A character of its own for each place from 1: of a short list where that has it, else the code
    point so far beyond it, leaving out the surrogates (up to a million)."""
    far = place + 0x4DFF
    code = F.when(far < 0xD800, far).otherwise(far + 0x800)
    return F.when(place <= len(_FEW), F.substring(F.lit(_FEW), place.cast("int"), F.lit(1))).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _measured(x: Column) -> Column:
    """Of two word lists (a, b), with ``known``: the distinct words of both. Each becomes one character, so the
    built-in distance of strings does it."""
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: _letter(F.array_position(x["known"], w))), "")
    return F.struct(x["a"].alias("a"), x["b"].alias("b"), F.levenshtein(coded(x["a"]), coded(x["b"])).alias("distance"))


def _with_known(x: Column) -> Column:
    return F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_distinct(F.concat(x["a"], x["b"])).alias("known"))


def word_distance(original: Text, corrected: Text) -> Column:
    return bound(F.struct(words(original).alias("a"), words(corrected).alias("b")), _with_known, _measured, lambda x: x["distance"])


def word_edit_ratio(original: Text, corrected: Text) -> Column:
    return word_distance(original, corrected) / F.greatest(F.lit(1), word_count(original))


def _repeats(w: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.struct(F.lower(F.get(w, i)).alias("a"), F.lower(F.get(w, i + 1)).alias("b")))
    again = lambda x: (F.length(x["a"]) >= 2) & (F.length(x["b"]) <= 2) & (F.startswith(x["b"], F.right(x["a"], F.lit(1))) | F.endswith(x["b"], F.right(x["a"], F.lit(1))))
    return F.when(F.size(w) < 2, F.lit(False)).otherwise(F.exists(pairs, again))


def repeats_itself(corrected: Text) -> Column:
    """A word is followed by one of one or two letters that starts or ends with its last letter."""
    return bound(words(corrected), _repeats)


def verdict(original: Text, corrected: Text, rules: SafetyRules = SafetyRules()) -> Column:
    """(is_safe, reason, edit_ratio, length_delta): the first rule that decides; measures that
    were not reached are 0."""
    a, b = col(original), col(corrected)
    delta, zero = length_delta(a, b), F.lit(0.0)
    as_ = lambda safe, reason, r, d: F.struct(F.lit(safe).alias("is_safe"), F.lit(reason).alias("reason"), r.alias("edit_ratio"), d.alias("length_delta"))

    def rated(x: Column) -> Column:
        n = F.size(x["a"])
        return F.struct(n.alias("n"), x["b"].alias("b"), (x["distance"] / F.greatest(F.lit(1), n)).alias("ratio"))

    def by_words(x: Column) -> Column:
        ratio = x["ratio"]
        return (
            F.when(x["n"] == 0, as_(False, "insertion_burst", zero, F.lit(1.0)))
            .when((ratio > rules.edit_ratio) & (x["n"] > 3), as_(False, "edit_ratio_exceeded", ratio, delta))
            .when(_repeats(x["b"]), as_(False, "repetition_hallucination", ratio, delta))
            .otherwise(as_(True, "safe", ratio, delta))
        )

    return (
        F.when(a == b, as_(True, "equal", zero, zero))
        .when(lexicon_violation(a, b, rules.lexicon), as_(False, "whitelist_violation", zero, zero))
        .when(a == "", as_(False, "insertion_burst", zero, F.lit(1.0)))
        .when(delta > rules.length_delta_ratio, as_(False, "length_delta_exceeded", zero, delta))
        .otherwise(bound(F.struct(words(a).alias("a"), words(b).alias("b")), _with_known, _measured, rated, by_words))
    )


def category(original: Text, corrected: Text) -> Column:
    """The kind of an edit between different texts."""
    a, b = col(original), col(corrected)
    return (
        F.when(strip(a) == strip(b), F.lit("spacing_fix"))
        .when(a.rlike(_MARKS_ONLY) & b.rlike(_MARKS_ONLY), F.lit("punctuation_fix"))
        .when(F.lower(a) == F.lower(b), F.lit("capitalization_fix"))
        .when((word_count(a) > 3) | (word_count(b) > 3), F.lit("rewrite_large"))
        .otherwise(F.lit("spelling_or_diacritics_fix"))
    )


def markdown(kind: Text, original: Text, corrected: Text) -> Column:
    gone, new = F.concat(F.lit("~~"), col(original), F.lit("~~")), F.concat(F.lit("**"), col(corrected), F.lit("**"))
    return F.when(col(kind) == "replace", F.concat_ws(" ", gone, new)).when(col(kind) == "insert", new).when(col(kind) == "delete", gone).otherwise(F.lit(""))


def _aligned(a, b, text) -> list[dict]:
    ops = difflib.SequenceMatcher(None, a, b).get_opcodes()
    return [{"type": t, "orig_start": i, "orig_end": j, "corr_start": k, "corr_end": m, "orig_text": text(a[i:j]), "corr_text": text(b[k:m])} for t, i, j, k, m in ops]


@pandas_udf(EDITS)
def char_diff(original: pd.Series, corrected: pd.Series) -> pd.Series:
    """Opcodes between two texts by characters, equal parts included. Alignment is the standard
    library's, whose results can't be had from SQL."""
    return pd.Series([None if a is None or b is None else _aligned(a, b, str) for a, b in zip(original, corrected)])


@pandas_udf(EDITS)
def word_diff(original: pd.Series, corrected: pd.Series) -> pd.Series:
    """The same by words; places count words."""
    return pd.Series([None if a is None or b is None else _aligned(a.split(), b.split(), " ".join) for a, b in zip(original, corrected)])
