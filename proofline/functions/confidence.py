"""How far a correction can be trusted, and what to do with it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Thresholds
from .text import Text, col, word_count

#: Quotes and brackets whose counts must stay.
PAIRED = ('"', "'", "(", ")", "[", "]", "{", "}", "“", "”", "‘", "’")
#: Kinds of edits that cost little.
LIGHT = ("spelling_or_diacritics_fix", "whitespace_fix", "punctuation_fix")


def confidence(original: Text, corrected: Text, changes: Text, categories: Text) -> Column:
    """0 to 1. ``changes``: number of edits that change something; ``categories``: their kinds."""
    a, b, n, kinds = col(original), col(corrected), col(changes), col(categories)
    light = F.size(F.array_except(kinds, F.array(*[F.lit(k) for k in LIGHT]))) == 0
    per_word = F.least(F.lit(0.3), 0.3 * n / F.greatest(F.lit(1), word_count(a)))
    apart = F.abs(F.length(a) - F.length(b))
    only = lambda x: F.regexp_replace(x, rf"[^{re.escape(''.join(PAIRED))}]", "")
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))

    def apart_by(m: Column) -> Column:
        """Mostly neither text has any, or both the same."""
        some = F.lit(False)
        for c in PAIRED:
            some = some | (count(m["a"], c) != count(m["b"], c))
        return F.when(m["a"] == m["b"], F.lit(False)).otherwise(some)

    unpaired = F.get(F.transform(F.array(F.struct(only(a).alias("a"), only(b).alias("b"))), apart_by), 0)
    score = (
        F.lit(1.0)
        - F.when(light, F.least(F.lit(0.1), 0.01 * n)).otherwise(per_word)
        - F.when(apart > 5, F.least(F.lit(0.3), 0.02 * apart)).otherwise(0.0)
        - F.when(word_count(b) < word_count(a), 0.5).otherwise(0.0)
        - F.when(unpaired, 0.5).otherwise(0.0)
    )
    return F.when(a == b, 1.0).when(F.array_contains(kinds, "rewrite_large"), 0.4).otherwise(F.greatest(F.lit(0.0), score))


def action(score: Text, mode: Text, at: Thresholds = Thresholds()) -> Column:
    s, m = col(score), col(mode)
    return (
        F.when(m == "safe", F.when(s >= at.safe, "apply").otherwise("skip"))
        .when(m == "review", F.when(s >= at.review, "apply").when(s >= at.aggressive, "review").otherwise("skip"))
        .when(m == "aggressive", F.when(s >= at.aggressive, "apply").otherwise("review"))
        .otherwise("skip")
    )
