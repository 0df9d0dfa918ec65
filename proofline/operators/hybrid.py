"""Dictionary-led correction: suspicious tokens, similar words, a scorer that chooses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..config import Hybrid
from ..functions.entities import BRANDS
from ..functions.text import Text, col, is_title, is_upper

#: Marks that count as known words.
MARKS = ".,!?;:()[]{}\"'<>_-%/\\"
#: What a token is.
TOKEN = r"(?U)\[\[ENT_\d+\]\]|[\w']+|[.,!?;:]"


def vocabulary(lines: DataFrame, column: str = "value") -> DataFrame:
    """syllable: the distinct parts of a word list's lines, and marks."""
    parts = lines.select(F.explode(F.split(F.lower(col(column)), r"(?U)[_\s]+")).alias("syllable")).where("syllable != ''")
    marks = lines.sparkSession.createDataFrame([(m,) for m in MARKS], "syllable string")
    return parts.unionByName(marks).distinct()


def tokens(c: Text) -> Column:
    """Words, marks and masked entities; everything else between them is dropped."""
    return F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0))


def joined(ts: Text) -> Column:
    """Tokens as text: marks close up to the left, one space elsewhere."""
    return F.regexp_replace(F.array_join(col(ts), " "), r" +(?=[.,!?;:])", "")


def may_be_wrong(token: Text, lexicon: tuple[str, ...]) -> Column:
    """What can be suspicious, if no vocabulary has it."""
    t = col(token)
    names = [F.lit(w) for w in sorted({b.lower() for b in BRANDS} | {w.lower() for w in lexicon})]
    exempt = t.rlike(r"^[0-9]+([.,][0-9]+)*$") | t.rlike("^https?://") | t.rlike(r"^\S+@\S+\.\S+$") | (is_upper(t) & (F.length(t) > 1)) | F.lower(t).isin(names)
    return t.rlike(r"^[\p{L}\p{N}]+$") & ~exempt


def suspicious(found: DataFrame, vocab: DataFrame, lexicon: tuple[str, ...]) -> DataFrame:
    """Rows of ``found`` (token, ...) whose token needs a look."""
    keyed = found.where(may_be_wrong("token", lexicon)).withColumn("_t", F.lower("token"))
    return keyed.join(vocab, F.col("_t") == F.col("syllable"), "left_anti").drop("_t")


def _similar(a: str, b: str) -> float:
    """200 * LCS / (len a + len b), bit-parallel."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / max(1, len(a) + len(b))


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_similar(x, y) for x, y in zip(a, b)])


def candidates(asked: DataFrame, vocab: DataFrame, settings: Hybrid = Hybrid()) -> DataFrame:
    """token, candidate, score, place: for each distinct token the ``top_k`` most similar words above
    the least similarity; equal ones in alphabetical order.

    A similarity above s needs 2 min(n, m) / (n + m) > s: only words of those lengths meet a token, by
    an equi-join on the length; of these, the built-in distance lets few through to Python."""
    least = settings.least_similarity / 100
    # No similarity above the least without that few edits: a test in the JVM before Python is called.
    edits = F.floor((1 - least) * (F.col("n") + F.col("m"))).cast("int")
    t = asked.select(F.lower("token").alias("token")).distinct().withColumn("n", F.length("token"))
    lo, hi = F.floor(F.col("n") * least / (2 - least)) + 1, F.ceil(F.col("n") * (2 - least) / least) - 1
    t = t.withColumn("m", F.explode(F.sequence(F.least(lo, hi), hi)))
    v = vocab.select(F.col("syllable").alias("candidate")).withColumn("m", F.length("candidate").cast("bigint"))
    near = t.join(v, "m").where(F.call_function("levenshtein", "token", "candidate", edits) >= 0)
    scored = near.withColumn("score", similarity("token", "candidate")).where(F.col("score") > settings.least_similarity)
    ranked = scored.withColumn("place", F.row_number().over(W.partitionBy("token").orderBy(F.desc("score"), "candidate")))
    return ranked.where(F.col("place") <= settings.top_k).select("token", "candidate", "score", "place")


def unigram_scores(vocab_counts: DataFrame, found: DataFrame) -> DataFrame:
    """The default scorer: a candidate's share of its token's candidates' corpus counts. Any scorer
    that adds ``probability`` (token, candidate) can stand in its place."""
    counted = found.join(vocab_counts, found["candidate"] == vocab_counts["syllable"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.withColumn("probability", F.col("n") / F.greatest(F.sum("n").over(W.partitionBy("token")), F.lit(1))).select("token", "candidate", "place", "probability")


def hybrid_correct(texts: DataFrame, vocab: DataFrame, scored: DataFrame, settings: Hybrid = Hybrid()) -> DataFrame:
    """``texts`` (text_id, text) with ``corrected``. Distinct suspicious tokens are settled once;
    ``scored`` has token, candidate, place, probability."""
    best = F.max_by("candidate", F.struct("probability", -F.col("place")))
    top = scored.groupBy("token").agg(best.alias("candidate"), F.max("probability").alias("probability")).where(F.col("probability") >= settings.confidence_threshold)
    spread = texts.select("text_id", F.posexplode(tokens("text")).alias("i", "token"))
    wrong = suspicious(spread.select("token").distinct(), vocab, settings.lexicon)
    fix = wrong.join(top.withColumnRenamed("token", "_t"), F.lower("token") == F.col("_t")).select("token", "candidate")
    cased = F.when(is_title("token"), F.concat(F.upper(F.substring("candidate", 1, 1)), F.substring("candidate", 2, 1 << 20))).when(is_upper("token"), F.upper("candidate")).otherwise(F.col("candidate"))
    new = spread.join(fix, "token", "left").withColumn("token", F.coalesce(cased, "token"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda p: p["token"])
    out = new.groupBy("text_id").agg(joined(parts).alias("corrected"))
    return texts.join(out, "text_id", "left").withColumn("corrected", F.coalesce("corrected", F.lit("")))


@dataclass
class HybridCorrector:
    """Dictionary-led correction of a run's texts, as a corrector that takes them as a table. ``vocab``:
    syllable; ``scorer`` adds ``probability`` to candidates (token, candidate, place), by default from the
    counts of the texts' own words."""

    vocab: DataFrame
    settings: Hybrid = field(default_factory=Hybrid)
    scorer: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    name: str = "hybrid"

    def correct_table(self, asked: DataFrame) -> DataFrame:
        """``asked`` (source) with ``raw``, the corrected text."""
        texts = asked.select(F.col("source").alias("text_id"), F.col("source").alias("text"))
        spread = texts.select(F.explode(tokens("text")).alias("token"))
        wrong = suspicious(spread.distinct(), self.vocab, self.settings.lexicon)
        counts = spread.groupBy(F.lower("token").alias("syllable")).agg(F.count(F.lit(1)).alias("n"))
        found = candidates(wrong, self.vocab, self.settings)
        scored = self.scorer(counts, found) if self.scorer else unigram_scores(counts, found)
        return hybrid_correct(texts, self.vocab, scored, self.settings).select(F.col("text_id").alias("source"), F.col("corrected").alias("raw"))
