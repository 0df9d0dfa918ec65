"""Corrections against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.entities import BRANDS
from ..functions.text import Text, col, remove_accents
from .intervals import overlapping

#: Words of a stretch in which edits meet.
STRETCH = 64


def accent_only(original: Text, expected: Text) -> Column:
    return F.when(remove_accents(original) == remove_accents(expected), F.lit("diacritics")).otherwise(F.lit("spelling"))


def outcomes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A row per expected edit, and per actual edit that none of them met: doc_id, category, outcome
    (TP, FP, FN), original, expected, actual, pass (0 expected, 1 unmatched), edit_no.

    ``expected``: doc_id, edit_no, in_start, in_end, original, expected, category; ``actual``: the same
    with actual. An expected edit meets the first actual one it overlaps; an actual edit can be met by
    several. Edits without width overlap nothing."""
    a = actual.select("doc_id", F.col("edit_no").alias("act_no"), F.col("in_start").alias("a0"), F.col("in_end").alias("a1"), "actual")
    over = overlapping(expected.where("in_start < in_end"), a.where("a0 < a1"), ["doc_id"], ("in_start", "in_end"), ("a0", "a1"), STRETCH)
    first = over.groupBy("doc_id", "edit_no").agg(F.min_by(F.struct("act_no", "actual"), "act_no").alias("m"))
    met = expected.join(first, ["doc_id", "edit_no"], "left")
    outcome = F.when(F.col("m").isNull(), "FN").when(F.col("m.actual") == F.col("expected"), "TP").otherwise("FP")
    own = met.select("doc_id", "category", outcome.alias("outcome"), "original", "expected", F.coalesce("m.actual", "original").alias("actual"), F.lit(0).alias("pass"), "edit_no")
    used = first.select("doc_id", F.col("m.act_no").alias("edit_no"))
    rest = actual.join(used, ["doc_id", "edit_no"], "left_anti")
    extra = rest.select("doc_id", F.lit("spelling").alias("category"), F.lit("FP").alias("outcome"), "original", F.col("original").alias("expected"), "actual", F.lit(1).alias("pass"), "edit_no")
    return own.unionByName(extra)


def groups(found: DataFrame) -> DataFrame:
    """category, tp, fp, fn."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k.lower())
    return found.groupBy("category").agg(n("TP"), n("FP"), n("FN"))


def precision_recall(counted: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; 0 where nothing divides."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counted.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0))


def exemplars(found: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` errors of each category: expected edits in order, then unmatched ones. The
    window keeps n rows a task before its shuffle."""
    w = W.partitionBy("category").orderBy("pass", "doc_id", "edit_no")
    # How errors are named.
    status = F.when(F.col("outcome") == "FN", "FN (Missed)").when(F.col("pass") == 0, "FP (Wrong correction)").otherwise("FP (Unnecessary edit)")
    ranked = found.where("outcome != 'TP'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.select("category", "place", "original", "expected", "actual", status.alias("status"))


def samples(found: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` of each outcome: outcome, place, original, expected, actual."""
    w = W.partitionBy("outcome").orderBy("pass", "doc_id", "edit_no")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("outcome", "place", "original", "expected", "actual")


def blocked(review: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` refused edits."""
    return review.where("status = 'Rejected'").orderBy("document_id", "paragraph_id", "edit_id").limit(n).select("document_id", "paragraph_id", "original_text", "corrected_text", "reason")


def entity_failures(paras: DataFrame, text: str = "text") -> DataFrame:
    """One row: pairs of a paragraph and a brand that it spells another way only."""
    brands = F.array(*[F.lit(b) for b in BRANDS.values()])
    wrong = F.filter(brands, lambda b: F.contains(F.lower(col(text)), F.lower(b)) & ~F.contains(col(text), b))
    return paras.agg(F.coalesce(F.sum(F.size(wrong)), F.lit(0)).cast("long").alias("failures"))


def format_failures(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, failures: by how many paragraphs two versions of a document differ."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    both = n(before, "a").join(n(after, "b"), "doc_id", "full")
    return both.select("doc_id", F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("failures"))


def reject_rate(review: DataFrame) -> DataFrame:
    rejected = F.count_if(F.col("status") == "Rejected")
    n = F.count(F.lit(1))
    return review.agg(n.alias("total"), rejected.alias("rejected"), F.when(n > 0, 100.0 * rejected / F.greatest(n, F.lit(1))).otherwise(0.0).alias("reject_rate"))
