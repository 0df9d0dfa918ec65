"""Evaluations of whole documents, and thresholds from feedback."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.edits import word_diff
from ..operators import evaluate as V
from ..operators import tuning as U
from ..operators.blocks import drop_blank
from ..operators.correct import Corrector
from ..operators.report import evaluation_markdown
from ..sources.workspace import discard, store
from .proofread import proofread


@dataclass
class Evaluation:
    """outcomes: every edit that was expected or made; counted: by category; paragraphs: non-blank body
    paragraphs of the input and of the corrected documents."""

    outcomes: DataFrame
    counted: DataFrame
    before: DataFrame
    after: DataFrame

    def markdown(self, review: DataFrame | None = None) -> str:
        """The report; a few rows of each table reach the driver."""
        rows = lambda df: [r.asDict() for r in df.collect()]
        failures = {"entities": V.entity_failures(self.after).first()["failures"], "paragraphs": V.format_failures(self.before, self.after).agg(F.coalesce(F.sum("failures"), F.lit(0)).alias("n")).first()["n"]}
        rate = rows(V.reject_rate(review))[0] if review is not None else None
        refused = rows(V.blocked(review)) if review is not None else None
        errors = rows(V.exemplars(self.outcomes).orderBy("category", "place"))
        return evaluation_markdown(rows(self.counted.orderBy("category")), errors, failures, rate, refused, rows(V.samples(self.outcomes).orderBy("outcome", "place")))

    def release(self) -> None:
        discard(self.outcomes)


def _whole(paras: DataFrame, name: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    return paras.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias(name))


def evaluate_documents(before: DataFrame, expected: DataFrame, after: DataFrame) -> Evaluation:
    """Documents as they were, as they should be and as they were corrected (paragraphs: doc_id, para_idx,
    section, text; the same doc_ids). Body paragraphs count. A document is aligned by words as a
    whole, in one task; documents that lack a version have none of it."""
    body = [drop_blank(p.where("section = 'body'")).select("doc_id", "para_idx", "text") for p in (before, expected, after)]
    a, b, c = (_whole(p, n) for p, n in zip(body, ("a", "b", "c")))
    both = a.join(b, "doc_id", "left").join(c, "doc_id", "left").select("doc_id", "a", *[F.coalesce(n, F.lit("")).alias(n) for n in ("b", "c")])
    both = both.select("doc_id", word_diff("a", "b").alias("exp"), word_diff("a", "c").alias("act"))
    both = store(both, "aligned")
    edits = lambda col: both.select("doc_id", F.posexplode(col).alias("edit_no", "e")).where("e.type != 'equal'").select("doc_id", "edit_no", F.col("e.orig_start").alias("in_start"), F.col("e.orig_end").alias("in_end"), F.col("e.orig_text").alias("original"), F.col("e.corr_text").alias("text"))
    wanted = edits("exp").withColumnRenamed("text", "expected")
    wanted = wanted.withColumn("category", V.accent_only("original", "expected"))
    found = store(V.outcomes(wanted, edits("act").withColumnRenamed("text", "actual")), "outcomes")
    discard(both)
    return Evaluation(found, V.precision_recall(V.groups(found)), body[0], body[2])


def sweep(before: DataFrame, expected: DataFrame, correctors: Iterable[Corrector], config: Config = Config()) -> list[dict]:
    """Correct ``before`` with each corrector and count what came out: corrector, category, tp, fp, fn,
    precision, recall, f1."""
    out = []
    for corrector in correctors:
        r = proofread(before, corrector, config)
        after = before.select("doc_id", "para_idx", "section", F.col("text").alias("_text")).join(r.paragraphs.select("doc_id", "para_idx", "text_out"), ["doc_id", "para_idx"], "left")
        e = evaluate_documents(before, expected, after.withColumn("text", F.coalesce("text_out", "_text")))
        out += [{"corrector": corrector.name, **x.asDict()} for x in e.counted.orderBy("category").collect()]
        e.release()
        r.release()
    return out


def thresholds(feedback: DataFrame) -> dict:
    """What reviewers' feedback says: suggested thresholds, the model's weights, and its report by label.
    Raises if there is too little to learn from."""
    model, predicted = U.fit_model(feedback)
    return {
        "rows": predicted.count(),
        "weights": dict(zip(U.FEATURES, (round(float(x), 6) for x in model.coefficients))),
        "intercept": round(float(model.intercept), 6),
        "suggested": U.suggested(feedback).first().asDict(),
        "report": [r.asDict() for r in U.classification_report(predicted).orderBy("label").collect()],
    }
