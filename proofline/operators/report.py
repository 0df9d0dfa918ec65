"""Statistics, review records and reports of a run."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of the change report.
CHANGES = ("file_name", "section_name", "paragraph_index", "original_text", "corrected_text", "error_type", "confidence", "action_status", "changed_word_count")


def change_stats(blocks: DataFrame, chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """A row per document. ``blocks``: doc_id; ``chunks``: doc_id, words; ``edits``: doc_id, status
    (Applied, Skipped, Rejected), words, chunk.

    total_changed_sentences counts edits and total_changes_skipped is always 0, as reports always
    had it; total_changed_chunks and total_rejected have what the names suggest."""
    applied = F.col("status") == "Applied"
    b = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_paragraphs"))
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_sentences"), F.sum("words").alias("total_words"))
    e = edits.groupBy("doc_id").agg(
        F.count_if(applied).alias("total_changes_applied"), F.sum(F.when(applied, F.col("words")).otherwise(0)).alias("total_changed_words"),
        F.countDistinct(F.when(applied, F.col("chunk"))).alias("total_changed_chunks"), F.count_if(F.col("status") == "Rejected").alias("total_rejected"),
    )
    out = b.join(c, "doc_id", "left").join(e, "doc_id", "left").na.fill(0)
    out = out.withColumn("total_changed_sentences", F.col("total_changes_applied")).withColumn("total_changes_skipped", F.lit(0).cast("long"))
    ratio = lambda a, b: F.round(100.0 * F.col(a) / F.greatest(F.lit(1), F.col(b)), 2)
    return out.withColumn("changed_word_ratio_percent", ratio("total_changed_words", "total_words")).withColumn("changed_sentence_ratio_percent", ratio("total_changed_sentences", "total_sentences"))


def breakdown(edits: DataFrame) -> DataFrame:
    """doc_id, category, n over applied edits (doc_id, status, category)."""
    return edits.where("status = 'Applied'").groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"))


def review_edits(edits: DataFrame) -> DataFrame:
    """Review records with ids that a second run gives again."""
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("para_idx").cast("string"), F.col("local_start").cast("string"), F.col("local_end").cast("string"), "corr_text")
    return edits.select(
        F.sha2(key, 256).alias("edit_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("para_idx").cast("int").alias("paragraph_id"), F.col("orig_text").alias("original_text"),
        F.col("corr_text").alias("corrected_text"), "status", "reason", "edit_ratio", F.col("length_delta").alias("length_delta_ratio"), F.lit(0.0).alias("confidence"),
    )


def report_changes(edits: DataFrame) -> DataFrame:
    """Edits refused because they would merge paragraphs: the nine columns of the change report."""
    return edits.where("reason = 'destructive_merge'").select(
        F.col("doc_id").cast("string").alias("file_name"), "section_name", F.col("para_idx").alias("paragraph_index"), F.col("orig_text").alias("original_text"), F.col("corr_text").alias("corrected_text"),
        F.lit("rejected_destructive_merge").alias("error_type"), F.lit(0.0).alias("confidence"), F.lit("reject").alias("action_status"), F.lit(0).alias("changed_word_count"),
    )


def write_reports(stats: DataFrame, changes: DataFrame, path: str) -> None:
    """CSV with a header, and JSON, as tables of all documents."""
    changes.write.mode("overwrite").option("header", True).csv(f"{path}/report.csv")
    _by_document(stats, changes).select("file_name", "stats", "changes").write.mode("overwrite").json(f"{path}/report.json")


def _by_document(stats: DataFrame, changes: DataFrame) -> DataFrame:
    own = [c for c in changes.columns if c != "file_name"]
    per = changes.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("paragraph_index", *[c for c in own if c != "paragraph_index"]))).alias("changes"))
    both = stats.withColumn("file_name", F.col("doc_id").cast("string")).join(per, "file_name", "left")
    return both.select("file_name", F.struct(*[c for c in stats.columns if c != "doc_id"]).alias("stats"), F.coalesce("changes", F.array()).alias("changes"))


def document_reports(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """name, content: for each document a page, a CSV file and a JSON file of its own, named after it. A
    document's changes are gathered in one row."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, own, found in zip(b["file_name"], b["stats"], b["changes"]):
                found = [{"file_name": name, **dict(c)} for c in found]
                rows.append((f"{name}.report.html", page(name, dict(own), found)))
                rows.append((f"{name}.report.csv", comma_separated(found)))
                rows.append((f"{name}.report.json", json.dumps({"file_name": name, "stats": dict(own), "changes": found}, ensure_ascii=False, default=str)))
            yield pd.DataFrame({"name": [n for n, _ in rows], "content": [c.encode() for _, c in rows]})

    return _by_document(stats, changes).mapInPandas(made, "name string, content binary")


def comma_separated(found: list[dict]) -> str:
    out = io.StringIO()
    lines = csv.DictWriter(out, CHANGES, extrasaction="ignore")
    lines.writeheader()
    lines.writerows(found)
    return out.getvalue()


def page(name: str, stats: dict, found: list[dict]) -> str:
    """One document's report: its figures as a list of terms, each refused edit as an article."""
    say = lambda v: html.escape(str(v))
    figures = "\n".join(f"<dt>{say(k.replace('_', ' '))}</dt><dd>{say(v)}</dd>" for k, v in stats.items())
    edits = "\n".join(
        f"<article><h3>Paragraph {say(c['paragraph_index'])} ({say(c['section_name'])})</h3><p><del>{say(c['original_text'])}</del> <ins>{say(c['corrected_text'])}</ins></p><small>{say(c['error_type'])}</small></article>" for c in found
    )
    return f"<!doctype html>\n<html lang='vi'>\n<meta charset='utf-8'>\n<title>{say(name)}</title>\n<main>\n<h1>{say(name)}</h1>\n<dl>\n{figures}\n</dl>\n<section>\n{edits or 'No edit was refused.'}\n</section>\n</main>\n</html>\n"


def _table(head: tuple[str, ...], rows: list[dict]) -> list[str]:
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *["| " + " | ".join(cell(r[h]) for h in head) + " |" for r in rows], ""] if rows else ["none", ""]


def evaluation_markdown(counted: list[dict], errors: list[dict], failures: dict, rate: dict | None = None, blocked: list[dict] | None = None, samples: list[dict] | None = None) -> str:
    """An evaluation as text; all arguments are small. ``counted``: category, tp, fp, fn, precision, recall, f1;
    ``failures``: entities, paragraphs; ``rate``: total, rejected, reject_rate."""
    rounded = [{**c, **{k: f"{c[k]:.2f}" for k in ("precision", "recall", "f1")}} for c in counted]
    out = ["# How the corrections did", "", *_table(("category", "tp", "fp", "fn", "precision", "recall", "f1"), rounded)]
    out += [f"Names spelled another way: {failures['entities']}. Paragraphs more or fewer: {failures['paragraphs']}.", ""]
    if rate:
        out += [f"Of {rate['total']} edits {rate['rejected']} were refused ({rate['reject_rate']:.2f} %).", ""]
    for c in counted:
        out += [f"## Errors: {c['category']}", "", *_table(("original", "expected", "actual", "status"), [e for e in errors if e["category"] == c["category"]])]
    if blocked is not None:
        out += ["## Refused edits", "", *_table(("original_text", "corrected_text", "reason"), blocked)]
    for kind in ("TP", "FN", "FP") if samples is not None else ():
        out += [f"## Samples: {kind}", "", *_table(("original", "expected", "actual"), [s for s in samples if s["outcome"] == kind])]
    return "\n".join(out)
