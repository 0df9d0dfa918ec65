"""Proofread Word documents, evaluate corrections, learn thresholds from feedback.

python -m proofline --input FOLDER --output FOLDER
python -m proofline evaluate --input A --expected B --actual C --output FOLDER
python -m proofline sweep --input A --expected B --model NAME --output FOLDER
python -m proofline train --feedback FILE --output FOLDER
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators.correct import Corrector, DecodingSweep, WordCorrector
from .operators.hybrid import HybridCorrector
from .operators.models import Seq2SeqCorrector, load_corrector
from .operators.report import document_reports, write_reports
from .plans.evaluation import evaluate_documents, sweep, thresholds
from .plans.proofread import proofread
from .sources.docx import read_docx, write_docx
from .sources.files import saved
from .sources.tables import append_cache, read_cache, read_feedback, read_review, read_vocabulary, write_review

log = logging.getLogger("proofline")


def uri(path: str) -> str:
    """Paths without a scheme are on this machine's file system."""
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def _text_file(spark: SparkSession, name: str, text: str, folder: str) -> None:
    saved(spark.createDataFrame([(name, bytearray(text.encode()))], "name string, content binary").coalesce(1), folder)


def _settings(a: argparse.Namespace) -> Config:
    config = Config.load(a.config) if a.config else Config()
    engine = {k: v for k, v in (("mode", a.mode), ("highlight", a.highlight), ("apply_confidence_gate", a.confidence_gate), ("track_changes", a.track_changes)) if v is not None}
    return dataclasses.replace(config, engine=dataclasses.replace(config.engine, **engine), model=a.model or config.model)


def _corrector(spark: SparkSession, a: argparse.Namespace, config: Config) -> Corrector | HybridCorrector:
    if a.experimental:
        if not a.vocabulary:
            raise SystemExit("--experimental needs --vocabulary")
        return HybridCorrector(read_vocabulary(spark, uri(a.vocabulary)), config.hybrid)
    if a.words or not config.model:
        words = {}
        if a.words:
            with open(a.words, encoding="utf-8") as f:
                words = json.load(f)
        return WordCorrector(words)
    return load_corrector(config.model) if ":" in config.model else Seq2SeqCorrector(config.model, config.max_words)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Documents, their reports, review records, and new rows of the cache."""
    config = _settings(a)
    corrector = _corrector(spark, a, config)
    out, reports = uri(a.output), uri(a.report or os.path.join(a.output, "reports"))
    cache = uri(a.cache or os.path.join(a.output, "cache.parquet"))
    r = proofread(read_docx(spark, uri(a.input)), corrector, config, read_cache(spark, cache))
    append_cache(r.cache, cache)
    n = saved(write_docx(spark, uri(a.input), r.paragraphs).select(F.col("doc_id").alias("name"), "content"), out)
    write_reports(r.stats, r.changes, reports)
    saved(document_reports(r.stats, r.changes), reports)
    write_review(r.review, f"{reports}/review.json")
    log.info("%d documents, %d texts corrected anew", n, r.cache.count())
    r.release()


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of a document, or of a folder's. A single document goes by no name, so that it meets its
    other versions."""
    paras = read_docx(spark, uri(path))
    return paras.withColumn("doc_id", F.lit("document")) if path.endswith(".docx") else paras


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    e = evaluate_documents(*[_documents(spark, p) for p in (a.input, a.expected, a.actual)])
    review = read_review(spark, uri(a.review)) if a.review else None
    _text_file(spark, "evaluation.md", e.markdown(review), uri(a.output))
    e.release()


def decode(spark: SparkSession, a: argparse.Namespace) -> None:
    make = lambda s: load_corrector(a.model, decoding=s)
    rows = sweep(_documents(spark, a.input), _documents(spark, a.expected), DecodingSweep(make).correctors())
    _text_file(spark, "sweep.json", json.dumps(rows, indent=1), uri(a.output))


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    try:
        found = thresholds(read_feedback(spark, uri(a.feedback)))
    except ValueError as e:
        raise SystemExit(str(e)) from None
    _text_file(spark, "thresholds.json", json.dumps(found, indent=1), uri(a.output))


def main(args: list[str] | None = None) -> None:
    args = list(sys.argv[1:] if args is None else args)
    name = args.pop(0) if args and args[0] in ("run", "evaluate", "sweep", "train") else "run"
    p = argparse.ArgumentParser(prog=f"proofline {name}", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--output", required=True, help="a folder")
    p.add_argument("--debug", action="store_true")
    if name == "train":
        p.add_argument("--feedback", required=True, help="a CSV file of labelled edits")
    else:
        p.add_argument("--input", required=True, help="a .docx file or a folder of them")
    if name in ("evaluate", "sweep"):
        p.add_argument("--expected", required=True, help="the same documents as they should be")
    if name == "evaluate":
        p.add_argument("--actual", required=True, help="the same documents as they were corrected")
        p.add_argument("--review", help="review records of the run")
    if name in ("run", "sweep"):
        p.add_argument("--model", required=name == "sweep", help="a sequence-to-sequence model, or module:factory of a corrector")
    if name == "run":
        switch = argparse.BooleanOptionalAction
        p.add_argument("--report", help="a folder for reports; by default one in the output")
        p.add_argument("--cache", help="the table of corrections to read and add to; by default one in the output")
        p.add_argument("--config", help="a YAML file of settings")
        p.add_argument("--mode", choices=("safe", "review", "aggressive"))
        p.add_argument("--confidence-gate", action=switch, default=None, help="let the mode decide on edits")
        p.add_argument("--highlight", "--highlight-fallback", action=switch, default=None)
        p.add_argument("--track-changes", action=switch, default=None, help="kept with the settings; no revision marks are written")
        p.add_argument("--words", help="a JSON object of replacements for the default corrector")
        p.add_argument("--experimental", action="store_true", help="dictionary-led correction")
        p.add_argument("--vocabulary", help="its word list")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.debug else logging.INFO)
    spark = SparkSession.builder.appName("proofline").getOrCreate()
    {"run": run, "evaluate": evaluate, "sweep": decode, "train": train}[name](spark, a)


if __name__ == "__main__":
    main()
