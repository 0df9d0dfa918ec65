"""A training corpus from raw documents: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Every stage's result is written as Parquet in the folder that spark.checkpoint.dir names
and read again, so a stage never recomputes the one before it.

Results for odd input are those of the stages: documents with null, empty or blank text stay and become one
piece; rows with a null doc_id stay, as nothing can name them to take them out, unless they are toxic; rows that
repeat a doc_id are scored each, and go or stay together afterwards; other columns of any name are kept up to the
last stage; an empty table gives no pieces; without labels no document is toxic, without benchmark items none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofline.llm import common
from proofline.llm.decontaminate import decontamination_stage
from proofline.llm.line_dedup import line_dedup_stage
from proofline.llm.near_dedup import near_dedup_stage
from proofline.llm.packing import packing_stage
from proofline.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned scores, components over signatures and token ids are beyond SQL; tests/llm holds the
#: result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, applied to the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.store(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return docs
