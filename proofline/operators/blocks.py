"""Paragraphs into logical blocks, and places inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import Text, col, is_blank, strip

#: Styles that never continue a paragraph.
SPECIAL = ("Heading", "List", "Caption", "Title", "Subtitle")
MERGE_AT = 2


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, para_idx (blank ones count), section, text: the lines of each document."""
    return docs.select("doc_id", F.posexplode(F.split(col(text), "\n", -1)).alias("para_idx", "text")).withColumn("section", F.lit("body"))


def merge_score(previous: Text, following: Text, style: Text, next_style: Text) -> Column:
    a, b = strip(previous), strip(following)
    own, nxt = F.coalesce(col(style), F.lit("")), F.coalesce(col(next_style), F.lit(""))
    special = F.lit(False)
    for s in SPECIAL:
        special = special | F.contains(nxt, F.lit(s))
    score = (
        F.when(a.rlike(r"[.?!]$"), 0).otherwise(2)
        + F.when(b.rlike(r"^\p{Ll}"), 2).otherwise(0)
        - F.when(special, 5).otherwise(0)
        - F.when(own != nxt, 2).otherwise(0)
    )
    return F.when(col(following).isNull(), None).when(is_blank(a) | is_blank(b), -10).otherwise(score)


def with_blocks(paras: DataFrame, merge_mode: str = "soft-merge") -> DataFrame:
    """Adds score (against the next paragraph) and block_id. ``paras``: doc_id, para_idx, style,
    text, without blank paragraphs. One exchange by document serves every window here and after."""
    w = W.partitionBy("doc_id").orderBy("para_idx")
    scored = paras.withColumn("score", merge_score("text", F.lead("text").over(w), "style", F.lead("style").over(w)))
    joins = F.coalesce(F.col("score") >= MERGE_AT, F.lit(False)) if merge_mode in ("soft-merge", "hard-merge") else F.lit(False)
    scored = scored.withColumn("_joins", joins)
    starts = (~F.coalesce(F.lag("_joins").over(w), F.lit(False))).cast("int")
    return scored.withColumn("_starts", starts).withColumn("block_id", F.sum("_starts").over(w).cast("int") - 1).drop("_joins", "_starts")


def with_places(blocked: DataFrame) -> DataFrame:
    """Adds start and end of each paragraph in its block's text."""
    before = W.partitionBy("doc_id", "block_id").orderBy("para_idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return blocked.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def block_texts(blocked: DataFrame) -> DataFrame:
    """doc_id, block_id, first_para, n_paras, text: paragraphs joined by line breaks."""
    rows = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    return blocked.groupBy("doc_id", "block_id").agg(
        F.min("para_idx").alias("first_para"), F.count(F.lit(1)).alias("n_paras"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text")
    )


def drop_blank(paras: DataFrame) -> DataFrame:
    return paras.where(~is_blank("text"))
