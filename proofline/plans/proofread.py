"""The whole run: paragraphs, blocks, chunks, corrections, edits, decisions, applied text, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import edits as E
from ..functions.confidence import action, confidence
from ..functions.entities import protect, unprotect
from ..functions.segment import segment
from ..functions.text import nfc, normalize_all, word_count
from ..operators import blocks as B
from ..operators.apply import apply_edits, edits_to_paragraphs
from ..operators.correct import Corrector, correct
from ..operators.report import change_stats, report_changes, review_edits
from ..sources.workspace import discard, store


@dataclass
class Result:
    """paragraphs: doc_id, para_idx, text_out, runs_out, results; edits: every edit and what became of
    it; review, changes, stats: the reports; cache: rows to append."""

    paragraphs: DataFrame
    edits: DataFrame
    review: DataFrame
    changes: DataFrame
    stats: DataFrame
    cache: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Delete the tables that the results are computed from."""
        discard(*self.kept)


def proofread(paras: DataFrame, corrector: Corrector, config: Config = Config(), cache: DataFrame | None = None) -> Result:
    """``paras``: doc_id, para_idx, section, style, text, runs. Texts are composed (NFC) first, so that
    places in a block and in its paragraphs agree."""
    paras = B.drop_blank(paras.withColumn("text", nfc("text")))
    placed = store(B.with_places(B.with_blocks(paras, config.engine.merge_mode)), "placed")
    blocks = B.block_texts(placed)

    masked = blocks.withColumn("masked", protect(normalize_all("text")))
    chunks = masked.select("doc_id", "block_id", F.posexplode(segment("masked.text", config.max_words)).alias("pos", "c"))
    chunks = chunks.select("doc_id", "block_id", "pos", F.col("c.text").alias("text"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), word_count("c.text").alias("words"))
    done, new_cache = correct(chunks, corrector, cache, batch_size=config.batch_size)
    # Chunks leave no gaps but a blank rest: the corrected block is its corrected chunks in order.
    whole = done.groupBy("doc_id", "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "corrected"))), lambda c: c["corrected"]), "").alias("t"), F.max("end").alias("covered"))
    fixed = masked.join(whole, ["doc_id", "block_id"]).withColumn("t", F.concat("t", F.substr(F.col("masked.text"), F.col("covered") + 1)))
    fixed = fixed.withColumn("new", unprotect("t", "masked.entities"))
    fixed = store(fixed.select("doc_id", "block_id", "text", nfc("new").alias("new")), "fixed")

    changed = fixed.where("new != text")
    diffs = changed.select("doc_id", "block_id", F.posexplode(E.char_diff("text", "new")).alias("edit_no", "e")).where("e.type != 'equal'").select("doc_id", "block_id", "edit_no", "e.*")
    local = edits_to_paragraphs(diffs, placed)
    destructive = (F.col("n_paras") > 1) & F.lit(config.engine.merge_mode != "hard-merge")
    judged = local.withColumn("v", E.verdict("orig_text", "corr_text", config.safety)).withColumn("category", E.category("orig_text", "corr_text"))
    judged = judged.withColumn("reason", F.when(destructive, F.lit("destructive_merge")).otherwise(F.col("v.reason"))).withColumn("safe", ~destructive & F.col("v.is_safe"))
    if config.engine.apply_confidence_gate:
        score = confidence("orig_text", "corr_text", F.lit(1), F.array("category"))
        judged = judged.withColumn("safe", F.col("safe") & (action(score, F.lit(config.engine.mode), config.thresholds) == "apply"))
    key = ["doc_id", "para_idx"]
    judged = store(judged.join(placed.select(*key, F.col("section").alias("section_name")), key), "judged")

    part = F.struct(*[F.col(c) for c in ("edit_no", "type", "local_start", "local_end", "orig_text", "corr_text")])
    of_para = judged.where("safe").groupBy(*key).agg(F.collect_list(part).alias("edits"))
    ready = paras.select(*key, "text", "runs").join(of_para, key, "left")
    none = F.array().cast(of_para.schema["edits"].dataType)
    out = apply_edits(ready.withColumn("edits", F.coalesce("edits", none)).withColumn("runs", F.coalesce("runs", F.array().cast(paras.schema["runs"].dataType))), key, config.engine.highlight)
    out = out.withColumn("text_out", F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(F.transform("runs_out", lambda r: r["text"]), "")))

    outcome = out.select(*key, F.explode("results").alias("r")).select(*key, "r.*")
    all_ = judged.join(outcome, [*key, "edit_no"], "left")
    status = F.when(~F.col("safe"), "Rejected").when(F.col("applied"), "Applied").otherwise("Skipped")
    reason = F.when(status == "Rejected", F.col("reason")).when(status == "Applied", "safe_edit").otherwise(F.concat(F.lit("writer_"), F.coalesce("skip_reason", F.lit("unknown"))))
    all_ = all_.withColumn("status", status).withColumn("reason", reason).withColumn("edit_ratio", F.col("v.edit_ratio")).withColumn("length_delta", F.col("v.length_delta"))
    all_ = all_.withColumn("words", word_count("orig_text")).withColumn("markdown", E.markdown("type", "orig_text", "corr_text"))
    # The chunk an edit starts in, by block and place; for the count of changed chunks.
    all_ = all_.withColumn("chunk", F.concat_ws(":", "block_id", "para_idx"))
    stats = change_stats(blocks, chunks, all_)
    return Result(out.select(*key, "text_out", "runs_out", "results"), all_, review_edits(all_), report_changes(all_), stats, new_cache, (placed, fixed, judged, new_cache))
