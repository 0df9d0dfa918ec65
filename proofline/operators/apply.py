"""Edits onto paragraphs and format runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import running, scan
from ..functions.text import Text, col, is_blank
from ..schemas import RUN
from .intervals import overlapping

RED = "FF0000"
#: Characters of a stretch in which intervals meet.
STRETCH = 1024


def edits_to_paragraphs(edits: DataFrame, placed: DataFrame) -> DataFrame:
    """Each edit with the first paragraph it overlaps, how many it overlaps, and its place there.

    ``edits``: doc_id, block_id, edit_no, orig_start, orig_end, ...; ``placed``: doc_id, block_id,
    para_idx, start, end. Edits that overlap no paragraph vanish."""
    p = placed.select("doc_id", "block_id", "para_idx", "start", "end")
    met = overlapping(edits, p, ["doc_id", "block_id"], ("orig_start", "orig_end"), ("start", "end"), STRETCH)
    own = [c for c in edits.columns if c not in ("doc_id", "block_id", "edit_no")]
    first = F.min_by(F.struct("para_idx", "start", "end"), "para_idx")
    found = met.groupBy("doc_id", "block_id", "edit_no").agg(first.alias("p"), F.count(F.lit(1)).alias("n_paras"), *[F.first(c).alias(c) for c in own])
    size = F.col("p.end") - F.col("p.start")
    return found.select(
        "doc_id", "block_id", "edit_no", *own, "n_paras", F.col("p.para_idx").alias("para_idx"),
        F.greatest(F.lit(0), F.col("orig_start") - F.col("p.start")).alias("local_start"),
        F.least(size, F.col("orig_end") - F.col("p.start")).alias("local_end"),
    )


def with_run_places(runs: Text) -> Column:
    """Runs as (run, start, end) by running length."""
    starts = running(F.transform(col(runs), lambda r: F.length(r["text"])))
    return F.zip_with(col(runs), starts, lambda r, at: F.struct(r.alias("run"), at.alias("start"), (at + F.length(r["text"])).alias("end")))


def edits_to_runs(edits: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """The part of each edit that lies in each run: ``edits`` (keys, edit_no, local_start, local_end)
    against ``runs`` (keys, run_idx, run_start, run_end): run_idx, off_start, off_end."""
    met = overlapping(edits.where("local_start < local_end"), runs, keys, ("local_start", "local_end"), ("run_start", "run_end"), STRETCH)
    return met.withColumn("off_start", F.greatest(F.lit(0), F.col("local_start") - F.col("run_start"))).withColumn(
        "off_end", F.least(F.col("run_end") - F.col("run_start"), F.col("local_end") - F.col("run_start"))
    )


def guarded(edits: Text) -> Column:
    """Edits (structs with local_start, local_end, edit_no, n_runs) from the last to the first, each with
    ``clear``: whether it ends before all applied ones start. What is skipped doesn't count, so
    this is a fold and no window."""
    ordered = F.array_sort(F.transform(col(edits), lambda e: F.struct((-e["local_start"]).alias("from_end"), e["edit_no"].alias("edit_no"), e.alias("edit"))))
    clear = lambda at, x: x["edit"]["local_end"] <= at
    step = lambda at, x: F.when(clear(at, x) & (x["edit"]["n_runs"] == 1), x["edit"]["local_start"]).otherwise(at)
    flags = scan(ordered, F.lit(2**31 - 1), step, clear, "boolean")
    return F.zip_with(ordered, flags, lambda x, f: F.struct(x["edit"].alias("edit"), f.alias("clear")))


def _by(keys: list[str], a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both, dealt by ``keys`` here. A union of tables that are dealt by the same keys counts as dealt
    by them, but adaptive execution may join small partitions of one and not of the other: a paragraph's rows are
    then in two tasks, and each makes a result of its own."""
    return a.unionByName(b).repartition(*keys)


def _met(runs: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """``edits`` (keys, e) with n_runs, the runs each overlaps, and ri, the place of the first of them.

    Runs that end up to an edit's start are all before the first it overlaps, and those that start
    before its end include them. Both are counted by one window over the places where runs and edits
    start and end, whose order puts a run's end before an edit's start, and an edit's end before a run's start."""
    mark = lambda pos, kind: F.struct(pos.cast("int").alias("pos"), F.lit(kind).alias("kind"))
    of_runs = runs.select(*keys, F.explode(F.array(mark(F.col("end"), 0), mark(F.col("start"), 3))).alias("m"), F.lit(None).cast(edits.schema["e"].dataType).alias("e"))
    of_edits = edits.select(*keys, F.explode(F.array(mark(F.col("e.local_start"), 1), mark(F.col("e.local_end"), 2))).alias("m"), "e")
    so_far = W.partitionBy(*keys).orderBy("m.pos", "m.kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = _by(keys, of_runs, of_edits).select(*keys, "m", "e", *[F.count_if(F.col("m.kind") == k).over(so_far).cast("int").alias(c) for k, c in ((0, "ended"), (3, "begun"))])
    at = lambda kind, c: F.max(F.when(F.col("m.kind") == kind, F.col(c)))
    found = counted.where("e is not null").groupBy(*keys, F.col("e.edit_no").alias("edit_no")).agg(F.first("e").alias("e"), at(1, "ended").alias("ri"), at(2, "begun").alias("begun"))
    wide = (F.col("e.type") != "equal") & (F.col("e.local_start") < F.col("e.local_end"))
    return found.select(*keys, "e", "ri", F.when(wide, F.col("begun") - F.col("ri")).otherwise(0).alias("n_runs"))


def apply_edits(paras: DataFrame, keys: list[str], highlight: bool = True) -> DataFrame:
    """``paras``: keys (a paragraph's own), runs, edits (array of structs with edit_no, a paragraph's own,
    type, local_start, local_end, orig_text, corr_text). Adds ``results`` (edit_no, applied, skip_reason,
    run_idx) from the last edit to the first, and ``runs_out``.

    An edit inside one run splits it in three: before (kept even when empty), corrected, after; both
    new runs keep the format. Edits over several runs, over none, or over an applied edit are skipped.
    Runs and edits are rows that meet by windows over a paragraph; only the guard folds an array. Paragraphs
    without edits keep their runs as they are and take no part in that."""
    touched = paras.where(F.size("edits") > 0)
    n = F.length("run.text")
    upto = W.partitionBy(*keys).orderBy("ri").rowsBetween(W.unboundedPreceding, W.currentRow)
    # An inner explode would copy the array's expression into a filter below, and evaluate it once more.
    runs = touched.select(*keys, F.posexplode_outer("runs").alias("ri", "run")).where("run is not null").withColumn("end", F.sum(n).over(upto).cast("int")).withColumn("start", F.col("end") - n)
    known = _met(runs, touched.select(*keys, F.explode_outer("edits").alias("e")).where("e is not null"), keys)
    edit = F.struct("ri", "n_runs", *[F.col(f"e.{c}").alias(c) for c in ("edit_no", "type", "local_start", "local_end", "corr_text")])
    guard = known.groupBy(*keys).agg(F.collect_list(edit).alias("edits")).select(*keys, F.posexplode(guarded("edits")).alias("nth", "x"))
    reason = (
        F.when(F.col("x.edit.type") == "equal", "type_equal").when(~F.col("x.clear"), "overlap").when(F.col("x.edit.n_runs") == 0, "no_mapping_found").when(F.col("x.edit.n_runs") > 1, "multi_run_edit_not_supported_yet")
    )
    guard = guard.select(*keys, "nth", "x.edit.*", reason.alias("skip_reason"))

    # A run's row, then its applied edits: what each leaves of the run up to the next.
    empty = lambda c: F.lit(None).cast(c)
    own = runs.select(*keys, "ri", F.lit(-1).alias("at"), "run", "start", F.struct(empty("int").alias("edit_no"), empty("int").alias("nth"), empty("string").alias("skip_reason"), empty("int").alias("local_end"), empty("string").alias("corr_text")).alias("e"))
    of_edits = guard.select(*keys, F.when(F.col("skip_reason").isNull(), F.col("ri")).otherwise(-1).alias("ri"), F.col("local_start").alias("at"), empty(RUN).alias("run"), empty("int").alias("start"), F.struct("edit_no", "nth", "skip_reason", "local_end", "corr_text").alias("e"))
    both = _by(keys, own, of_edits)
    in_run = W.partitionBy(*keys, "ri").orderBy("at")
    both = both.select(*keys, "ri", "at", "e", F.first("run").over(in_run).alias("run"), F.first("start").over(in_run).alias("start"), F.lead("at").over(in_run).alias("next"), (F.col("at") == -1).alias("is_run"))
    size = F.length("run.text")
    place = lambda p: F.least(F.greatest(p - F.col("start"), F.lit(0)), size)
    to = F.when(F.col("next").isNull(), size).otherwise(place(F.col("next")))
    part = lambda t, c: F.struct(*[(t if f == "text" else c if f == "color" else F.col(f"run.{f}")).alias(f) for f in ("run_idx", "text", "bold", "italic", "underline", "font", "size", "color", "highlight", "style")])
    sub = lambda a, b: F.substr(F.col("run.text"), a + 1, b - a)
    red = F.when(F.lit(highlight) & ~is_blank("e.corr_text"), F.lit(RED)).otherwise(F.col("run.color"))
    new = F.filter(F.array(part(F.col("e.corr_text"), red), part(sub(place(F.col("e.local_end")), to), F.col("run.color"))), lambda p: p["text"] != "")
    pieces = F.when(F.col("is_run"), F.array(part(sub(F.lit(0), to), F.col("run.color")))).when(F.col("ri") >= 0, new)
    result = F.struct(F.col("e.nth"), F.col("e.edit_no").alias("edit_no"), F.col("e.skip_reason").isNull().alias("applied"), F.col("e.skip_reason").alias("skip_reason"), F.col("run.run_idx").alias("run_idx"))
    rows = both.select(*keys, F.when(F.col("ri") >= 0, F.struct("ri", "at", pieces.alias("pieces"))).alias("p"), F.when(~F.col("is_run"), result).alias("r"))
    made = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"), F.array_sort(F.collect_list("r")).alias("r"))
    slim = F.transform("r", lambda x: F.struct(x["edit_no"].alias("edit_no"), x["applied"].alias("applied"), x["skip_reason"].alias("skip_reason"), x["run_idx"].alias("run_idx")))
    made = made.select(*keys, slim.alias("results"), F.flatten(F.transform("p", lambda x: x["pieces"])).alias("runs_out"))
    out = paras.join(made, keys, "left")
    none = lambda c: F.array().cast(made.schema[c].dataType)
    return out.withColumn("results", F.coalesce("results", none("results"))).withColumn("runs_out", F.coalesce("runs_out", F.col("runs"), none("runs_out")))
