"""Line dedup by a log-template tree of fixed depth (operator 10).

A line goes down the tree by its number of tokens and then by its leading tokens; tokens that hold
digits, an @ or a slash are variable fields from the start. Within a leaf, a token that few of the
leaf's lines have in its place is a variable field too and is generalised; a line's template is what
is left. Templates that recur across documents are dropped, all their lines with them.

The tree is not grown line by line, which would depend on their order and on one machine: leaves,
tokens by place and templates are counted with aggregates that combine before their shuffle. So a leaf
that a third of all lines fall in is counted like any other, and no leaf's lines are gathered.

*Recurring.* Copies of a document repeat all its lines without any of them being boilerplate (removing
such documents is for other operators). Documents are therefore told apart by the smallest shingle
hash of their other text, which copies and most near copies share: a template recurs if documents
with at least MIN_DOCS different values hold it, and they are at least SPREAD of the different texts
that do (exact copies count once).

*Other text.* The other lines may be boilerplate too, and more of it than the document's own. So a
document is told apart by its least widely held lines, as many classes of them as it takes to have OWN
words, and only lines of wider classes are judged by these; others by all other lines. How widely a
line is held is the number of different texts that hold one of its anchors, the smallest hashes
of its runs of RUN tokens: an edited line of a near copy mostly shares one with the line it was.

*Passages.* A line of LONG tokens or more doesn't recur by chance: LONG_DOCS documents are enough, where the rule above
leaves it. It must be the same but for its variable fields, and its documents are held to more: what the rule
above leaves of their other text has as many words as the line, and agrees with that of no other in any
of HASHES smallest hashes; of those that agree, one counts. SPREAD holds as above.

Results for odd input: null text has no lines; blank lines stay; a document that loses all lines has
empty text; rows with a null or repeated doc_id are told apart by their text; an empty table gives an
empty result; other columns are not looked at, and the stage keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, words

LEADING = 3
MIN_DOCS = 10
#: Tokens of a line that few documents are enough for, and how few.
LONG, LONG_DOCS = 20, 3
SPREAD = 0.3
CONSTANT = 0.7
#: Words that tell a document apart; factor between classes of widely held lines.
OWN, CLASS = 16, 4
ANCHORS, RUN = 4, 4
FIELD = "<*>"

_rng = np.random.default_rng(11)
_W = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VARIABLE = np.uint64(0x5DEECE66D)
_STEP = np.uint64(0xD1342543DE82EF95)
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(0x30, 0x3A), 0x40, 0x2F]] = True
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_ANCHOR = [f"anchor{k}" for k in range(ANCHORS)]
HASHES = ["low", *_ANCHOR]


class Lines:
    """The non-blank lines of a group of texts, with their place in the tree; with ``told``, also with what
    tells them and their documents apart."""

    def __init__(self, g: words.Group, told: bool = True):
        raw = g.raw
        self.starts, self.ends, doc = g.cut(words.WHITE, raw)
        breaks = np.concatenate(([0], np.cumsum(raw == 10)))
        marks = np.concatenate(([0], np.cumsum(_MARK[raw])))
        self.variable = marks[self.ends] > marks[self.starts]
        h = words.span_hashes(raw, self.starts, self.ends)
        line = breaks[self.starts] + doc
        self.first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, dtype=np.int64)
        self.n = len(self.first)
        if not self.n:
            return
        self.size = np.diff(np.concatenate((self.first, [len(line)])))
        self.doc = doc[self.first]
        self.number = breaks[self.starts[self.first]] - breaks[g.offsets[self.doc]]
        place = np.arange(len(line)) - np.repeat(self.first, self.size)
        masked = np.where(self.variable, _VARIABLE, h)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(self.size.max()), _STEP))), dtype=np.uint64)[place]
        self.hash = words.mix(np.add.reduceat(masked * power, self.first) + self.size.astype(np.uint64))
        head = np.where(place < LEADING, masked * _W[np.minimum(place, LEADING)], np.uint64(0))
        self.leaf = words.mix(np.add.reduceat(head, self.first) + self.size.astype(np.uint64) * _W[5])
        if not told:
            return
        # The smallest shingle hash of each line; of a short line, its hash.
        low = words.mix(np.add.reduceat(h * power, self.first) + np.uint64(1))
        if len(h) > 4:
            s = words.mix(h[:-4] * _W[0] + h[1:-3] * _W[1] + h[2:-2] * _W[2] + h[3:-1] * _W[3] + h[4:] * _W[4])
            s = np.concatenate((s, np.full(4, _LAST)))
            room = np.repeat(self.size, self.size) - place
            low = np.where(self.size > 4, np.minimum.reduceat(np.where(room > 4, s, _LAST), self.first), low)
        self.low = low
        self.anchors = [self.hash] * ANCHORS
        if len(h) >= RUN:
            s = np.zeros(len(h) - RUN + 1, dtype=np.uint64)
            for j in range(RUN):
                s += masked[j : j + len(s)] * _W[j]
            inside = (np.repeat(self.size, self.size) - place)[: len(s)] >= RUN
            for k in range(ANCHORS):
                v = np.concatenate((np.where(inside, words.mix(s ^ _W[4 + k]), _LAST), np.full(RUN - 1, _LAST)))
                self.anchors[k] = np.where(self.size >= RUN, np.minimum.reduceat(v, self.first), self.hash)
        at = np.flatnonzero(np.concatenate(([True], self.doc[1:] != self.doc[:-1])))
        of = np.repeat(np.arange(len(at)), np.diff(np.concatenate((at, [self.n]))))
        least = np.minimum.reduceat(low, at)
        holder = np.full(len(at), self.n)
        np.minimum.at(holder, of, np.where(low == least[of], np.arange(self.n), self.n))
        other = self.hash != self.hash[holder][of]
        second = np.minimum.reduceat(np.where(other, low, _LAST), at)
        self.rest = np.where(other, least[of], second[of])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for g in words.groups(b.column("text")):
            x = Lines(g)
            if x.n:
                row = pa.array(g.first + x.doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(row), b.column("key").take(row), pa.array(x.number.astype(np.int32)), pa.array(x.size.astype(np.int32)), *[pa.array(v.view(np.int64)) for v in (x.leaf, x.hash, x.rest, x.low, *x.anchors)]],
                    names=["doc_id", "key", "line_no", "size", "leaf", "line", "rest", "low", *_ANCHOR],
                )


def _masked(bits):
    """The masked text of lines whose leaf may be frequent, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in words.groups(b.column("text")):
                x = Lines(g, told=False)
                if not x.n:
                    continue
                hit = np.flatnonzero(common.in_filter(bits.value, (x.leaf & np.uint64(common.FILTER_BITS - 1)).astype(np.int64) + 1))
                _, once = np.unique(x.hash[hit] ^ words.mix(x.leaf[hit]), return_index=True)
                hit = hit[once]
                raw, texts = g.raw.tobytes(), []
                for i in hit:
                    tokens = range(x.first[i], x.first[i] + x.size[i])
                    texts.append(b" ".join(FIELD.encode() if x.variable[t] else raw[x.starts[t] : x.ends[t]] for t in tokens).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(x.leaf[hit].view(np.int64)), pa.array(x.hash[hit].view(np.int64)), pa.array(texts, pa.string())], names=["leaf", "line", "masked"])

    return run


def _told_apart(lines: DataFrame, kept: DataFrame, min_docs: int) -> DataFrame:
    """``kept`` with ``rest`` taken from the least widely held lines of the text where the line is
    held more widely than these."""
    once = common.store(lines.select("key", "line", "size", "low", *_ANCHOR).dropDuplicates(["key", "line"]), "once")
    anchor = F.explode(F.array_distinct(F.array(*_ANCHOR))).alias("anchor")
    held = common.store(once.select("key", anchor).distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("texts")).where(f"texts >= {min_docs}"), "anchors")
    of_line = once.select("line", *_ANCHOR).dropDuplicates(["line"]).select("line", anchor)
    degree = (F.floor(F.log(F.col("texts") / min_docs) / F.log(F.lit(float(CLASS)))) + 1).cast("int")
    wide = common.store(of_line.join(held, "anchor").groupBy("line").agg(F.max("texts").alias("texts")).select("line", degree.alias("class")), "wide")
    classed = once.join(wide, "line", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    by_class = classed.groupBy("key", "class").agg(F.sum("size").alias("size"), F.min("low").alias("low"))
    upto = W.partitionBy("key").orderBy("class").rowsBetween(W.unboundedPreceding, W.currentRow)
    enough = by_class.select("key", "class", F.sum("size").over(upto).alias("size"), F.min("low").over(upto).alias("low")).where(f"size >= {OWN}")
    told = common.store(enough.groupBy("key").agg(F.min(F.struct("class", "low")).alias("own")).select("key", F.col("own.class").alias("level"), F.col("own.low").alias("own")), "told")
    rest = F.when(F.col("class") > F.col("level"), F.col("own")).otherwise(F.col("rest"))
    out = common.store(kept.join(wide, "line", "left").join(told, "key", "left").select("doc_id", "key", "line_no", "leaf", "line", rest.alias("rest")), "candidates")
    common.discard(once, held, wide, told)
    return out


def _passages(text: DataFrame, lines: DataFrame, found: DataFrame, spread: float) -> DataFrame | None:
    """Of lines of LONG tokens or more that are not ``found``, those that recur: as ``recurring_lines``, a
    stored table; None where no such line is in LONG_DOCS texts."""
    spark = text.sparkSession
    place = found.select("key", "line_no").distinct()
    long = lines.where(f"size >= {LONG}").select("doc_id", "key", "line_no", "size", "leaf", "line")
    several = long.groupBy("leaf", "line").agg(F.countDistinct("key").alias("texts")).where(f"texts >= {LONG_DOCS}").select("leaf", "line")
    cand = common.store(long.join(several, ["leaf", "line"]).join(place, ["key", "line_no"], "left_anti"), "long_lines")
    if cand.isEmpty():
        common.discard(cand)
        return None
    hit = common.slot_udf(spark, common.id_filter(cand, slot=common.hash_slot("key")))
    other = lines.select("key", "line_no", "line", "size", *HASHES).where(hit(common.hash_slot("key"))).join(place, ["key", "line_no"], "left_anti")
    other = common.store(other.drop("line_no").dropDuplicates(["key", "line"]), "other_lines")
    # The least of all lines but one: the least, or the second where that one has the least.
    least = other.groupBy("key").agg(F.sum("size").alias("words"), *[F.min(F.struct(h, "line")).alias(f"least_{h}") for h in HASHES])
    second = other.join(least, "key").groupBy("key").agg(F.first("words").alias("words"), *[F.first(f"least_{h}").alias(f"least_{h}") for h in HASHES], *[F.min(F.when(F.col("line") != F.col(f"least_{h}.line"), F.col(h))).alias(f"second_{h}") for h in HASHES])
    of_key = common.store(second, "least")
    rest = F.array(*[F.when(F.col("line") == F.col(f"least_{h}.line"), F.col(f"second_{h}")).otherwise(F.col(f"least_{h}")[h]) for h in HASHES])
    holders = cand.select("leaf", "line", "key", "size").distinct().join(of_key, "key").select("leaf", "line", "key", (F.col("words") >= 2 * F.col("size")).alias("told"), rest.alias("rest"))
    holders = common.store(holders, "holders")
    agree = holders.where("told").select("leaf", "line", "key", F.posexplode("rest").alias("hash", "value")).groupBy("leaf", "line", "hash", "value").agg(F.min("key").alias("lead"))
    apart = agree.groupBy("leaf", "line", "lead").agg(F.count(F.lit(1)).alias("n")).where(f"n = {len(HASHES)}").groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    every = holders.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("all"))
    known = apart.where(f"n_docs >= {LONG_DOCS}").join(every, ["leaf", "line"]).where(f"n_docs >= {spread} * all").select("leaf", "line", "n_docs")
    known = common.store(known, "known_long")
    at = cand.join(known, ["leaf", "line"])
    one = common.store(at.groupBy("leaf", "line").agg(F.min(F.struct("key", "line_no")).alias("at")).select("leaf", "line", "at.key", "at.line_no"), "shown")
    hit = common.slot_udf(spark, common.id_filter(one, slot=common.hash_slot("key")))
    shown = text.where(hit(common.hash_slot("key"))).join(one, "key").select("leaf", "line", F.get(F.split("text", "\n", -1), F.col("line_no")).alias("text"))
    tokens = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda t: t != "")
    masked = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("[0-9@/]"), F.lit(FIELD)).otherwise(t)), " ")
    named = shown.select("leaf", "line", masked.alias("template")).groupBy("leaf", "line").agg(F.min("template").alias("template"))
    out = common.store(at.join(named, ["leaf", "line"]).select("doc_id", "key", "line_no", "template", "n_docs"), "recurring_long")
    common.discard(cand, other, of_key, holders, known, one)
    return out


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, spread: float = SPREAD, constant: float = CONSTANT) -> DataFrame:
    """Lines of ``docs`` (doc_id, text) whose template recurs: doc_id, key (of the text), line_no
    (from 0), template, n_docs (different documents that hold it), as a stored table."""
    with common.text_batches(docs.sparkSession):
        return _recurring_lines(docs, min_docs, spread, constant)


def _recurring_lines(docs: DataFrame, min_docs: int, spread: float, constant: float) -> DataFrame:
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").where("text is not null")
    lines = common.store(text.mapInArrow(_lines, ", ".join(["doc_id long, key long, line_no int, size int, leaf long, line long, rest long, low long", *[f"{a} long" for a in _ANCHOR]])), "lines")
    frequent = common.store(lines.select("leaf", "key", "line").distinct().groupBy("leaf").count().where(f"count >= {min_docs}").select("leaf"), "leaves")
    kept = _told_apart(lines, lines.join(frequent, "leaf"), min_docs)
    bits = spark.sparkContext.broadcast(common.id_filter(frequent, slot=common.hash_slot("leaf")))
    weight = kept.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("w"))
    shown = text.select("text").mapInArrow(_masked(bits), "leaf long, line long, masked string").groupBy("leaf", "line").agg(F.min("masked").alias("masked"))
    distinct = common.store(weight.join(shown, ["leaf", "line"]).select("leaf", "line", "w", F.split("masked", " ").alias("tokens")), "distinct")
    # The leading tokens are the leaf's, and fields stay fields: only the others are counted.
    token = distinct.select("leaf", "line", "w", F.posexplode("tokens").alias("place", "token")).where((F.col("place") >= LEADING) & (F.col("token") != FIELD))
    fixed = token.groupBy("leaf", "place", "token").agg(F.sum("w").alias("lines")).where(f"lines >= {min_docs}").select("leaf", "place", "token")
    loose = token.join(fixed, ["leaf", "place", "token"], "left_anti").groupBy("leaf", "line").agg(F.collect_set("place").alias("loose"))
    shape = F.transform("tokens", lambda t, i: F.when(F.array_contains("loose", i), F.lit(FIELD)).otherwise(t))
    held = distinct.join(loose, ["leaf", "line"], "left").withColumn("loose", F.coalesce("loose", F.array().cast("array<int>")))
    made = held.where(F.size("loose") <= (1 - constant) * F.size("tokens")).select("leaf", "line", F.array_join(shape, " ").alias("template"))
    # Both sides of the next two joins are tables: a small one is broadcast by its true size, and the
    # lines of a frequent template are split where not.
    made = common.store(made.select("leaf", "line", "template", F.xxhash64("leaf", "template").alias("id")), "made")
    of_line = kept.join(made, ["leaf", "line"])
    of_line = common.store(of_line.select("doc_id", "key", "line_no", "rest", "template", "id"), "templated")
    in_docs = of_line.groupBy("id", "rest").agg(F.countDistinct("key").alias("docs"))
    known = common.store(in_docs.groupBy("id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("docs").alias("all")).where(f"n_docs >= {min_docs} and n_docs >= {spread} * all").select("id", "n_docs"), "known")
    out = common.store(of_line.join(known, "id").select("doc_id", "key", "line_no", "template", "n_docs"), "recurring")
    bits.destroy()
    common.discard(frequent, kept, distinct, made, of_line, known)
    more = _passages(text, lines, out, spread)
    common.discard(lines)
    return out if more is None else out.unionByName(more)


def drop_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the lines that ``recurring_lines`` found; n_chars, where there is one, is
    counted again. Only documents that a fixed-size filter suspects to lose lines are shuffled."""
    spark = docs.sparkSession
    key = F.xxhash64("text")
    bits = common.id_filter(found, slot=common.hash_slot("key"))
    if not bits.any():
        return docs
    hit = common.slot_udf(spark, bits)
    marked = docs.withColumn("_proofline_key", key)
    marked = marked.withColumn("_proofline_hit", F.col("text").isNotNull() & hit(common.hash_slot("_proofline_key")))
    gone = found.groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("_proofline_gone")).select(F.col("doc_id").alias("_proofline_d"), F.col("key").alias("_proofline_k"), "_proofline_gone")
    rest = marked.where("_proofline_hit").join(gone, (F.col("_proofline_key") == F.col("_proofline_k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_proofline_d")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_proofline_gone", i)), "\n")
    rest = rest.withColumn("text", F.when(F.col("_proofline_gone").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.col("_proofline_gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return marked.where(~F.col("_proofline_hit")).select(*docs.columns).unionByName(rest.select(*docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: recurring lines leave the texts of their documents; every document stays."""
    return drop_lines(docs, recurring_lines(docs))


def op10_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "line_no", "template", "n_docs")
