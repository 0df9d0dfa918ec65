"""Personal data, and the terms that give it away (operator 5), in DataFrame operations only.

*Base.* Four kinds of protected entity are found by pattern, with their places in code points. Spark
gives the matches and the text between them; running sums of their lengths give the places. The
patterns are the stated ones made linear: they start at the start of a run or where the last match
ended, and repeat possessively, so neither a long run nor a long match costs more than its length.

*Disclosure.* A term near an entity may reveal it although the entity itself is removed. From the
corpus: n(e) texts hold entity e, n(t) hold term t, n(e,t) have t within WINDOW characters of e, out
of N; exact copies are one text. The chance of e given t is P = (n(e,t) + PRIOR n(e) / N) / (n(t) + PRIOR),
and the information that t gives about e, relative to all there is about e, is

    log2(P N / n(e)) / log2(N / n(e)),

below 1, and the lower the fewer texts show it. Pairs seen in at least ``support`` texts count: one text
can't tell a term from any rare word. Terms that reach ``generalise`` are replaced by their class (a
name or a word, and its initial), those that reach ``remove`` are removed, wherever they stand in a
document that holds the entity. The candidate terms' counts take in every text. Windows are linear in
the entities, whatever a document holds.

Results for odd input: null text is empty text; rows with null or repeated doc_ids keep their rows; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 120
SUPPORT, PRIOR = 2, 0.5
GENERALISE, REMOVE = 0.85, 0.95
_BLOCK = 256
#: Rows of a table that joins may broadcast: thin rows, so some ten MB.
SMALL = 1 << 18

#: Kinds in their order, and the patterns the results are stated in.
KINDS = ("email", "ip", "card", "phone", "term")
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TERM = r"(?<=[^\p{L}])[\p{L}]{3,}(?=[^\p{L}])"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap condition that texts with a match meet."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "ip":
        return F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    return F.contains(text, F.lit("+"))


def _longs(*v: Column) -> Column:
    return F.array(*v).cast("array<bigint>")


def _fold(values: Column, first: Column) -> Column:
    return F.aggregate(values, _longs(), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), first) + x)))


def running(values: Column) -> Column:
    """Running sums of an array of longs, by blocks: an array grows by copying, so one fold over
    a text with very many matches would cost the square of their number."""
    zero = F.lit(0).cast("bigint")
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(values, s, _BLOCK), zero, lambda a, x: a + x))
    done = F.concat(_longs(zero), _fold(sums, zero))
    return F.flatten(F.transform(starts, lambda s, i: _fold(F.slice(values, s, _BLOCK), F.get(done, i))))


def _places(gaps: str, found: str) -> Column:
    """Where each match starts: the gaps up to it and the matches before it."""
    n = F.size(found)
    steps = F.transform(F.slice(gaps, F.lit(1), n), lambda g, i: (F.length(g) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("bigint"))
    return running(steps)


def _matches(df: DataFrame, text: Column, pattern: str | Column, when: Column, out: str) -> DataFrame:
    """Adds ``out``: an array of (start, value) of all matches, ascending."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_found", F.when(when, F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("_at", _places("_gaps", "_found"))
    return df.withColumn(out, F.zip_with("_at", "_found", lambda a, m: F.struct(a.alias("start"), m.alias("value")))).drop("_found", "_gaps", "_at")


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, key (of doc_id and text), copy (of the text), spans: array of (start, kind, end, value, left, right) by
    start and kind, kind a place in KINDS, left and right the text around the span."""
    text = F.col("text")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    df = df.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("copy", F.xxhash64("text"))
    for i, kind in enumerate(KINDS[:4]):
        df = _matches(df, text, _PATTERN[kind], _may_hold(kind, text), f"m{i}")
    span = lambda i: lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"))
    valid = lambda kind: lambda m: _valid(kind, m["value"])
    parts = [F.transform(F.filter(f"m{i}", valid(kind)), span(i)) for i, kind in enumerate(KINDS[:4])]
    df = df.withColumn("s", F.array_sort(F.concat(*parts))).drop(*[f"m{i}" for i in range(4)])

    def around(s: Column) -> Column:
        start, end = s["start"].cast("int"), s["end"].cast("int")
        lo = F.greatest(F.lit(0), start - WINDOW)
        left = F.concat(F.when(lo == 0, F.lit(" ")).otherwise(F.lit("")), F.substr(F.col("text"), lo + 1, start - lo), F.lit(" "))
        right = F.concat(F.lit(" "), F.substr(F.col("text"), end + 1, F.lit(WINDOW)), F.when(end + WINDOW >= F.length("text"), F.lit(" ")).otherwise(F.lit("")))
        at = F.when(lo == 0, F.lit(-1)).otherwise(lo).cast("bigint")
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), left.alias("left"), at.alias("left_at"), right.alias("right"), (s["end"] - 1).alias("right_at"))

    return df.select("doc_id", "key", "copy", F.transform("s", around).alias("spans"))


def contexts(found: DataFrame) -> DataFrame:
    """A row per entity and term near it: doc_id, key, copy, entity, term, start, end. Words that are
    part of an entity are left out."""
    one = found.where(F.size("spans") > 0).select("doc_id", "key", "copy", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("all"), F.explode("spans").alias("s"))
    one = one.select("doc_id", "key", "copy", "all", F.concat_ws(":", F.col("s.kind").cast("string"), F.lower("s.value")).alias("entity"), F.explode(F.array(F.struct(F.col("s.left").alias("t"), F.col("s.left_at").alias("at")), F.struct(F.col("s.right").alias("t"), F.col("s.right_at").alias("at")))).alias("w"))
    one = _matches(one.withColumn("t", F.col("w.t")), F.col("t"), _TERM, F.lit(True), "words")
    one = one.select("doc_id", "key", "copy", "all", "entity", F.col("w.at").alias("at"), F.explode("words").alias("m"))
    one = one.select("doc_id", "key", "copy", "all", "entity", F.lower("m.value").alias("term"), (F.col("at") + F.col("m.start")).alias("start"), (F.col("at") + F.col("m.start") + F.length("m.value")).alias("end"))
    inside = F.exists("all", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return one.where(~inside).drop("all")


def _small(df: DataFrame, n: int) -> DataFrame:
    """A stored table of ``n`` rows as one side of a join: broadcast where it has few enough."""
    return F.broadcast(df) if n <= SMALL else df


def text_counts(docs: DataFrame, terms: DataFrame, copies: DataFrame) -> DataFrame:
    """term, n_t: the different texts that hold each of ``terms``. ``copies``: copy, rows. Every row
    of a text that occurs c times counts 1 / c, so counts combine before their shuffle."""
    dup = common.store(copies.where("rows > 1").select("copy", (1 / F.col("rows")).alias("part")), "dup")
    n = terms.count()
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    rows = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"), "text").join(_small(dup, dup.count()), "copy", "left")
    each = rows.select(F.coalesce("part", F.lit(1.0)).alias("part"), F.explode(words).alias("term"))
    count = lambda df: df.groupBy("term").agg(F.sum("part").alias("n_t"))
    counted = count(each.join(F.broadcast(terms), "term")) if n <= SMALL else count(each).join(terms, "term")
    out = common.store(counted.select("term", F.round("n_t").cast("long").alias("n_t")), "text_counts")
    common.discard(dup)
    return out


def disclosures(docs: DataFrame, near: DataFrame, support: int, least: float) -> DataFrame:
    """Pairs (entity, term) whose disclosure reaches ``least``: entity, term, share. Counts reach the
    driver."""
    copies = common.store(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy")).groupBy("copy").agg(F.count(F.lit(1)).alias("rows")), "copies")
    n = copies.count()
    of_pair = near.select("entity", "term", "copy").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(f"n_et >= {support}")
    pairs = common.store(of_pair, "pairs")
    of_entity = near.select("entity", "copy").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    of_term = text_counts(docs, common.store(pairs.select("term").distinct(), "terms"), copies)
    met = pairs.join(of_entity, "entity").join(of_term, "term")
    chance = (F.col("n_et") + PRIOR * F.col("n_e") / n) / (F.greatest("n_t", "n_et") + PRIOR)
    share = 1 + F.log2(chance) / F.log2(F.lit(float(n)) / F.col("n_e"))
    return met.where(F.col("n_e") < n).select("entity", "term", share.alias("share")).where(F.col("share") >= least)


def occurrences(docs: DataFrame, found: DataFrame, telling: DataFrame) -> DataFrame:
    """Where telling terms stand in the documents that hold their entities: doc_id, key, start, end,
    share. Words that are part of an entity are left out. A document is searched once for all its
    terms, and only texts that may hold an entity are shuffled."""
    each = found.where(F.size("spans") > 0).select("doc_id", "key", F.explode("spans").alias("s"))
    entity = F.concat_ws(":", F.col("s.kind").cast("string"), F.lower("s.value"))
    held = each.select("doc_id", "key", entity.alias("entity")).distinct().join(telling, "entity")
    wanted = common.store(held.groupBy("doc_id", "key", "term").agg(F.max("share").alias("share")), "wanted")
    terms = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(F.collect_set("term")), "|"), F.lit(r")(?!\p{L})")).alias("terms")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("all")
    holders = wanted.groupBy("key").agg(terms).join(found.select("key", spans), "key").dropDuplicates(["key"])
    holders = common.store(holders, "holders")
    may = F.lit(False)
    for kind in KINDS[:4]:
        may = may | _may_hold(kind, F.col("text"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("key")
    texts = docs.where(may).select(key, "text").join(holders, "key").dropDuplicates(["key"])
    one = _matches(texts, F.col("text"), F.col("terms"), F.lit(True), "words").select("key", "all", F.explode("words").alias("m"))
    one = one.select("key", "all", F.lower("m.value").alias("term"), F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.value")).alias("end"))
    inside = F.exists("all", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    out = common.store(one.where(~inside).select("key", "term", "start", "end"), "occurrences")
    out = out.join(wanted, ["key", "term"]).select("doc_id", "key", "start", "end", "share")
    common.discard(holders)
    return out


def find_personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, key, spans: array of (start, kind, end, action) by start and kind, as a stored table. ``action`` is
    'remove' for entities; 'remove' or 'generalise' for the terms that disclose them."""
    docs = docs.select("doc_id", "text")
    found = common.store(entities(docs), "entities")
    near = common.store(contexts(found), "contexts")
    telling = common.store(disclosures(docs, near, support, generalise), "telling")
    action = F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    hits = occurrences(docs, found, telling).groupBy("doc_id", "key", "start", "end").agg(F.max("share").alias("share"))
    term = F.struct("start", F.lit(4).alias("kind"), "end", action.alias("action"))
    added = hits.groupBy("doc_id", "key").agg(F.collect_list(term).alias("terms")).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "terms")
    own = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("remove").alias("action")))
    base = found.select("doc_id", "key", own.alias("base"))
    both = base.join(added, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "terms")))
    out = common.store(both.select("doc_id", "key", spans.alias("spans")), "personal_data")
    common.discard(found, near, telling)
    return out


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with entities replaced by [KIND], removed terms by [REMOVED] and
    generalised ones by their class: [NAME Z*] where they begin with a capital, else [WORD z*]. Where spans
    overlap, the first that starts holds."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    f = found.select(F.col("doc_id").alias("_proofline_d"), F.col("key").alias("_proofline_k"), F.col("spans").alias("_proofline_s")).dropDuplicates(["_proofline_d", "_proofline_k"])
    rows = docs.join(f, (key == F.col("_proofline_k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_proofline_d")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    initial = lambda s: F.substr(F.col("text"), (s["start"] + 1).cast("int"), F.lit(1))
    class_of = lambda s: F.concat(F.when(initial(s).rlike(r"\p{Lu}"), F.lit("[NAME ")).otherwise(F.lit("[WORD ")), initial(s), F.lit("*]"))
    label = lambda s: F.when(s["kind"] < 4, F.get(names, s["kind"])).when(s["action"] == "remove", F.lit("[REMOVED]")).otherwise(class_of(s))
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), label(s)).alias("out"), s["end"].alias("at"))
    )
    done = F.aggregate("_proofline_s", state, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    text = F.when(F.size("_proofline_s") > 0, done).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.table(spark, sf_dir, "documents"))
    is_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("spans", is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    base = spans_text(F.filter("spans", lambda s: s["kind"] < 4))
    actions = F.array_join(F.transform("spans", lambda s: s["action"]), ",").alias("actions")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), actions)
