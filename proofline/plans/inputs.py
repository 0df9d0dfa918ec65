"""Deterministic inputs for the queries, in Spark and in SQL: noise that makes every rule fire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bound, running
from ..functions.text import ALPHABET, words
from ..operators.blocks import drop_blank, paragraphs

ACCENTED, PLAIN = "éèêàùçôîûäöüñáíóú", "eeeaucoiuaounaiou"
LETTERS = f"a-zA-Z{ALPHABET}{ALPHABET.upper()}"
JOIN = "¦"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, by Spark's estimate, for each partition it is dealt to.
PER_PART = 2 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key``, to all cores at least: of whatever size, its files may be a few large row groups,
    each of which one task reads and then does all the work on. What goes by the key afterwards needs no exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(cores, -(-size // PER_PART)), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


# Spacing


def spaced(c: str = "text") -> Column:
    return F.replace(F.replace(F.col(c), F.lit(", "), F.lit(" ,")), F.lit(" the "), F.lit("  the "))


SPACED = "replace(replace(text, ', ', ' ,'), ' the ', '  the ')"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_spaces(x: str) -> str:
    return sql_strip(rf"regexp_replace({x}, '[ \t]+', ' ', 'g')")


def sql_punctuation(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+([.,:;!?])', '\1', 'g'), '([.,:;!?])([{LETTERS}])', '\1 \2', 'g')"


def sql_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def sql_cut(x: str, after: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '({after})(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: regexp_matches(p, '\S'))"


def sql_chunks(x: str) -> str:
    return sql_cut(x, "[.?!;]+")


# Entities


def with_entities() -> Column:
    return F.concat("text", F.lit(" see https://x.example/"), F.col("doc_id").cast("string"), F.lit(" or /var/log/"), F.col("doc_id").cast("string"), F.lit(". Mr. Smith at google GOOGLE paypal OpenAI"))


WITH_ENTITIES = "(text || ' see https://x.example/' || doc_id || ' or /var/log/' || doc_id || '. Mr. Smith at google GOOGLE paypal OpenAI')"

# Paragraphs: blank ones, some in lower case, some without their final mark, some headings


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return paragraphs(d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))))


SCANNED = """
scanned as (
  select doc_id, unnest(string_split(t, chr(10))) as text, unnest(range(0, len(string_split(t, chr(10))))) as para_idx
  from (select doc_id, case when doc_id % 5 = 0 then replace(text, chr(10), chr(10) || chr(10)) else text end as t from documents)
)"""


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = drop_blank(scanned(spark, sf_dir))
    low = F.when(F.col("para_idx") % 3 == 1, F.lower("text")).otherwise(F.col("text"))
    text = F.when(F.col("para_idx") % 4 == 0, F.regexp_replace(low, r"\.+$", "")).otherwise(low)
    style = F.when((F.col("doc_id") + F.col("para_idx")) % 7 == 0, F.lit("Heading 1")).otherwise(F.lit("Normal"))
    return p.select("doc_id", "para_idx", "section", style.alias("style"), text.alias("text"))


STYLED = (
    SCANNED
    + r""",
styled as (
  select doc_id, para_idx, case when (doc_id + para_idx) % 7 = 0 then 'Heading 1' else 'Normal' end as style,
         case when para_idx % 4 = 0 then regexp_replace(low, '\.+$', '') else low end as text
  from (select *, case when para_idx % 3 = 1 then lower(text) else text end as low from scanned where regexp_matches(text, '\S'))
)"""
)
PARAGRAPHS = r"""
paras as (
  select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(0, len(string_split(text, chr(10))))) as para_idx from documents
)"""

# Pairs of an original and a corrected text


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, frag, type, orig, corr: pieces of 1 to 6 words, changed in eight ways."""
    k = (F.col("doc_id") % 6 + 1).cast("int")

    def changed(x: Column, i: Column) -> Column:
        m, c, o = i % 8, x["c"], x["o"]
        orig = F.when(m == 1, "").when(m == 2, c).when(m == 4, F.concat(F.lit("Google "), o)).when(m == 6, ",").otherwise(o)
        corr = F.when(m == 2, F.upper(c)).when(m == 3, F.concat(o, F.lit(" "))).when(m == 4, F.concat(F.lit("Gogle "), o)).when(m == 5, F.concat(o, F.lit(" "), F.right(o, F.lit(1)))).when(m == 6, ".").when(m == 7, "").otherwise(c)
        return F.struct(orig.alias("orig"), corr.alias("corr"))

    both = lambda c: F.struct(c.alias("c"), F.translate(c, ACCENTED, PLAIN).alias("o"))
    # Pieces are cut before they are rows: a row of each with all words of its document is quadratic in the document.
    pieces = lambda ws: F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(1), F.size(ws), k), lambda at: F.array_join(F.slice(ws, at, k), " ")))
    d = documents(spark, sf_dir).select("doc_id", bound(words(F.replace("text", F.lit("ß"), F.lit("ss"))), pieces).alias("cs"))
    d = d.select("doc_id", F.posexplode_outer(F.transform(F.transform("cs", both), changed)).alias("i", "e")).where("e is not null")
    d = d.select("doc_id", F.col("i").cast("long").alias("frag"), "e.orig", "e.corr")
    kind = F.when(F.col("orig") == F.col("corr"), "equal").when(F.col("orig") == "", "insert").when(F.col("corr") == "", "delete").otherwise("replace")
    return d.withColumn("type", kind)


PAIRS = rf"""
pieces as (
  select doc_id, i, array_to_string(ws[i * k + 1 : i * k + k], ' ') as c, translate(array_to_string(ws[i * k + 1 : i * k + k], ' '), '{ACCENTED}', '{PLAIN}') as o
  from (select doc_id, ws, k, unnest(range(0, cast(ceil(len(ws) / k) as bigint))) as i from (select doc_id, {sql_words("replace(text, 'ß', 'ss')")} as ws, doc_id % 6 + 1 as k from documents))
), changed as (
  select doc_id, i as frag,
         case i % 8 when 1 then '' when 2 then c when 4 then 'Google ' || o when 6 then ',' else o end as orig,
         case i % 8 when 2 then upper(c) when 3 then o || ' ' when 4 then 'Gogle ' || o when 5 then o || ' ' || right(o, 1) when 6 then '.' when 7 then '' else c end as corr
  from pieces
), pairs as (
  select *, case when orig = corr then 'equal' when orig = '' then 'insert' when corr = '' then 'delete' else 'replace' end as type from changed
)"""

# Edits with places: every fifth word and the next one


def placed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words keep the mark after them, so a document's edits are cut from its words in one row, without its text
    beside each of them."""
    fives = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws), F.lit(5)), lambda at: F.slice(ws, at, 5))
    d = documents(spark, sf_dir).select("doc_id", bound(F.split("text", r"(?<=[ \n])", -1), fives).alias("gs"))
    two = lambda g: F.when(F.size(g) > 1, F.concat(F.get(g, 0), F.regexp_replace(F.get(g, 1), r"[ \n]\z", "")))
    starts = running(F.transform("gs", lambda g: F.length(F.array_join(g, ""))))
    d = d.select("doc_id", F.posexplode_outer(F.zip_with("gs", starts, lambda g, at: F.struct(at.alias("start"), two(g).alias("orig")))).alias("g", "e")).where("e.orig is not null")
    start, orig = F.col("e.start"), F.col("e.orig")
    return d.select("doc_id", F.lit(0).alias("block_id"), (F.col("g") * 5).alias("edit_no"), start.alias("orig_start"), (start + F.length(orig)).alias("orig_end"), orig.alias("orig_text"), F.concat(orig, F.lit("x")).alias("corr_text"))


def placed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("ls"))
    starts = running(F.transform("ls", lambda x: F.length(x) + 1))
    d = d.select("doc_id", F.posexplode_outer(F.zip_with("ls", starts, lambda x, at: F.struct(x.alias("text"), at.alias("start")))).alias("para_idx", "p")).where("p is not null")
    return d.select("doc_id", "para_idx", F.col("p.text").alias("text"), F.lit("body").alias("section"), F.lit(0).alias("block_id"), F.col("p.start").alias("start"), (F.col("p.start") + F.length("p.text")).alias("end"))


PLACED = (
    PARAGRAPHS
    + r""",
words as (
  select doc_id, text, unnest(ws) as w, unnest(range(0, len(ws))) as i from (select doc_id, text, regexp_split_to_array(text, '[ \n]') as ws from documents)
), at_words as (
  select *, cast(coalesce(sum(len(w) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as s from words
), edits as (
  select doc_id, i as edit_no, s as e0, stop as e1, substr(text, s + 1, stop - s) as orig_text, substr(text, s + 1, stop - s) || 'x' as corr_text
  from (select *, lead(s + len(w)) over (partition by doc_id order by i) as stop from at_words) where i % 5 = 0 and stop is not null
), at_paras as (
  select *, cast(coalesce(sum(len(text) + 1) over (partition by doc_id order by para_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as p0 from paras
), met as (
  select e.*, p.para_idx, p.p0, p.p0 + len(p.text) as p1, count(*) over (partition by e.doc_id, edit_no) as n_paras,
         row_number() over (partition by e.doc_id, edit_no order by p.para_idx) as place
  from edits e join at_paras p on e.doc_id = p.doc_id and e.e0 < p.p0 + len(p.text) and e.e1 > p.p0
), local as (
  select doc_id, edit_no, orig_text, corr_text, para_idx, n_paras, greatest(0, e0 - p0) as local_start, least(p1 - p0, e1 - p0) as local_end from met where place = 1
)"""
)

# Expected and actual edits by words


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.evaluate import accent_only

    w = documents(spark, sf_dir).select("doc_id", F.posexplode(words("text")).alias("i", "w"))
    w = w.withColumn("original", F.translate("w", ACCENTED, PLAIN)).withColumn("expected", F.when(F.col("i") % 17 == 0, F.concat("w", F.lit("s"))).otherwise(F.col("w")))
    exp = w.where("original != expected").select("doc_id", F.col("i").alias("edit_no"), F.col("i").alias("in_start"), (F.col("i") + 1).alias("in_end"), "original", "expected", accent_only("original", "expected").alias("category"))
    act = F.when(F.col("i") % 29 == 0, F.concat("original", F.lit("z"))).when((F.col("original") != F.col("expected")) & (F.col("i") % 3 == 0), F.col("expected"))
    act = act.when((F.col("original") != F.col("expected")) & (F.col("i") % 3 == 1), F.concat("original", F.lit("x"))).when((F.col("original") == F.col("expected")) & (F.col("i") % 13 == 0), F.concat("original", F.lit("y")))
    end = F.col("i") + F.when(F.col("i") % 29 == 0, 2).otherwise(1)
    actual = w.withColumn("actual", act).where("actual is not null").select("doc_id", F.col("i").alias("edit_no"), F.col("i").alias("in_start"), end.alias("in_end"), "original", "actual")
    return exp, actual


EVALUATED = rf"""
words as (
  select doc_id, unnest(ws) as w, unnest(range(0, len(ws))) as i from (select doc_id, {sql_words('text')} as ws from documents)
), noisy as (
  select doc_id, i, translate(w, '{ACCENTED}', '{PLAIN}') as original, case when i % 17 = 0 then w || 's' else w end as expected from words
), exp as (
  select doc_id, i as edit_no, original, expected, case when lower(strip_accents(original)) = lower(strip_accents(expected)) then 'diacritics' else 'spelling' end as category
  from noisy where original <> expected
), act as (
  select * from (
    select doc_id, i as edit_no, case when i % 29 = 0 then i + 2 else i + 1 end as stop, original,
           case when i % 29 = 0 then original || 'z' when original <> expected and i % 3 = 0 then expected when original <> expected and i % 3 = 1 then original || 'x'
                when original = expected and i % 13 = 0 then original || 'y' end as actual from noisy) where actual is not null
), hit as (
  select e.doc_id, e.edit_no, a.edit_no as act_no, a.actual, row_number() over (partition by e.doc_id, e.edit_no order by a.edit_no) as place
  from exp e join act a on e.doc_id = a.doc_id and a.edit_no <= e.edit_no and e.edit_no < a.stop
), first as (select * from hit where place = 1), outcomes as (
  select e.doc_id, e.category, case when f.act_no is null then 'FN' when f.actual = e.expected then 'TP' else 'FP' end as outcome,
         e.original, e.expected, coalesce(f.actual, e.original) as actual, 0 as pass, e.edit_no
  from exp e left join first f on e.doc_id = f.doc_id and e.edit_no = f.edit_no
  union all
  select a.doc_id, 'spelling', 'FP', a.original, a.original, a.actual, 1, a.edit_no from act a
  where not exists (select 1 from first f where f.doc_id = a.doc_id and f.act_no = a.edit_no)
), counted as (
  select category, count(*) filter (where outcome = 'TP') as tp, count(*) filter (where outcome = 'FP') as fp, count(*) filter (where outcome = 'FN') as fn from outcomes group by category
)"""

# Feedback from the labels table


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    label = F.when(d % 10 == 0, "").when(F.col("quality") == 1, "Chuẩn").otherwise("Sai")
    return table(spark, sf_dir, "labels").select(
        d.cast("string").alias("edit_id"), label.alias("user_label"), F.lit("").alias("user_suggested_text"), F.when(d % 2 == 0, "hybrid").otherwise("seq2seq").alias("model_mode"),
        ((d % 37) / 100.0 * F.when(F.col("quality") == 1, 0.5).otherwise(1.0)).alias("edit_ratio"), ((d % 23) / 100.0).alias("length_delta_ratio"), ((d % 100) / 100.0).alias("confidence"),
    )


FEEDBACK = """
feedback as (
  select cast(doc_id as varchar) as edit_id, case when doc_id % 10 = 0 then '' when quality = 1 then 'Chuẩn' else 'Sai' end as user_label,
         case when doc_id % 2 = 0 then 'hybrid' else 'seq2seq' end as model_mode,
         (doc_id % 37) / 100.0::double * (case when quality = 1 then 0.5::double else 1.0::double end) as edit_ratio,
         (doc_id % 23) / 100.0::double as length_delta_ratio, (doc_id % 100) / 100.0::double as confidence from labels
)"""
