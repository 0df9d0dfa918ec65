"""Secret scans over a ledger of content-addressed blobs (operator 3).

Every version of every path is named by the SHA-256 of its text. A ledger holds the pairs of blob and
rule version that have been scanned, and what was found. A run scans only the pairs that are not
there, each blob once however many paths and versions hold it, adds them to the ledger, and joins old
and new findings of the rules in force to all paths. So a new path to a blob that was scanned long ago
shows its secrets without the blob being read by a rule again.

Texts that occur once are scanned where they are read; only texts that may be copies (told by a
fixed-size filter) are shuffled to meet the one row that stands for their blob. A blob that a third
of all paths hold is thus scanned once, and its paths are joined as thin rows.

A run writes its findings before the pairs it has scanned: one that dies between them leaves findings
that the next run finds again, and rows that are there twice count once.

Results for odd input: null text is empty text; rows with a null or repeated path keep their rows; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

_HEX = bytes(0x30 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than
    ``least`` are dropped. ``hints``: bytes of which a lower-cased text with a match holds one."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    hints: tuple[bytes, ...] = ()
    hex_run: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer(text)
        return [m.span() for m in found if len(m[self.group]) >= self.least]

    def may_match(self, lowered: bytes, hexes: bytes) -> bool:
        if self.hex_run:
            return b"0" * self.hex_run in hexes
        return not self.hints or any(h in lowered for h in self.hints)


#: The patterns that the results are stated in.
RULES = (
    Rule("assign", 1, r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2, True, (b"passw", b"secret", b"token", b"api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18, hints=(b"akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 16, hex_run=16),
)


def scan_text(raw: bytes, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, place of the rule, end) in code points, ascending."""
    lowered, hexes = raw.lower(), raw.translate(_HEX)
    due = [(i, r) for i, r in enumerate(rules) if r.may_match(lowered, hexes)]
    if not due:
        return []
    text = raw.decode("utf-8", "replace")
    return sorted((a, i, b) for i, r in due for a, b in r.spans(text))


def _scan(rules: tuple[Rule, ...], wanted=None, copied=None):
    """Findings of each text; with filters, of those that are wanted and no copies."""
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if wanted is not None:
                slot = b.column("slot").to_numpy()
                b = b.filter(pa.array(common.in_filter(wanted.value, slot) & ~common.in_filter(copied.value, slot)))
            for g in words.groups(b.column("text")):
                blobs, found = [], []
                raw = g.raw.tobytes()
                for i in range(g.n):
                    spans = scan_text(raw[g.offsets[i] : g.offsets[i + 1]], rules)
                    if spans:
                        blobs.append(b.column("blob")[g.first + i].as_py())
                        found.append([{"kind": rules[k].kind, "version": rules[k].version, "start": s, "end": e} for s, k, e in spans])
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(found, found_type)], names=["blob", "found"])

    return run


FOUND = "blob binary, found array<struct<kind:string,version:int,start:bigint,end:bigint>>"


def blob_of(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def pending(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Blobs with a rule version that the ledger lacks: blob, copies, path (one that stands for the
    blob), rules (the places of the missing rules)."""
    blobs = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("path"))
    every = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for i, r in enumerate(rules)])
    if ledger is None:
        return blobs.withColumn("rules", F.transform(every, lambda r: r["place"]))
    pairs = blobs.withColumn("r", F.explode(every)).select("blob", "copies", "path", "r.*")
    left = pairs.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    return left.groupBy("blob").agg(F.first("copies").alias("copies"), F.min("path").alias("path"), F.array_sort(F.collect_set("place")).alias("rules"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what the ledger (blob, kind, version) lacks among ``versions`` (path, text).

    Returns stored tables: paths (path, blob) of all rows; findings (blob, found: array of kind,
    version, start, end) of the blobs scanned now that have any; and the pairs scanned now
    (blob, kind, version). The distinct sets of missing rules, at most two to the power of the number
    of rules, reach the driver."""
    spark = versions.sparkSession
    with common.text_batches(spark):
        rows = versions.select("path", "text", blob_of("text").alias("blob"))
        paths = common.store(rows.select("path", "blob"), "paths")
        todo = common.store(pending(paths, ledger, rules), "todo")
        due = [tuple(r["rules"]) for r in todo.select("rules").distinct().collect()]
        found = None
        for places in due:
            mine = todo.where(F.col("rules") == F.array(*[F.lit(p) for p in places]))
            own = tuple(rules[p] for p in places)
            wanted, copied = common.id_filter(mine, "blob"), common.id_filter(mine.where("copies > 1"), "blob")
            slots = rows.withColumn("slot", common.filter_slot("blob"))
            share = spark.sparkContext.broadcast
            once = slots.select("blob", "slot", "text").mapInArrow(_scan(own, share(wanted), share(copied)), FOUND)
            stands = mine.select("blob", F.col("path").alias("p"))
            copies = slots.where(common.slot_udf(spark, wanted & copied)("slot")).join(stands, "blob").where(F.col("path").eqNullSafe(F.col("p"))).select("blob", "text")
            part = once.unionByName(copies.mapInArrow(_scan(own), FOUND))
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = spark.createDataFrame([], FOUND)
        # The filter may let a blob through that another set of rules, or none, is due for.
        findings = common.store(found.join(todo.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]) if len(due) < 2 else _merged(found, todo, rules), "findings")
        entry = F.transform("rules", lambda p: F.element_at(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]), p + 1))
        scanned = common.store(todo.select("blob", F.explode(entry).alias("r")).select("blob", "r.*"), "scanned")
    common.discard(todo)
    return paths, findings, scanned


class Ledger:
    """The ledger of one folder of the shared storage: the pairs scanned, and the findings by blob."""

    SCANNED = "blob binary, kind string, version int"
    FINDINGS = "blob binary, kind string, version int, start bigint, end bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, found: array of (kind, version, start, end) by start and the order of ``rules``;
        those of other rule versions are left out."""
        each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("place")) for i, r in enumerate(rules)])
        force = self.spark.range(1).select(F.explode(each).alias("r")).select("r.*")
        mine = self._read("findings", self.FINDINGS).join(F.broadcast(force), ["kind", "version"])
        parts = F.array_sort(F.collect_set(F.struct("start", "place", "kind", "version", "end")))
        return mine.groupBy("blob").agg(F.transform(parts, lambda f: F.struct(f["kind"].alias("kind"), f["version"].alias("version"), f["start"].alias("start"), f["end"].alias("end"))).alias("found"))

    def run(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
        """Bring the ledger up to ``versions`` (path, text). Returns the rows' paths with all findings
        of their blobs (path, blob, found or null), old and new, and the pairs scanned by this run."""
        paths, found, scanned = scan_versions(versions, self.scanned(), rules)
        found.select("blob", F.explode("found").alias("f")).select("blob", "f.*").write.mode("append").parquet(f"{self.path}/findings")
        scanned.write.mode("append").parquet(f"{self.path}/scanned")
        common.discard(found)
        # A table, so that the rows of a blob that many paths hold can be split.
        return paths.join(common.store(self.findings(rules), "findings"), "blob", "left").select("path", "blob", "found"), scanned


def _merged(found: DataFrame, todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of several sets of rules: only those that were due, a row per blob."""
    place = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))]), F.col("f.kind"))
    flat = found.select("blob", F.explode("found").alias("f")).withColumn("place", place).distinct()
    flat = flat.join(todo.select("blob", "rules"), "blob").where("array_contains(rules, place)")
    return flat.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("f.start", "place", "f"))).alias("x")).select("blob", F.transform("x", lambda v: v["f"]).alias("found"))


def spans_text(found: str) -> Column:
    return F.array_join(F.transform(F.coalesce(F.col(found), F.array()), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a new ledger: the first scans every blob; the second, as a later commit of the same
    paths would, has nothing left to scan and takes its rows from the ledger."""
    versions = common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    ledger = Ledger(spark, common.new_path(spark, "ledger"))
    ledger.run(versions)
    rows, scanned = ledger.run(versions)
    if not scanned.isEmpty():
        raise RuntimeError("a run over the same versions found blobs that the ledger lacks")
    rows = rows.withColumn("spans", spans_text("found"))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    counts = [F.when(F.col("found").isNull(), F.lit(0)).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return rows.select(F.col("path").alias("doc_id"), *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


def _any_case(pattern: str) -> str:
    """Letters in either case, spelled out: engines differ in what else they fold."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


_ASSIGN = _any_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
#: A run of capitals and digits, or of hex digits, that is too short holds no other match that is long enough.
ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (
  select doc_id, kind, place, found, gaps, vals, unnest(range(1, len(found) + 1)) as i from (
    select doc_id, 'assign' as kind, 0 as place, regexp_extract_all(t, '{_ASSIGN}', 0) as found, regexp_extract_all(t, '{_ASSIGN}', 2) as vals, regexp_split_to_array(t, '{_ASSIGN}') as gaps from d union all
    select doc_id, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]{{14,}}', 0), [], regexp_split_to_array(t, 'AKIA[A-Z0-9]{{14,}}') from d union all
    select doc_id, 'hex', 2, regexp_extract_all(t, '[0-9a-f]{{16,}}', 0), [], regexp_split_to_array(t, '[0-9a-f]{{16,}}') from d)
), s as (
  select doc_id, kind, place, len(array_to_string(gaps[:i], '')) + len(array_to_string(found[:i - 1], '')) as a, len(found[i]) as n from m where place <> 0 or len(vals[i]) >= 12
), k as (
  select doc_id, count_if(place = 0) as n_assign, count_if(place = 1) as n_access, count_if(place = 2) as n_hex, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, place) as spans from s group by doc_id
)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join k on d.doc_id = k.doc_id
"""
