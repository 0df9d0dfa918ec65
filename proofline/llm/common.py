"""What the operators of this subpackage share: tables, shared storage, numbering, id filters.

Nothing here depends on the rest of the library. Intermediate tables go to the folder that the
cluster names in ``spark.checkpoint.dir``; a lost executor can therefore never take a cut lineage
with it. No function gathers more on the driver than its docstring says.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of an Arrow batch where whole texts cross to Python: bounds a worker's memory.
TEXT_BATCH = 256
#: Bits of an id filter; the filter's size (2 MB) doesn't depend on the data.
FILTER_BITS = 1 << 24

#: A name for a working column that no table of documents has.
HIT = "_proofline_hit"

_own_dir: str | None = None


#: Bytes of a table for each core below which it is dealt to all cores.
PER_CORE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one is dealt to all cores, as its files may be a single row group, which one
    task would read and then do all the work on. Larger tables have splits enough."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * PER_CORE else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, which only a local master may do,
    a temporary folder of this process."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="proofline-")
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/proofline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage durably and gives the
    planner the table's true size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``store`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keep_text_batches(spark: SparkSession) -> None:
    """The same for what is computed later, for which the setting must stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the rows of an Arrow batch; without this a batch of very long texts fills a worker. Holds
    for what runs inside, so results that read texts in Python are stored there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(TEXT_BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(df: DataFrame, group: list[str], order: list[str], rows_per_bucket: int, out: str, bucket_on: list[str] | None = None) -> DataFrame:
    """Gapless numbers from 0 within each group, in no one task's hands.

    Rows are dealt to hash buckets inside their group; a bucket is ranked by itself and starts
    where the earlier buckets of its group end. A group with a third of all rows is thus ranked
    in as many tasks as it has buckets. Adds the long column ``out``. Rows that tie in ``order``
    are interchangeable. One row (the count) reaches the driver.
    """
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    b, first, at = f"_{out}_b", f"_{out}_first", f"_{out}_at"
    df = df.withColumn(b, F.pmod(F.xxhash64(*(bucket_on or order)), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias(first))
    before = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(b).alias(f"_{b}"), F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    ranked = df.withColumn(at, F.row_number().over(W.partitionBy(*group, b).orderBy(*order)) - 1)
    on = (F.col(b) == F.col(f"_{b}"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return ranked.join(starts, on).withColumn(out, (F.col(first) + F.col(at)).cast("long")).drop(b, f"_{b}", first, at, *[f"_{g}" for g in group])


def filter_slot(*cols: str | Column) -> Column:
    """Place of an id in an id filter, from 1."""
    return (F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS)) + 1).cast("long")


def hash_slot(col: str) -> Column:
    """The same for a column that is a 64-bit hash already: its low bits."""
    return (F.pmod(F.col(col), F.lit(FILTER_BITS)) + 1).cast("long")


def id_filter(ids: DataFrame, *cols: str, slot: Column | None = None) -> np.ndarray:
    """Bits of the ids in a table (of its column of slots, where given): no id that is there is
    missed, others pass now and then. Made by bitmap aggregation; at most 512 rows of 4 kB reach the
    driver."""
    rows = (
        ids.select((filter_slot(*cols) if slot is None else slot).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        lo = (r["k"] - 1) * 4096
        bits[lo : lo + len(part)] |= part
    return bits


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots (from ``filter_slot``) are set. Bit i of a bucket is bit i % 8 of byte i // 8."""
    p = slots.astype(np.int64) - 1
    return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def slot_udf(spark: SparkSession, bits: np.ndarray) -> Callable[[Column], Column]:
    """A boolean column: whether a slot is set in the (2 MB) filter."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def hit(slot: pa.Array) -> pa.Array:
        return pa.array(in_filter(shared.value, slot.to_numpy()))

    return hit


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose key is in ``gone`` (a stored table of that column). Only rows
    that a fixed-size filter lets through meet the exact join, so texts that stay are not shuffled.
    Null keys stay."""
    spark = docs.sparkSession
    bits = id_filter(gone, key)
    if not bits.any():
        return docs
    hit = slot_udf(spark, bits)
    marked = docs.withColumn(HIT, F.col(key).isNotNull() & hit(filter_slot(F.coalesce(F.col(key), F.lit(0).cast("long")))))
    sure = marked.where(~F.col(HIT)).drop(HIT)
    rest = marked.where(F.col(HIT)).drop(HIT).join(gone.select(key), key, "left_anti").select(*docs.columns)
    return sure.unionByName(rest)


#: Edges that a task contracts at a time.
CONTRACT = 1 << 17


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The same components as those of the edges, as (id, smallest id of its component)."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(v, root(v)) for v in parent if root(v) != v]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []

    def out(n: int) -> pa.RecordBatch:
        found = forest(a[:n], b[:n])
        del a[:n], b[:n]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for x in batches:
        a += x.column("a").to_pylist()
        b += x.column("b").to_pylist()
        if len(a) >= CONTRACT:
            n = len(a) - 1  # edges that follow each other with one a stay together
            while n and a[n - 1] == a[-1]:
                n -= 1
            if n:
                yield out(n)
    if a:
        yield out(len(a))


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges contracted in each task, then in the tasks that hold all edges of an a. The first
    step leaves an id one edge a task, so no id is frequent in the second."""
    kind = "a long, b long"
    return edges.select("a", "b").mapInArrow(_contract, kind).repartition("a").sortWithinPartitions("a").mapInArrow(_contract, kind)


def _settled(edges: DataFrame) -> bool:
    """Whether each end but the smallest of its component leads to that alone. One row reaches the
    driver."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("b").alias("to")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.min("to").alias("x"), F.max("to").alias("y")).where("x != y").agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (long columns a, b): columns id, component (the
    smallest id reachable), for ids with an edge, as a stored table. Null ends are dropped.

    Each round leads an id's edges on to the smallest id that their ends lead to, then joins the ends
    of one id by contracting edges inside tasks, CONTRACT at a time, until all edges lead to the smallest
    id of their component. Minimum aggregates combine before their shuffle, and no id's neighbours
    are gathered anywhere. No step raises the sum of all ends and a round on unsettled edges lowers it,
    so rounds end. Each round is a table in the shared folder; one number a round reaches the driver.
    """
    now = store(_contracted(edges.where("a is not null and b is not null and a != b")), "edges")
    while not _settled(now):
        on = now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
        led = now.join(on, "b", "left").select("a", F.least("b", "m").alias("b"))
        now, last = store(_contracted(led), "edges"), now
        discard(last)
    ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("component")), F.struct(F.col("b").alias("id"), F.col("b").alias("component")))).alias("e"))
    out = store(ends.select("e.*").groupBy("id").agg(F.min("component").alias("component")), "components")
    discard(now)
    return out
