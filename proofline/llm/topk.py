"""Exact top-k inner products by Fagin's threshold algorithm (operator 1).

Vectors are dealt to slots of about SLOT_VECTORS, and every slot's lists are made once: for each
dimension, its vectors in order of value. Queries are dealt to slots of about SLOT_QUERIES; each pair
of slots is one group of work. A query reads the lists from their better end (the low end where its
component is negative) in step, scores each vector when it first meets it, and adds up what the next
entries of all lists could still give. It stops as soon as that bound is below its k-th score: no vector
it has not met can then enter the result, nor tie with it. It also stops when it has met them all.
Lists are read in steps that double, which can only make a query stop later.

Slots are searched in waves, each WAVE times the one before; after a wave every query's k-th score so far
is the floor of the next: a search stops as soon as its bound is below that floor, and gives only scores
that reach it. So most slots give few rows, and at most k a query; what is merged doesn't depend on how
skewed the vectors are, as a hash of the vector's id balances the slots. The work grows with queries times
vectors, as the stated query set against all rows implies; no group holds more than its two slots. How
much the bound saves depends on the vectors: in many dimensions of even spread, little.

Results for odd input: null vectors, and those with null, NaN or infinite components, take no part,
nor does a null vec_id; vectors only meet queries of the same length (an empty vector scores 0);
fully repeated rows count once; a vec_id with several vectors is searched with each and found with
each, its best score counting; equal scores go to the smaller vec_id; other columns are not looked
at. Scores must fit a long: they are added in doubles while that is exact, else in longs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SLOT_VECTORS = 4096
SLOT_QUERIES = 1024
FIRST_STEP = 16
WAVE = 8


class SortedLists:
    """The vectors of one slot (n x d, integers) by id, with a list of positions per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, reach: int):
        self.ids, self.lists = ids, lists
        self.n, self.d = vectors.shape
        self.unique = bool((ids[1:] != ids[:-1]).all())
        exact = reach * max(1, int(np.abs(vectors).max(initial=0))) * max(1, self.d) < 1 << 53
        self.x = vectors.astype(np.float64 if exact else np.int64)
        self.values = np.take_along_axis(self.x.T, lists, axis=1)

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, reach: int) -> SortedLists:
        return cls(*ordered(ids, vectors), reach)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the k best rows with another id than ``own``, a row an id, and list
        entries read. With ``floor``, only scores of at least that."""
        q = query.astype(self.x.dtype)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = np.zeros(self.n, dtype=bool)
        lo, hi = np.searchsorted(self.ids, [own, own + 1])
        met[lo:hi] = True
        left = self.n - (hi - lo)
        best, score, depth, step, read = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=q.dtype), 0, FIRST_STEP, 0
        while left and depth < self.n:
            if floor is not None and self._bound(q, up, down, depth) < floor:
                break
            if len(up) + len(down) == 0:  # all scores are 0: every row is met at once
                to, seen = self.n, np.ones(self.n, dtype=bool)
            else:
                to, seen = min(self.n, depth + step), np.zeros(self.n, dtype=bool)
                seen[self.lists[up, depth:to].ravel()] = True
                seen[self.lists[down, self.n - to : self.n - depth].ravel()] = True
                read += (to - depth) * (len(up) + len(down))
            new = np.flatnonzero(seen & ~met)
            met[new] = True
            left -= len(new)
            gained = self.x[new] @ q
            if floor is not None:
                new, gained = new[gained >= floor], gained[gained >= floor]
            best, score = np.concatenate((best, new)), np.concatenate((score, gained))
            if not self.unique and len(best):
                order = np.lexsort((-score, self.ids[best]))
                first = np.concatenate(([True], np.diff(self.ids[best[order]]) != 0))
                best, score = best[order][first], score[order][first]
            if len(best) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                best, score = best[keep], score[keep]
            depth, step = to, 2 * step
            if depth < self.n and len(best) >= k and score.min() > self._bound(q, up, down, depth):
                break
        order = np.lexsort((self.ids[best], -score))[:k]
        return best[order], score[order], read

    def _bound(self, q: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int):
        """What a vector that no list has shown down to ``depth`` can score at most."""
        return self.values[up, depth] @ q[up] + self.values[down, self.n - 1 - depth] @ q[down]


def ordered(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors by id, and for each dimension their positions from the largest value down."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    return ids, vectors, np.argsort(-vectors, axis=0, kind="stable").T.astype(np.int32).reshape(vectors.shape[1], len(ids))


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    return t.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0), dtype=np.int64)


def _lists(t: pa.Table) -> pa.Table:
    ids, x, lists = ordered(*_rows(t))
    cells = [pa.array([v.tobytes()], pa.binary()) for v in (ids, x, lists)]
    return pa.table([t.column("d")[:1], t.column("vs")[:1], *cells], names=["d", "vs", "ids", "x", "lists"])


def _group(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            qid, q = _rows(left)
            ids, x, lists = (np.frombuffer(right.column(c)[0].as_py(), dtype=t) for c, t in (("ids", np.int64), ("x", np.int64), ("lists", np.int32)))
            slot = SortedLists(ids, x.reshape(len(ids), -1), lists.reshape(-1, len(ids)), int(np.abs(q).max(initial=0)))
            for own, query, floor in zip(qid, q, left.column("floor").to_pylist()):
                at, score, _ = slot.search(query, int(own), k, floor)
                out.append((np.full(len(at), own), slot.ids[at], score.astype(np.int64)))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    return run


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); rows that take no part are dropped, and
    fully repeated rows count once."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("v"))
        .distinct()
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` (both vec_id, v): query_id, rank
    (from 1), vec_id, score, as a stored table. Two counts reach the driver; they set the number of slots."""
    n, m = vectors.count(), queries.count()
    slots, query_slots = max(1, -(-n // SLOT_VECTORS)), max(1, -(-m // SLOT_QUERIES))
    deal = lambda df, own, count: df.withColumn("d", F.size("v")).withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(count)).cast("int"))
    to_all = lambda df, other, first, count: df.withColumn(other, F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))
    lists = common.store(deal(vectors, "vs", slots).groupBy("d", "vs").applyInArrow(_lists, "d int, vs int, ids binary, x binary, lists binary"), "lists")
    asked = deal(queries, "qs", query_slots)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    first, size = 0, 1
    while first < slots:
        size = min(size, slots - first)
        if best is None:
            mine = asked.withColumn("floor", F.lit(None).cast("long"))
        else:
            floors = best.where(f"rank = {k}").select(F.col("query_id").alias("q"), F.col("score").alias("floor"))
            mine = asked.join(floors, F.col("vec_id") == F.col("q"), "left").drop("q")
        left = to_all(mine, "vs", first, size)
        right = to_all(lists.where(F.col("vs").between(first, first + size - 1)), "qs", 0, query_slots)
        found = left.groupBy("d", "qs", "vs").cogroup(right.groupBy("d", "qs", "vs")).applyInArrow(_group(k), "query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        now = common.store(found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score"), "best")
        if best is not None:
            common.discard(best)
        best, first, size = now, first + size, size * WAVE
    common.discard(lists)
    return best


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.store(quantised(common.table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE_SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
