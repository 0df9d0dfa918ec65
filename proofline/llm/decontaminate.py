"""Benchmark decontamination by latent semantic retrieval (operator 9).

*Passages.* Documents are read in windows of WIDTH words, every half window; items are cut into passages
of WIDTH words. Only words of the benchmark can match, so a window is the sparse vector of those,
weighted by inverse document frequency over all documents. A window is set aside unless it holds at
least REACH of some passage's weight; a looser bound, which needs no sum per passage, goes first (GATE).

*Latent space.* A randomised SVD of the windows' TF-IDF matrix, with the passages' own vectors stacked
below in equal total weight so that no passage's direction is lost: tasks multiply their rows with a
common random matrix, the products are summed by blocks of rows, FAN at a time and level by level, and
the driver orthonormalises a matrix of at most (words of PASSAGES passages) x (passages + EXTRA), twice.
Benchmarks of any size go through in blocks of about PASSAGES passages, however long their items are;
ROUND blocks share one reading of the corpus for frequencies and one for windows.

*Search and checks.* Windows whose cosine with a passage reaches COSINE in that space are candidates. A
candidate is a match if the longest common subsequence of the passage and the window's surroundings
covers COPY of the passage's words, or PARAPHRASE of them with a cosine of CLOSE and the answer (the
passage's last words) in order too.

*Short items.* Items of fewer than LEAST words have too few for that: they match where all their words stand
in their order with nothing between, by 64-bit hashes of such runs. A fixed-size filter passes the runs
that meet the items.

Results for odd input: null texts are empty; items without words match nothing; rows with a null doc_id are never reported; long items are matched by any of
their passages; an empty table on either side gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

WIDTH, HALF = 64, 32
PASSAGES, EXTRA, ROUND = 256, 32, 16
LEAST, ANSWER = 6, 4
GATE, REACH, COSINE, CLOSE = 0.4, 0.3, 0.5, 0.6
COPY, PARAPHRASE = 0.5, 0.4
#: Words of a block of rows; partial sums added at a time; tasks of a product; windows multiplied at a time.
ROWS, FAN, TASKS, STEP = 512, 32, 1024, 512
_RUN = np.random.default_rng(9).integers(1, 1 << 63, LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Query:
    """A block of passages: item and word places in the vocabulary of each, and word weights."""

    items: list
    passages: list[np.ndarray]
    vocabulary: np.ndarray
    there: np.ndarray
    idf: np.ndarray | None = None
    gain: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple]) -> Query:
        """``rows``: item, word hashes of a passage."""
        found = [np.frombuffer(w, dtype=np.uint64) for _, w in rows]
        vocabulary = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
        return cls([i for i, _ in rows], [np.searchsorted(vocabulary, x) for x in found], vocabulary, words.member_of(vocabulary))

    def weigh(self, docs: int, df: np.ndarray) -> None:
        self.idf = np.maximum(np.log((1 + docs) / (1 + df)), 0.05)
        self.gain = np.zeros(len(self.vocabulary))
        for u, own in self._shares():
            self.gain[u] = np.maximum(self.gain[u], own)

    def _shares(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in self.passages:
            u = np.unique(p)
            own = self.idf[u] ** 2
            yield u, own / own.sum()

    def shares(self) -> np.ndarray:
        """Words x passages: the part of each passage's weight that a word has. Made where it is used."""
        out = self.__dict__.get("_dense")
        if out is None:
            out = np.zeros((len(self.vocabulary), len(self.passages)), dtype=np.float32)
            for i, (u, own) in enumerate(self._shares()):
                out[u, i] = own
            self.__dict__["_dense"] = out
        return out

    def vector(self, ids: np.ndarray) -> np.ndarray:
        v = np.zeros(len(self.vocabulary))
        u = np.unique(ids)
        v[u] = self.idf[u]
        return v / max(np.linalg.norm(v), 1e-12)


class Text:
    """The word hashes of a group of texts."""

    def __init__(self, g: words.Group):
        low = words.fold_letters(g.raw)
        starts, ends, self.doc = g.cut(words.PUNCT, low)
        self.hash = words.span_hashes(low, starts, ends)
        self.count = np.bincount(self.doc, minlength=g.n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))


class Hits:
    """A query's words in a group of texts."""

    def __init__(self, t: Text, q: Query):
        at, self.id = words.look_up(t.hash, q.vocabulary, q.there)
        self.doc = t.doc[at]
        self.place = at - t.first[self.doc]
        self.count = t.count


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for g in words.groups(b.column("text")):
            t = Text(g)
            row, found = [], []
            for i in np.flatnonzero(t.count):
                own = t.hash[t.first[i] : t.first[i + 1]]
                starts = list(range(0, len(own), WIDTH))
                if len(starts) > 1 and len(own) - starts[-1] < WIDTH // 4:
                    starts.pop()
                for a, z in zip(starts, [*starts[1:], len(own)]):
                    row.append(g.first + i)
                    found.append(own[a:z].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(row, pa.int64())), pa.array(found, pa.binary())], names=["item", "words"])


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, by where they begin."""
    out = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * _RUN[j]
    return words.mix(out)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short items as runs."""
    for b in batches:
        found = [np.frombuffer(w.as_buffer(), dtype=np.uint64) for w in b.column("words")]
        run = np.array([runs(h, len(h))[0] for h in found], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array([len(h) for h in found], pa.int32()), pa.array(run.view(np.int64))], names=["item", "n", "run"])


def _runs(lengths: list[int], bits):
    """The runs of the texts that may be short items, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in words.groups(b.column("text")):
                t = Text(g)
                for n in lengths:
                    h = runs(t.hash, n)
                    own = t.doc[: len(h)]
                    at = np.flatnonzero((own == t.doc[n - 1 :][: len(h)]) & common.in_filter(bits.value, (h & np.uint64(common.FILTER_BITS - 1)).astype(np.int64) + 1))
                    _, once = np.unique(np.stack((own[at].astype(np.uint64), h[at])), axis=1, return_index=True)
                    at = at[once]
                    row = pa.array(g.first + own[at])
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("key").take(row), pa.array(h[at].view(np.int64))], names=["doc_id", "key", "run"])

    return run


def _frequencies(queries):
    """Documents that hold each word, by block; the number of documents as word -1 of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, [np.zeros(len(q.vocabulary), dtype=np.int64) for q in queries.value]
        for b in batches:
            n += b.num_rows
            for g in words.groups(b.column("text")):
                t = Text(g)
                for d, q in zip(df, queries.value):
                    x = Hits(t, q)
                    d += np.bincount(np.unique(x.doc * len(d) + x.id) % len(d), minlength=len(d))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([-1], pa.int64()), pa.array([n], pa.int64())], names=["block", "id", "n"])
        for k, d in enumerate(df):
            some = np.flatnonzero(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(some), pa.array(d[some])], names=["block", "id", "n"])

    return run


def _ranges(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [a, z), one after the other, and where each range begins among them."""
    offsets = np.concatenate(([0], np.cumsum(z - a)))
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1] - a, z - a), offsets


def _within(x: Hits, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (document, places from lo to hi): the hits' range."""
    wide = np.int64(1) << 32
    key = x.doc * wide + x.place
    return np.searchsorted(key, doc * wide + np.maximum(lo, 0)), np.searchsorted(key, doc * wide + np.maximum(hi, 0))


def _windows(queries):
    """Windows that may hold a part of a passage, with the benchmark's words in and around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in words.groups(b.column("text")):
                t = Text(g)
                halves = np.maximum(1, -(-t.count // HALF))
                base = np.concatenate(([0], np.cumsum(halves)))
                last = np.isin(np.arange(1, base[-1] + 1), base)
                for block, q in enumerate(queries.value):
                    x = Hits(t, q)
                    gain = np.bincount(base[x.doc] + x.place // HALF, q.gain[x.id], minlength=base[-1] + 1)
                    w = np.flatnonzero(gain[:-1] + np.where(last, 0, gain[1:]) >= GATE)
                    doc = np.searchsorted(base, w, side="right") - 1
                    start = (w - base[doc]) * HALF
                    keep = (start == 0) | (start + HALF < t.count[doc])  # the last half alone: the window before holds it
                    doc, start = doc[keep], start[keep]
                    best = np.zeros(len(doc), dtype=np.float32)
                    a, z = _within(x, doc, start, start + WIDTH)
                    for i in range(0, len(doc), STEP):
                        at, offsets = _ranges(a[i : i + STEP], z[i : i + STEP])
                        row, ids = _once(x.id[at], offsets, len(q.vocabulary))
                        best[i : i + STEP] = _sums(q.shares()[ids], row, len(offsets) - 1).max(axis=1, initial=0)
                    doc, start = doc[best >= REACH], start[best >= REACH]
                    if len(doc):
                        at, offsets = _ranges(*_within(x, doc, start - WIDTH, start + 2 * WIDTH))
                        of = pa.array(offsets.astype(np.int32))
                        row = pa.array(g.first + doc)
                        lists = [pa.ListArray.from_arrays(of, pa.array(v[at].astype(np.int32))) for v in (x.place, x.id)]
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("key").take(row), pa.array(np.full(len(doc), block, dtype=np.int32)), pa.array(start.astype(np.int32)), *lists], names=["doc_id", "key", "block", "start", "place", "ids"])

    return run


def _once(ids: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and word, each pair once, by row; rows are given by their offsets in ``ids``."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = np.unique(row * np.int64(max(1, n)) + ids)
    return pair // max(1, n), pair % max(1, n)


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ``row`` (ascending), for n rows."""
    out = np.zeros((n, values.shape[1]), dtype=values.dtype)
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


class Windows:
    """Some windows of an Arrow batch: their words, each once and weighted to length 1, and the words
    around them."""

    def __init__(self, b: pa.RecordBatch, q: Query):
        self.n = b.num_rows
        place, ids = b.column("place"), b.column("ids")
        self.place, self.ids = place.flatten().to_numpy(), ids.flatten().to_numpy()
        self.offsets = np.concatenate(([0], np.cumsum(place.value_lengths().to_numpy()))).astype(np.int64)
        self.start = b.column("start").to_numpy()
        own = np.repeat(self.start, np.diff(self.offsets))
        inside = (self.place >= own) & (self.place < own + WIDTH)
        offsets = np.concatenate(([0], np.cumsum(inside)))[self.offsets]
        self.row, self.word = _once(self.ids[inside], offsets, len(q.vocabulary))
        weight = q.idf[self.word]
        norm = np.sqrt(np.bincount(self.row, weight**2, minlength=self.n))
        self.weight = (weight / np.maximum(norm[self.row], 1e-12)).astype(np.float32)

    def times(self, right: np.ndarray) -> np.ndarray:
        return _sums(self.weight[:, None] * right[self.word], self.row, self.n)


def _parts(batches: Iterator[pa.RecordBatch], q: Query) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    for b in batches:
        for i in range(0, b.num_rows, STEP):
            part = b.slice(i, STEP)
            yield part, Windows(part, q)


PARTIAL = "task int, block int, part binary, rows long"


def _product(shared):
    """A' A R of a task's rows, in blocks of rows; blocks that no window touches are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, r = shared.value
        out, rows = np.zeros(r.shape, dtype=np.float32), 0
        for _, w in _parts(batches, q):
            y = w.times(r)
            order = np.argsort(w.word, kind="stable")
            word = w.word[order]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word
            if len(word):
                out[word[first]] += np.add.reduceat(w.weight[order][:, None] * y[w.row[order]], first, axis=0)
            rows += w.n
        blocks = [k for k in range(0, len(out), ROWS) if rows and (k == 0 or out[k : k + ROWS].any())]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * len(blocks), pa.int32()), pa.array([k // ROWS for k in blocks], pa.int32()), pa.array([out[k : k + ROWS].tobytes() for k in blocks], pa.binary()), pa.array([rows] * len(blocks), pa.int64())],
            names=["task", "block", "part", "rows"],
        )

    return run


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in t.column("part").to_pylist())
    first = [t.column(c)[0].as_py() for c in ("task", "block")]
    return pa.table([pa.array(first[:1], pa.int32()), pa.array(first[1:], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([sum(t.column("rows").to_pylist())], pa.int64())], names=["task", "block", "part", "rows"])


def latent_space(windows: DataFrame, q: Query) -> np.ndarray:
    """Right singular vectors (words x dimensions) of the windows' and the passages' TF-IDF rows. No
    task adds more than FAN partial sums; at most TASKS of them are made, whatever the corpus holds."""
    spark = windows.sparkSession
    n = len(q.vocabulary)
    k = min(n, len(q.passages) + EXTRA)
    own = np.array([q.vector(p) for p in q.passages])
    rows = windows.coalesce(TASKS)
    tasks = rows.rdd.getNumPartitions()

    def times(right: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((q, right.astype(np.float32)))
        parts, left = rows.mapInArrow(_product(shared), PARTIAL), tasks
        while left > 1:
            left = -(-left // FAN)
            parts = parts.withColumn("task", (F.col("task") / FAN).cast("int")).groupBy("task", "block").applyInArrow(_add, PARTIAL)
        blocks = parts.collect()
        shared.destroy()
        out = np.zeros((n, k))
        for r in blocks:
            part = np.frombuffer(r["part"], dtype=np.float32).reshape(-1, k)
            out[r["block"] * ROWS : r["block"] * ROWS + len(part)] = part
        weight = max(1.0, max((r["rows"] for r in blocks), default=1) / len(own))
        return out + weight * (own.T @ (own @ right))

    basis, _ = np.linalg.qr(times(np.random.default_rng(5).standard_normal((n, k))))
    inner = basis.T @ times(basis)
    _, turn = np.linalg.eigh((inner + inner.T) / 2)
    return basis @ turn[:, ::-1]


def common_subsequence(masks: dict[int, int], n: int, tokens: list[int]) -> int:
    """Length of the longest common subsequence of n words, whose places are given as bits by
    word, and ``tokens``; bit-parallel."""
    full = (1 << n) - 1
    v = full
    for t in tokens:
        u = v & masks.get(t, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _bits(ids: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(ids.tolist()):
        out[t] = out.get(t, 0) | 1 << i
    return out


def _matches(shared):
    schema = ["doc_id", "key", "passage", "cosine", "coverage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, v = shared.value
        own = np.array([q.vector(p) @ v for p in q.passages])
        own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        masks = [_bits(p) for p in q.passages]
        tails = [_bits(p[-ANSWER:]) for p in q.passages]
        for b, w in _parts(batches, q):
            y = w.times(v)
            cosine = y @ own.T / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            rows: list[tuple] = []
            for i, c in np.argwhere(cosine >= COSINE).tolist():
                n = len(q.passages[c])
                edge = n // 2 + 8
                place = w.place[w.offsets[i] : w.offsets[i + 1]]
                lo, hi = w.offsets[i] + np.searchsorted(place, [w.start[i] - edge, w.start[i] + WIDTH + edge])
                near = w.ids[lo:hi].tolist()
                share = common_subsequence(masks[c], n, near) / n
                answer = min(ANSWER, n)
                if share >= COPY or share >= PARAPHRASE and cosine[i, c] >= CLOSE and common_subsequence(tails[c], answer, near) == answer:
                    rows.append((i, c, float(cosine[i, c]), share))
            if rows:
                at = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("key").take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], names=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, item: str = "item_id") -> DataFrame:
    """Matches between ``docs`` (doc_id, text) and ``benchmark`` (item, text): doc_id, key (of the
    text), item_id, cosine, coverage; a row for each document and item that match, from stored tables.
    Passages reach the driver in rounds of ROUND blocks, their words' frequencies and latent spaces too."""
    with common.text_batches(docs.sparkSession):
        return _contaminated(docs, benchmark, item)


def _contaminated(docs: DataFrame, benchmark: DataFrame, item: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    asked = benchmark.where(F.col(item).isNotNull() & F.col("text").isNotNull()).select(F.col(item).alias("item"), "text").distinct()
    kind = asked.schema["item"].dataType.simpleString()
    passages = common.store(asked.mapInArrow(_passages, f"item {kind}, words binary").distinct(), "passages")
    few = F.length("words") < 8 * LEAST
    blocks = -(-passages.where(~few).count() // PASSAGES)
    passages_of = passages.where(~few).withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, blocks))))
    schema = f"doc_id long, key long, item_id {kind}, cosine double, coverage double"
    found = []
    short = passages.where(few)
    if not short.isEmpty():
        short = common.store(short.mapInArrow(_short, f"item {kind}, n int, run long"), "short")
        lengths = sorted(r["n"] for r in short.select("n").distinct().collect())
        bits = spark.sparkContext.broadcast(common.id_filter(short, slot=common.hash_slot("run")))
        met = text.mapInArrow(_runs(lengths, bits), "doc_id long, key long, run long").join(short, "run")
        one = F.lit(1.0)
        found.append(common.store(met.select("doc_id", "key", F.col("item").alias("item_id"), one.alias("cosine"), one.alias("coverage")).distinct(), "matches"))
        bits.destroy()
        common.discard(short)
    for first in range(0, blocks, ROUND):
        here: dict[int, list] = {}
        for r in passages_of.where(F.col("block").between(first, first + ROUND - 1)).orderBy("block", "item", "words").collect():
            here.setdefault(r["block"], []).append((r["item"], bytes(r["words"])))
        queries = [Query.of(rows) for _, rows in sorted(here.items())]
        if not queries:
            continue
        df, n = [np.zeros(len(q.vocabulary), dtype=np.int64) for q in queries], 0
        asked_for = spark.sparkContext.broadcast(queries)
        counted = docs.select("text").mapInArrow(_frequencies(asked_for), "block int, id long, n long")
        for r in counted.groupBy("block", "id").agg(F.sum("n").alias("n")).collect():
            if r["id"] < 0:
                n = r["n"]
            else:
                df[r["block"]][r["id"]] = r["n"]
        asked_for.destroy()
        for q, d in zip(queries, df):
            q.weigh(n, d)
        weighed = spark.sparkContext.broadcast(queries)
        every = text.mapInArrow(_windows(weighed), "doc_id long, key long, block int, start int, place array<int>, ids array<int>")
        every = common.store(every, "windows")
        weighed.destroy()
        for block, q in enumerate(queries):
            windows = every.where(f"block = {block}")
            shared = spark.sparkContext.broadcast((q, latent_space(windows, q).astype(np.float32)))
            hits = windows.mapInArrow(_matches(shared), "doc_id long, key long, passage int, cosine double, coverage double")
            names = spark.createDataFrame(list(enumerate(q.items)), f"passage int, item_id {kind}")
            best = hits.join(F.broadcast(names), "passage").groupBy("doc_id", "key", "item_id").agg(F.max("cosine").alias("cosine"), F.max("coverage").alias("coverage"))
            found.append(common.store(best, "matches"))
            shared.destroy()
        common.discard(every)
    common.discard(passages)
    out = spark.createDataFrame([], schema) if not found else found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("doc_id", "key", "item_id").agg(F.max("cosine").alias("cosine"), F.max("coverage").alias("coverage")) if len(found) > 1 else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    hits = contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, common.store(hits.select("doc_id").distinct(), "contaminated"))


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return hits.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("coverage").alias("coverage"))
