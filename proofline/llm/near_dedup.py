"""MinHash near-duplicates by a multi-index Hamming join (operator 2).

A document's set holds the 64-bit hashes of its distinct word shingles. Its signature is 112 MinHash
values of 16 bits; the distance of two signatures is the number of places in which they differ.

*Pigeonhole.* Signatures that differ in at most ``max_distance`` places are candidates: a pair at the
linking similarity exceeds that distance with a chance below MISS, a more similar pair less often. The
places are cut into more than half as many chunks as there may be differing places, so some chunk
of such a pair has one differing place at most. Each chunk is indexed once for every place that may be
wrong, with that place left out: 112 keys a signature, and every pair within the distance meets under a key.

*No all-pairs.* Texts with equal sets are one representative. Under a key, all others are first held
against the smallest representative only; confirmed links form classes. Keys whose members then still
fall in several classes are opened. Two linked sets share one of the first shingles of each (all but
``num / den`` of the set, and one) in any common order; in the order of their counts among the open
texts, these are rare ones, so texts that merely share boilerplate don't meet. The texts that such
shingles connect form a group, dealt into blocks by size and hash; each pair of blocks whose sizes allow
a link counts its shared shingles as a product of two small matrices. Only links that join two classes
come out, so copies of one text or one template cost a link each, no pair becomes a row, and nothing is
capped. What stays quadratic, in arithmetic and in copies of sets (one per block of BLOCK shingles), is a
group of texts that share rare shingles with each other and still are not linked.

*Confirmation.* Candidates whose sizes or signatures rule a link out are dropped; the rest are
decided on their full sets, with integers: ``den * |A & B| >= num * |A | B|``.

Results for odd input: null, empty or blank text has an empty set and links with nothing; a text with
fewer words than a shingle is one shingle; rows that share a doc_id are one node, whatever their sets; a
null doc_id takes no part and is its own class; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

PLACES = 112
MISS = 1e-6
#: Shingles of a block of texts, texts that make another block while a group has few, and how few.
BLOCK, SPREAD, PARTS = 1 << 20, 128, 16
#: Shingles of a block that are compared at a time.
COLUMNS = 4096
#: Slots that open texts' shingles are counted in, and slots of a row of counts.
SLOTS, SLOT_ROW = 1 << 20, 1 << 12

_rng = np.random.default_rng(20240229)
_WORD = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_KEY = _rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)


def max_distance(num: int, den: int, miss: float = MISS) -> int:
    """Smallest distance that a pair at the threshold exceeds with a chance below ``miss``."""
    p, tail, k = 1 - num / den, 1.0, 0
    term = (1 - p) ** PLACES
    while k < PLACES:
        tail -= term
        if tail < miss:
            return k
        term *= (PLACES - k) / (k + 1) * p / (1 - p)
        k += 1
    return PLACES


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First text number and the sorted shingle sets of each group of texts."""
    for g in words.groups(texts):
        low = words.LOWER[g.raw]
        starts, ends, doc = g.cut(words.WHITE, low)
        h = words.span_hashes(low, starts, ends)
        sets = [np.zeros(0, dtype=np.uint64)] * g.n
        count = np.bincount(doc, minlength=g.n)
        first = np.concatenate(([0], np.cumsum(count)))
        m = len(h) - k + 1
        s = np.zeros(max(m, 0), dtype=np.uint64)
        for j in range(k if m > 0 else 0):
            s += h[j : j + m] * _WORD[j]
        s = words.mix(s)
        for i in np.flatnonzero(count):
            a, n = first[i], count[i]
            if n >= k:
                sets[i] = np.unique(s[a : a + n - k + 1])
            else:
                own = (h[a : a + n] * _WORD[:n]).sum(dtype=np.uint64) + np.uint64(n)
                sets[i] = words.mix(np.array([own]))
        yield g.first, sets


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash places (uint16) of non-empty sets."""
    out = np.empty((len(sets), PLACES), dtype=np.uint16)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (n == 0 or n + len(sets[j]) <= 1 << 15):
            n += len(sets[j])
            j += 1
        u = np.concatenate(sets[i:j])
        at = np.concatenate(([0], np.cumsum([len(x) for x in sets[i : j - 1]], dtype=np.int64))).astype(np.int64)
        for p in range(PLACES):
            low = np.minimum.reduceat(u * _A[p] + _B[p], at)
            out[i:j, p] = words.mix(low) >> np.uint64(48)
        i = j
    return out


def set_id(u: np.ndarray) -> np.int64:
    """A 64-bit name of a set."""
    a = words.mix(u).sum(dtype=np.uint64) + np.uint64(len(u))
    return words.mix(np.array([a]))[0].astype(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for first, sets in shingle_sets(b.column(1), k):
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signature([sets[i] for i in full])
                blobs: list = [None] * len(sets)
                for i, row in zip(full, sig):
                    blobs[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(sets)).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "n", "set_id", "sig"],
                )

    return run


def _places(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint16).reshape(-1, PLACES)


def chunks(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk of each place, and where each chunk begins: so many that ``limit`` differing places
    leave some chunk with at most one."""
    n = limit // 2 + 1
    of = np.arange(PLACES) * n // PLACES
    return of, np.searchsorted(of, np.arange(n))


def chunk_keys(sig: np.ndarray, limit: int) -> np.ndarray:
    """The keys of each signature: key i is the chunk of place i without that place."""
    of, first = chunks(limit)
    part = (sig.astype(np.uint64) + np.uint64(1)) * _KEY
    total = np.add.reduceat(part, first, axis=1)[:, of]
    return words.mix((total - part) ^ _SALT)


def _index(limit: int, bits=None):
    """Keys of the representatives; with a filter, those that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = chunk_keys(_places(b.column("sig")), limit).ravel()
            reps = np.repeat(b.column("rep").to_numpy(), PLACES)
            if bits is not None:
                hit = common.in_filter(bits.value, (keys & np.uint64(common.FILTER_BITS - 1)).astype(np.int64) + 1)
                keys, reps = keys[hit], reps[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(reps)], names=["key", "rep"])

    return run


def _near(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = (_places(b.column("sig_a")) != _places(b.column("sig_b"))).sum(axis=1)
                keep = pa.array(far <= limit)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def _wanted(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(common.in_filter(bits.value, b.column("slot").to_numpy())))
            for first, sets in shingle_sets(b.column("text"), k) if b.num_rows else ():
                full = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in full], pa.int64()), pa.array([s.tobytes() for s in full], pa.binary())], names=["rep", "members"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                u = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                v = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(den * both >= num * (len(u) + len(v) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def _sets(need: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The sets of some representatives (rep, doc), as a stored table rep, members. Texts are read
    again; a fixed-size filter passes the wanted ones."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(common.id_filter(need, "doc"))
    scan = docs.where("doc_id is not null").select("text", common.filter_slot("doc_id").alias("slot"))
    found = scan.mapInArrow(_wanted(k, bits), "rep long, members binary")
    out = common.store(found.join(need, "rep", "left_semi").dropDuplicates(["rep"]).select("rep", "members"), "sets")
    bits.destroy()
    return out


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b) of representatives, a stored table of those that are links."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    near = common.store(met.select("a", "b", "sig_a", "sig_b").mapInArrow(_near(max_distance(num, den)), "a long, b long"), "near")
    sets = _sets(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "doc"), "rep"), docs, k)
    both = near.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b")), "b")
    out = common.store(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(num, den), "a long, b long"), "links")
    common.discard(near, sets)
    return out


def block_links(sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of classes joined by a link between a set of ``left`` and one of ``right`` (masks);
    as many as it takes to join them."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common_ = count[col] > 1
    owner, col = owner[common_], col[common_]
    may = den * np.bincount(owner, minlength=len(sets)) >= num * n
    rows = [np.flatnonzero(may & side) for side in (left, right)]
    if not len(rows[0]) or not len(rows[1]):
        return []
    keep = may[owner]
    owner, (_, col) = owner[keep], np.unique(col[keep], return_inverse=True)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    shared = np.zeros((len(rows[0]), len(rows[1])), dtype=np.float64)
    at = np.zeros(len(sets), dtype=np.int64)
    same = np.array_equal(*rows)
    for lo in range(0, int(col[-1]) + 1, COLUMNS) if len(col) else ():
        a, z = np.searchsorted(col, [lo, lo + COLUMNS])
        parts = []
        for r in rows[: 1 if same else 2]:
            at[:] = -1
            at[r] = np.arange(len(r))
            x = at[owner[a:z]]
            m = np.zeros((len(r), min(COLUMNS, int(col[-1]) + 1 - lo)), dtype=np.float32)
            m[x[x >= 0], col[a:z][x >= 0] - lo] = 1
            parts.append(m)
        shared += parts[0] @ parts[-1].T
    union = n[rows[0]][:, None] + n[rows[1]][None, :] - shared
    x, y = np.nonzero((den * shared >= num * union) & (comp[rows[0]][:, None] != comp[rows[1]][None, :]))
    if not len(x):
        return []
    ends = np.sort(np.stack((comp[rows[0]][x], comp[rows[1]][y]), axis=1), axis=1)
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for a, b in np.unique(ends, axis=0).tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _blocks(num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        block = np.array(t.column("block").to_pylist())
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("members")]
        found = block_links(sets, t.column("comp").to_numpy(), block == i, block == j, num, den)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _slot(u: np.ndarray) -> np.ndarray:
    return (u & np.uint64(SLOTS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets' shingles fall in each slot; one result a partition."""
    n = np.zeros(SLOTS, dtype=np.int64)
    for b in batches:
        if b.num_rows:
            at, more = np.unique(np.concatenate([_slot(np.frombuffer(x.as_buffer(), dtype=np.uint64)) for x in b.column("members")]), return_counts=True)
            n[at] += more
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at // SLOT_ROW), pa.array(at % SLOT_ROW), pa.array(n[at])], names=["row", "slot", "n"])


def rank(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: the same order, exact up to 16, coarser above."""
    high = 16 + np.floor(16 * np.log2(np.maximum(n, 16) / 16))
    return np.where(n < 16, n, np.minimum(high, 255)).astype(np.uint8)


def _packed(t: pa.Table) -> pa.Table:
    out = np.zeros(SLOT_ROW, dtype=np.uint8)
    out[t.column("slot").to_numpy()] = rank(t.column("n").to_numpy())
    return pa.table([t.column("row")[:1], pa.array([out.tobytes()], pa.binary())], names=["row", "counts"])


def first_shingles(u: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first of a set's shingles (ascending) in the order of (rank of the slot's count, shingle): a
    linked set has one of them among its own first. Those that no other set has are left out."""
    n = counts[_slot(u)]
    order = np.argsort(n, kind="stable")[: len(u) - -(-num * len(u) // den) + 1]
    return u[order][n[order] > 1]


def _firsts(counts, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [first_shingles(np.frombuffer(x.as_buffer(), dtype=np.uint64), counts.value, num, den) for x in b.column("members")]
            if found:
                reps = np.repeat(b.column("rep").to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(reps)], names=["shingle", "rep"])

    return run


def _links_between_classes(open_: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``open_``: rep, comp. A stored table of links between classes (a, b). A byte for each of SLOTS
    slots reaches the driver."""
    spark = docs.sparkSession
    texts = common.store(open_.distinct().join(reps.select("rep", "doc", "n"), "rep"), "texts")
    sets = _sets(texts.select("rep", "doc"), docs, k)
    counts = np.zeros(SLOTS, dtype=np.uint8)
    summed = sets.mapInArrow(_counted, "row long, slot long, n long").groupBy("row", "slot").agg(F.sum("n").alias("n"))
    for r in summed.groupBy("row").applyInArrow(_packed, "row long, counts binary").collect():
        counts[r["row"] * SLOT_ROW : (r["row"] + 1) * SLOT_ROW] = np.frombuffer(r["counts"], dtype=np.uint8)
    shared_counts = spark.sparkContext.broadcast(counts)
    firsts = common.store(sets.mapInArrow(_firsts(shared_counts, num, den), "shingle long, rep long").join(texts.select("rep", "comp"), "rep"), "firsts")
    shared_counts.destroy()
    shared = common.store(firsts.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("rep").alias("lead")).where("x != y").select("shingle", "lead"), "shared")
    met = firsts.join(shared, "shingle").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    groups = common.components(met)
    # Sizes that allow a link are a class apart at most.
    size = F.floor(F.log(F.col("n")) / math.log(den / num)).cast("int") if num < den else F.col("n").cast("int")
    own = texts.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("grp")), "rep").select("rep", "comp", "grp", "n", size.alias("size"))
    own = common.store(own, "own")
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK), F.least(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / SPREAD)))
    parts = own.groupBy("grp", "size").agg(parts.cast("int").alias("parts"))
    dealt = own.join(parts, ["grp", "size"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    there = parts.select("grp", F.col("size").alias("other"), F.col("parts").alias("others"))
    near = F.expr("other between size - 1 and size + 1")
    each = dealt.join(there, "grp").where(near).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    here, to = F.struct(F.col("size"), F.col("part").alias("part")), F.struct(F.col("other").alias("size"), F.col("to").alias("part"))
    each = each.select("grp", F.least(here, to).alias("i"), F.greatest(here, to).alias("j"), here.alias("block"), "rep", "comp").join(sets, "rep")
    name = lambda c: F.concat_ws(":", F.col(c)["size"].cast("string"), F.col(c)["part"].cast("string")).alias(c)
    each = each.select("grp", name("i"), name("j"), name("block"), "rep", "comp", "members")
    out = common.store(each.groupBy("grp", "i", "j").applyInArrow(_blocks(num, den), "a long, b long"), "links")
    common.discard(texts, sets, firsts, shared, own)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """Classes of near-duplicates among ``docs`` (doc_id, text): a row per row with doc_id,
    n_shingles (set size), component_id (the smallest doc_id reachable over links) and kept, as a
    stored table."""
    spark: SparkSession = docs.sparkSession
    with common.text_batches(spark):
        return _near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, num, den)


def _near_duplicates(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    spark, limit = docs.sparkSession, max_distance(num, den)
    signed = common.store(docs.mapInArrow(_signed(k), "doc_id long, n long, set_id long, sig binary"), "signed")
    member = signed.where("doc_id is not null and n > 0")
    first_of = F.min(F.struct("doc_id", "n", "sig")).alias("x")
    # A representative is named by its set; ``doc`` is a row that has it.
    reps = common.store(member.groupBy("set_id").agg(first_of).select(F.col("set_id").alias("rep"), F.col("x.doc_id").alias("doc"), "x.n", "x.sig"), "reps")

    keys = reps.select("rep", "sig").mapInArrow(_index(limit), "key long, rep long")
    shared = common.store(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("lead")).where("members > 1"), "shared")
    bits = spark.sparkContext.broadcast(common.id_filter(shared, slot=common.hash_slot("key")))
    again = reps.select("rep", "sig").mapInArrow(_index(limit, bits), "key long, rep long")
    met = common.store(again.join(shared, "key"), "met")
    bits.destroy()
    stars = met.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    first = _links(stars, reps, docs, k, num, den)

    # Rows of one doc_id are one node, whatever their sets.
    many = common.store(member.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x != y").select("doc_id", "x"), "many")
    same = member.select("doc_id", "set_id").join(many, "doc_id").where("set_id != x").select(F.col("x").alias("a"), F.col("set_id").alias("b")).distinct()

    comp = common.components(first.unionByName(same)).select(F.col("id").alias("rep"), "component")
    of_rep = common.store(reps.select("rep", "doc").join(comp, "rep", "left").select("rep", "doc", F.coalesce("component", "rep").alias("comp")), "classes")
    open_ = met.where("members > 2").select("key", "rep").join(of_rep.select("rep", "comp"), "rep")
    split = open_.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    open_ = common.store(open_.join(split, "key").select("rep", "comp"), "open")
    classes = of_rep
    if not open_.isEmpty():
        more = _links_between_classes(open_, reps, docs, k, num, den)
        joined = common.components(more).select(F.col("id").alias("comp"), F.col("component").alias("least"))
        classes = of_rep.join(joined, "comp", "left").select("rep", "doc", F.coalesce("least", "comp").alias("comp"))
        common.discard(more)
    least = classes.groupBy("comp").agg(F.min("doc").alias("component_id"))
    of_set = classes.join(least, "comp").select(F.col("rep").alias("set_id"), "component_id")

    found = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(of_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out = common.store(out, "near_duplicates")
    common.discard(signed, reps, shared, met, first, many, of_rep, open_)
    return out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one with the smallest doc_id. Five words
    a shingle and a similarity of 0.8, as no contract fixes the stage's."""
    gone = common.store(near_duplicates(docs, 5, 80, 100).where("not kept").select("doc_id").distinct(), "gone")
    return common.without(docs, gone)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Copies of a set meet the smallest of them; the sets meet over their shingles.
ORACLE_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from w
), sets as (
  select s, min(doc_id) as rep from s where len(s) > 0 group by s
), e as (
  select rep, len(s) as n, unnest(s) as g from sets
), links as (
  select a.rep as x, b.rep as y from e a join e b on a.g = b.g and a.rep <> b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach as (
  select rep as x, rep as y from sets union select reach.x, links.y from reach join links on reach.y = links.x
), comp as (
  select x, min(y) as c from reach group by x
)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(c, s.doc_id) as component_id, s.doc_id = coalesce(c, s.doc_id) as kept
from s left join sets on s.s = sets.s left join comp on sets.rep = comp.x
"""
