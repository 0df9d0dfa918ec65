"""Best-fit packing by exact complements (operator 6).

Documents become token ids and an end id; longer ones are cut into full sequences and a shorter first
piece. Packing needs only how many pieces have each length, at most SEQUENCE numbers however many
documents there are, so the plan is made on that histogram:

1. From the longest length down, its gap to a full sequence is looked up among the available lengths
   (single), sums of two (pair) and sums of three (triple); combinations that fill the gap exactly are
   consumed as often as all their counts allow. Each step uses a length up, so there are at most
   SEQUENCE patterns.
2. What has no exact complement goes, longest first, into the tightest gap left (best fit), again
   in runs of equal gaps.

A pattern's k-th slot of length l then takes a run of the pieces of length l in the order of their
numbers. Pieces are numbered per length over hash buckets, so a length that a third of all documents
have is numbered in many tasks. The plan has a bounded number of runs and goes to the tasks as arrays.

Results for odd input: null and empty texts are one piece holding the end id; strings of special
tokens in a text are ordinary text; rows with null or repeated doc_ids are each packed; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEQUENCE = 1024
END_ID = 2
ROWS_PER_BUCKET = 1 << 14

_encoders: dict[str, object] = {}


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary of public_tokenizers (its name is a
    parameter). The ranks of the same vocabulary give the same ids several times faster; where
    that code gives up on a text, the full tokenizer takes over."""

    def __init__(self, vocabulary: str):
        import public_tokenizers as files
        import tiktoken

        self.vocabulary = vocabulary
        with open(files.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = None

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # a Rust panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            return self.slow(text)

    def slow(self, text: str) -> list[int]:
        import public_tokenizers as files
        from tokenizers import Tokenizer

        if self.full is None:
            self.full = Tokenizer.from_file(files.path(f"{self.vocabulary}.json"))
            self.full.encode_special_tokens = True
        return self.full.encode(text, add_special_tokens=False).ids


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than ``size``."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def _pieces(vocabulary: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*e.ids(text or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    for col, v in zip(cols, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def complement(gap: int, have: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths (``have``: counts by length) that add up to ``gap``; the
    fewest, and of those the one with the longest first."""
    if gap <= 0:
        return None
    if have[gap] > 0:
        return (gap,)
    there = have > 0

    def pair(total: int, longest: int) -> tuple[int, int] | None:
        b = np.arange(1, total // 2 + 1)
        ok = b[there[b] & there[total - b] & (total - b <= longest)]
        for x in ok.tolist():
            if 2 * x != total or have[x] > 1:
                return total - x, x
        return None

    found = pair(gap, gap)
    if found:
        return found
    for a in np.flatnonzero(there[: max(gap - 1, 0)])[::-1].tolist():
        if 3 * a < gap:
            break
        have[a] -= 1
        there = have > 0
        found = pair(gap - a, a)
        have[a] += 1
        there = have > 0
        if found:
            return (a, *found)
    return None


def plan(counts: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each. ``counts[l]``: pieces of length l."""
    have = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if have[size]:
        out.append(((size,), int(have[size])))
        have[size] = 0
    rest: list[tuple[int, int]] = []
    for long in range(size - 1, 0, -1):
        while have[long] > 0:
            have[long] -= 1
            fill = complement(size - long, have)
            have[long] += 1
            if fill is None:
                rest.append((long, int(have[long])))
                have[long] = 0
                break
            pattern = (long, *fill)
            need = defaultdict(int)
            for x in pattern:
                need[x] += 1
            times = min(int(have[x]) // n for x, n in need.items())
            for x, n in need.items():
                have[x] -= n * times
            out.append((pattern, times))
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for long, n in rest:
        while n:
            tight = min((g for g in gaps if g >= long and gaps[g]), default=None)
            if tight is None:
                each = size // long
                for k, times in ((each, n // each), (n % each, 1)):
                    if k and times:
                        gaps[size - k * long].append(((long,) * k, times))
                break
            pattern, times = gaps[tight].pop()
            k = min(tight // long, max(1, n // times))
            use = min(times, n // k)
            if use < times:
                gaps[tight].append((pattern, times - use))
            gaps[tight - k * long].append(((*pattern, *(long,) * k), use))
            n -= use * k
    return out + [p for g in sorted(gaps) for p in gaps[g]]


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, sequence of the first, offset) by length and first number."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _placed(table: np.ndarray):
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("number").to_numpy()
            at = np.searchsorted(keys, (b.column("length").to_numpy() << 48) + number, side="right") - 1
            seq = table[at, 2] + number - table[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(table[at, 3])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = SEQUENCE, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. The histogram of lengths, ``size`` numbers, reaches the driver."""
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    with common.text_batches(spark):
        pieces = common.store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, size), schema), "pieces")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    table = runs(plan(counts, size))
    numbered = common.numbered(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], ROWS_PER_BUCKET, "number")
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_placed(table), f"{schema}, sequence_id long, offset long")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the documents that are left, and their places."""
    return pack(docs)


def op6_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
