"""Toxicity by a counterfactually regularised classifier (operator 8).

*Features.* Words, and their first 4, 5, 6 and 8 bytes (in lower case, punctuation aside): whether
each occurs, and how dense it is in the text (once in 32 words counts in full). Of all features of
the labelled sample, those that a likelihood-ratio test ties to the label most strongly are used, so
that a long text's ordinary words add nothing to its score.

*Counterfactuals.* Every identity term of a labelled text is swapped for the next of its group, and
in a second copy for its group's neutral word. The logistic loss is penalised by the squared change of
the score between a text and its copies. What a model could learn from *who* is mentioned is thus
traded away, which is where false positives on neutral mentions come from. The words of identity terms
that the sample holds are always features, so the penalty acts on all of them, however little they tell
about the label; a sample without any identity term is warned of, as its model has no such protection.

Learning uses a bounded sample of labelled rows (MAX_ROWS, chosen by a hash of the doc_id); scores are
computed for every whole text, in one pass without a shuffle.

Results for odd input: null text is empty text, which is scored by the intercept; null doc_ids are
scored and not held out; repeated labels of a doc_id count as toxic if one of them is; labels of one
class only give that class's share as every score (0 without labels); an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

MAX_ROWS = 8192
MAX_FEATURES = 1024
LEAST_DOCS, LEAST_RATIO = 4, 10.8
PREFIXES = (4, 5, 6, 8)
DENSE = 32
L2, COUNTERFACTUAL, STEPS = 0.3, 4.0, 400
THRESHOLD = 0.3

#: Identity terms by group; the first of a group is its neutral word. A parameter of ``train``. A term
#: is in one group only.
IDENTITY = (
    ("they", "he", "she"),
    ("their", "his", "her"),
    ("iel", "il", "elle"),
    ("jemand", "er", "sie"),
    ("alguien", "él", "ella"),
    ("people", "women", "men", "girls", "boys", "females", "males", "transgender"),
    ("person", "woman", "man", "girl", "boy", "female", "male"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("believer", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("folk", "gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"),
    ("residents", "black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("neighbours", "immigrants", "refugees", "foreigners", "natives"),
    ("patients", "disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("personnes", "femmes", "hommes", "filles", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("leute", "frauen", "männer", "mädchen", "muslime", "christen", "juden", "ausländer"),
    ("gente", "mujeres", "hombres", "niñas", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)


def _hashes(terms: list[str]) -> list[np.ndarray]:
    g = next(words.groups(pa.array(terms)))
    low = words.fold_letters(g.raw)
    starts, ends, doc = g.cut(words.PUNCT, low)
    if not np.array_equal(doc, np.arange(len(terms))):
        raise ValueError("identity terms are single words")
    return words.prefix_hashes(low, starts, ends, PREFIXES)


class Swaps:
    """The features that an identity term's counterparts have in its place."""

    def __init__(self, groups: tuple[tuple[str, ...], ...]):
        terms = [t for g in groups for t in g]
        nxt = [g[1 + i % (len(g) - 1)] if len(g) > 1 else g[0] for g in groups for i in range(len(g))]
        neutral = [g[0] for g in groups for _ in g]
        own = _hashes(terms) if terms else [np.zeros(0, dtype=np.uint64)] * (len(PREFIXES) + 1)
        order = np.argsort(own[0])
        self.table = own[0][order]
        self.there = words.member_of(self.table)
        self.copies = [[h[order] for h in _hashes(x)] for x in (nxt, neutral)] if terms else []


class Words:
    """The features of a group of texts: one array of hashes per kind, and each word's text."""

    def __init__(self, g: words.Group):
        low = words.fold_letters(g.raw)
        starts, ends, self.doc = g.cut(words.PUNCT, low)
        self.n = g.n
        self.kinds = words.prefix_hashes(low, starts, ends, PREFIXES)
        self.count = np.bincount(self.doc, minlength=g.n)

    def pairs(self, kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all features and the texts they are in."""
        h = np.concatenate(kinds)
        d = np.concatenate([self.doc] * len(kinds))
        keep = h != 0
        return h[keep], d[keep]

    def swapped(self, swaps: Swaps) -> list[list[np.ndarray]]:
        """The kinds with identity terms exchanged, once for each sort of counterpart."""
        at, place = words.look_up(self.kinds[0], swaps.table, swaps.there)
        out = []
        for copy in swaps.copies if len(at) else ():
            kinds = [k.copy() for k in self.kinds]
            for k, c in zip(kinds, copy):
                k[at] = c[place]
            out.append(kinds)
        return out


@dataclass
class Model:
    """Features (sorted hashes), their weights for occurring and for density, and the intercept."""

    features: np.ndarray
    occurs: np.ndarray
    dense: np.ndarray
    intercept: float
    counterfactuals: int = 0

    def __post_init__(self):
        self.there = words.member_of(self.features)

    def counts(self, w: Words, kinds: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, features and counts of the model's features in a group."""
        h, d = w.pairs(kinds or w.kinds)
        at, place = words.look_up(h, self.features, self.there)
        key, n = np.unique(d[at] * max(1, len(self.features)) + place, return_counts=True)
        return key // max(1, len(self.features)), key % max(1, len(self.features)), n

    def _scores(self, w: Words, kinds: list[np.ndarray] | None = None) -> np.ndarray:
        doc, f, n = self.counts(w, kinds)
        density = np.minimum(1, n * DENSE / np.maximum(8, w.count[doc]))
        z = self.intercept + np.bincount(doc, self.occurs[f] + self.dense[f] * density, minlength=w.n)
        return 1 / (1 + np.exp(-z))

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for g in words.groups(texts):
            out[g.first : g.first + g.n] = self._scores(Words(g))
        return out

    def gap(self, texts: pa.Array, swaps: Swaps) -> np.ndarray:
        """How far each text's score is from that of its furthest counterfactual."""
        out = np.zeros(len(texts))
        for g in words.groups(texts):
            w = Words(g)
            own = self._scores(w)
            for kinds in w.swapped(swaps):
                part = out[g.first : g.first + g.n]
                np.maximum(part, np.abs(self._scores(w, kinds) - own), out=part)
        return out


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class with each feature; one result a partition (of the bounded sample)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        toxic = b.column("toxic").to_numpy() == 1
        for g in words.groups(b.column("text")):
            w = Words(g)
            h, d = w.pairs(w.kinds)
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            found.append((h[new], toxic[g.first + d[new]]))
    if found:
        h, t = (np.concatenate(x) for x in zip(*found))
        f, at = np.unique(h, return_inverse=True)
        p = np.bincount(at, t, minlength=len(f)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(p), pa.array(np.bincount(at, minlength=len(f)) - p)], names=["feature", "p", "n"])


def _dense(k: int, f: np.ndarray, n: np.ndarray, count: int) -> np.ndarray:
    """A text's vector: whether each feature occurs, then how dense it is."""
    v = np.zeros(2 * k, dtype=np.float32)
    v[f] = 1
    v[k + f] = np.minimum(1, n * DENSE / max(8, count))
    return v


def _vectors(features: np.ndarray, swaps: Swaps):
    """Of each text its features and their counts; of each counterfactual that changes any, where its
    vector differs from the text's (copy > 0: places and differences)."""
    blank, k = Model(features, np.zeros(0), np.zeros(0), 0.0), len(features)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column("toxic").to_numpy()
            for g in words.groups(b.column("text")):
                w = Words(g)
                rows: list[tuple] = []
                own: list[np.ndarray] = []
                for copy, kinds in enumerate([w.kinds, *w.swapped(swaps)]):
                    doc, f, n = blank.counts(w, kinds)
                    bound = np.searchsorted(doc, np.arange(g.n + 1))
                    for i in range(g.n):
                        s = slice(bound[i], bound[i + 1])
                        v = _dense(k, f[s], n[s], int(w.count[i]))
                        if copy == 0:
                            own.append(v)
                            rows.append((0, toxic[g.first + i], w.count[i], f[s].astype(np.int32).tobytes(), n[s].astype(np.int32).tobytes()))
                            continue
                        d = v - own[i]
                        at = np.flatnonzero(d)
                        if len(at):
                            rows.append((copy, toxic[g.first + i], w.count[i], at.astype(np.int32).tobytes(), d[at].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["copy", "toxic", "words", "f", "n"])

    return run


def _largest(times, n: int) -> float:
    """The largest eigenvalue of a symmetric product, a little over, by power iteration."""
    v = np.random.default_rng(3).standard_normal(n).astype(np.float32)
    top = 0.0
    for _ in range(40):
        v = v / max(float(np.linalg.norm(v)), 1e-12)
        v = times(v)
        top = float(np.linalg.norm(v))
    return 1.1 * top


def fit(x: np.ndarray, y: np.ndarray, gram: np.ndarray, copies: int, l2: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on float32 rows with l2 and, over all differences d between a
    counterfactual and its text (``gram``: the sum of d d', ``copies``: their number),
    penalty * (w d)^2 on average; by accelerated gradient steps. ``gram`` is scaled in place."""
    n, k = x.shape
    y = y.astype(np.float32)
    g = gram
    g *= np.float32(2 * penalty / max(1, copies))
    top = _largest(lambda v: x.T @ (x @ v), k) / (4 * n) + l2 / n + (_largest(lambda v: g @ v, k) if copies else 0)
    rate, share = np.float32(1 / max(top, 1e-6)), float(y.mean())
    w, vw = np.zeros(k, dtype=np.float32), np.zeros(k, dtype=np.float32)
    b, vb = float(np.log(share / (1 - share))), 0.0
    for i in range(steps):
        a = np.float32(i / (i + 3))
        ww, bb = w + a * vw, b + float(a) * vb
        q = 1 / (1 + np.exp(-(x @ ww + np.float32(bb)))) - y
        gw = (x.T @ q + np.float32(l2) * ww) / np.float32(n)
        if copies:
            gw += g @ ww
        nw, nb = ww - rate * gw, bb - min(float(rate), 4.0) * float(q.mean())
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w.astype(np.float64), float(b)


def held_out(doc_id: str | Column) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, identity: tuple[tuple[str, ...], ...] = IDENTITY, penalty: float = COUNTERFACTUAL) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of rows that are not held out. At most about
    ``max_rows`` labelled rows are used; they reach the driver as counts of at most MAX_FEATURES
    features and the identity terms' own, their counterfactuals as what they change."""
    spark = docs.sparkSession
    lab = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = lab.count()
    part = min(1.0, max_rows / max(1, n))
    chosen = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))).limit(2 * max_rows)
    chosen = chosen.select(F.col("doc_id").alias("_proofline_d"), "toxic")
    own = docs.select(F.col("doc_id").alias("_proofline_d"), "text")
    sample = common.store(own.join(F.broadcast(chosen), "_proofline_d").select("text", "toxic"), "labelled")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), sum(v for k, v in size.items() if k != 1)
    none = np.zeros(0)
    if not pos or not neg:
        share = pos / max(1, pos + neg)
        return Model(np.zeros(0, dtype=np.uint64), none, none, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    counted = sample.mapInArrow(_feature_counts, "feature long, p long, n long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(f"p + n >= {LEAST_DOCS}")
    x = lambda c: F.when(c > 0, c * F.log(c.cast("double"))).otherwise(0.0)
    p, q = F.col("p"), F.col("n")
    ratio = 2 * (x(p) + x(q) + x(pos - p) + x(neg - q) - x(p + q) - x((pos + neg) - p - q) + x(F.lit(pos + neg)) - x(F.lit(pos)) - x(F.lit(neg)))
    counted = common.store(counted.withColumn("g", ratio), "features")
    best = counted.where(f"g >= {LEAST_RATIO}").orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).select("feature").collect()
    swaps = Swaps(identity)
    named = counted.where(F.col("feature").isin(*swaps.table.view(np.int64).tolist())).select("feature").collect() if len(swaps.table) else []
    features = np.unique(np.array([r["feature"] for r in [*best, *named]], dtype=np.int64).view(np.uint64))
    with common.text_batches(spark):
        rows = sample.mapInArrow(_vectors(features, swaps), "copy int, toxic int, words long, f binary, n binary").toArrow()
    k = len(features)
    # One array of the bounded sample, filled row by row: the driver holds it once.
    copy = rows.column("copy").to_numpy()
    x, y = np.zeros((int((copy == 0).sum()), 2 * k), dtype=np.float32), rows.column("toxic").to_numpy()[copy == 0] == 1
    gram, copies, at = np.zeros((2 * k, 2 * k), dtype=np.float32), int((copy > 0).sum()), 0
    for i, (f, n, count) in enumerate(zip(rows.column("f"), rows.column("n"), rows.column("words").to_numpy())):
        f = np.frombuffer(f.as_buffer(), dtype=np.int32)
        if copy[i] == 0:
            x[at] = _dense(k, f, np.frombuffer(n.as_buffer(), dtype=np.int32), int(count))
            at += 1
        else:
            d = np.frombuffer(n.as_buffer(), dtype=np.float32)
            gram[np.ix_(f, f)] += np.outer(d, d)
    del rows
    if not copies:
        warnings.warn("no identity term occurs in the labelled texts: the counterfactual penalty has nothing to act on", stacklevel=2)
    w, b = fit(x, y, gram, copies, L2, penalty, STEPS)
    common.discard(sample, counted)
    return Model(features, w[:k], w[k:], b, copies)


def scorer(spark: SparkSession, model: Model):
    """A column function: the score of a whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text))

    return score


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score THRESHOLD or more go. They are scored when the result is
    read, in one pass, so the session keeps its batches of few texts."""
    score = scorer(spark, train(docs, common.table(spark, sf_dir, "labels")))
    common.keep_text_batches(spark)
    return docs.withColumn(common.HIT, score("text")).where(F.col(common.HIT) < THRESHOLD).select(*docs.columns)


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    score = scorer(spark, train(docs, common.table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
    with common.text_batches(spark):
        return common.store(out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")), "scores")
