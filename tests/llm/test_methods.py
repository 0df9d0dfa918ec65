"""What each operator's method promises, beyond the results on given tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from proofline.llm import common, decontaminate, line_dedup, near_dedup, packing, pii, secrets, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"


def letters(rng, n, size=5):
    return [" ".join("".join(map(chr, rng.integers(97, 123, size))) for _ in range(12)) for _ in range(n)]


# 2


@pytest.mark.parametrize("num", [85, 80, 50])
def test_signatures_within_the_distance_share_a_key(num):
    rng = np.random.default_rng(num)
    limit = near_dedup.max_distance(num, 100)
    of, _ = near_dedup.chunks(limit)
    evenly = np.lexsort((of, np.arange(near_dedup.PLACES) - np.searchsorted(of, of)))
    a = rng.integers(0, 1 << 16, near_dedup.PLACES).astype(np.uint16)
    for d in range(limit + 1):
        for places in (evenly[:d], rng.permutation(near_dedup.PLACES)[:d]):
            b = a.copy()
            b[places] ^= 1
            x, y = near_dedup.chunk_keys(np.stack((a, b)), limit)
            assert (x == y).any(), d
    assert limit >= near_dedup.PLACES * (100 - num) / 100


def test_linked_sets_share_a_first_shingle():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        gone = int(rng.integers(0, n // 8 + 1))
        u = np.unique(base)
        v = np.unique(np.concatenate((base[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 12 + 1))).astype(np.uint64))))
        both = len(np.intersect1d(u, v))
        counts = near_dedup.rank(np.bincount(near_dedup._slot(np.concatenate((u, v, base[: n // 2]))), minlength=near_dedup.SLOTS))
        if 100 * both >= 85 * (len(u) + len(v) - both):
            assert len(np.intersect1d(*[near_dedup.first_shingles(x, counts, 85, 100) for x in (u, v)]))


def test_a_doc_id_with_two_texts_is_one_node(spark):
    one, two, three = letters(np.random.default_rng(1), 3)
    docs = [(1, one), (5, one), (5, two), (9, two), (7, three), (None, one), (9, "")]
    got = Counter((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == {(1, 1): 1, (5, 1): 2, (9, 1): 1, (7, 7): 1, (None, None): 1, (9, 9): 1}


# 3


def test_a_ledger_joins_old_and_new_findings_to_all_paths(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    of = lambda rows: spark.createDataFrame(rows, "path string, text string")
    see = lambda rows: {r["path"]: [] if r["found"] is None else [(f["kind"], f["version"]) for f in r["found"]] for r in rows.collect()}
    secret, clean, key = "token = abcdefghijklmn", "nothing here", "AKIA" + "Z" * 16
    rows, scanned = ledger.run(of([("a", secret), ("b", clean)]))
    assert see(rows) == {"a": [("assign", 1)], "b": []} and scanned.count() == 6
    # A new path to an old blob, and a new blob.
    rows, scanned = ledger.run(of([("a", secret), ("c", secret), ("d", f"{key} {secret}")]))
    assert see(rows) == {"a": [("assign", 1)], "c": [("assign", 1)], "d": [("access", 1), ("assign", 1)]} and scanned.select("blob").distinct().count() == 1
    # A new version of one rule scans old blobs by that rule alone, and its findings take the place of the old version's.
    newer = (secrets.RULES[0], secrets.Rule("access", 2, r"AKIA[A-Z0-9]+", 30, hints=(b"akia",)), secrets.RULES[2])
    rows, scanned = ledger.run(of([("a", secret), ("d", f"{key} {secret}")]), newer)
    assert see(rows) == {"a": [("assign", 1)], "d": [("assign", 1)]} and {(r["kind"], r["version"]) for r in scanned.collect()} == {("access", 2)} and scanned.count() == 2
    # Nothing new: nothing is scanned.
    rows, scanned = ledger.run(of([("z", secret), ("y", None)]).where("path = 'z'"))
    assert see(rows) == {"z": [("assign", 1)]} and scanned.count() == 0
    rows, scanned = ledger.run(of([("y", None)]))
    assert see(rows) == {"y": []} and scanned.count() == 3


# 4


def test_good_records_of_a_damaged_member_are_kept():
    parts = [warc.record(i, "http://x", f"page {i} ".encode() * 40) for i in range(6)]
    hurt = b"".join(parts[:2]) + parts[2].replace(b"page 2", b"page X") + b"".join(parts[3:])
    out = list(warc.salvage(warc.member(parts[0]) + warc.member(hurt) + warc.member(parts[5])))
    assert [r.page_id for r in out if isinstance(r, warc.Record)] == [0, 0, 1, 3, 4, 5, 5]
    gaps = [x for x in out if isinstance(x, tuple)]
    assert len(gaps) == 1 and gaps[0][0] == len(warc.member(parts[0])) and "digest" in gaps[0][2]
    # Cut inside the third record: the first two are still there.
    rng = np.random.default_rng(2)
    bodies = [warc.record(i, None, rng.integers(0, 256, 5000).astype(np.uint8).tobytes()) for i in range(4)]
    whole = warc.member(b"".join(bodies))
    out = list(warc.salvage(whole[: len(whole) * 6 // 10] + warc.member(parts[1])))
    assert [r.page_id for r in out if isinstance(r, warc.Record)] == [0, 1, 1] and [x[0] for x in out if isinstance(x, tuple)] == [0]
    bad = bytearray(whole)
    bad[len(whole) * 6 // 10] ^= 0xFF
    out = list(warc.salvage(bytes(bad)))
    assert [r.page_id for r in out if isinstance(r, warc.Record)][:2] == [0, 1] and any(isinstance(x, tuple) for x in out)


def test_damage_in_files_is_reported(spark, tmp_path):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.concat(F.lit("page "), F.repeat(F.col("id").cast("string"), 50)).alias("html"))
    warc.write_archives(pages.repartition(3), f"file://{tmp_path}/w")
    files = sorted((tmp_path / "w").glob("part-*"))
    data = bytearray(files[0].read_bytes())
    data[len(data) // 2] ^= 0xFF
    files[0].write_bytes(bytes(data))
    (tmp_path / "w" / f".{files[0].name}.crc").unlink(missing_ok=True)
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    lost = [r for r in got if r["record_type"] == "quarantined"]
    assert len(lost) == 1 and lost[0]["length"] > 0 and lost[0]["reason"] and len({r["page_id"] for r in got if r["record_type"] != "quarantined"}) == 59


# 5


def test_terms_are_generalised_to_their_class(spark):
    docs = [(i, f"Write to x@secret.org about Zoltan in ward {i}, always in autumn.") for i in range(6)] + [(i, f"Nothing but Zoltan and ward {i}.") for i in (6,)] + [(i, f"The ward number {i} is for all, always.") for i in range(7, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.find_personal_data(df, generalise=0.9, remove=0.97)
    actions = {a["action"] for r in found.collect() for a in r["spans"] if a["kind"] == 4}
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df, found).collect()}
    assert actions == {"remove", "generalise"}
    assert out[3] == "[REMOVED] to [EMAIL] [REMOVED] [NAME Z*] in ward 3, always in [REMOVED]." and out[6] == docs[6][1] and out[300] == docs[300][1]


# 7


def test_shards_of_equal_metadata_and_hot_sources(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 700).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source"))
    got = sharding.shard(docs).collect()
    by, slots = Counter(), defaultdict(list)
    for r in got:
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(by.values()) / 24
    assert len(got) == 20000 and len(by) == 24 and max(abs(v - mean) for v in by.values()) < 0.02 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


# 8


def test_counterfactuals_exist_and_close_the_gap(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = pq.read_table(f"{d}/documents.parquet")["text"].combine_chunks()
    plain, fair = (toxicity.train(docs, labels, penalty=p) for p in (0.0, toxicity.COUNTERFACTUAL))
    assert fair.counterfactuals == plain.counterfactuals > 100
    swaps = toxicity.Swaps(toxicity.IDENTITY)
    before, after = plain.gap(texts, swaps), fair.gap(texts, swaps)
    assert (before > 0).sum() > 300 and after.mean() < 0.05 * before.mean()


def test_held_out_rows_of_the_larger_table(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["predicted"] for r in toxicity.op8_counterfactual_toxicity(spark, d).where("held_out").collect()}
    held = [(got[r["doc_id"]], r["toxic"]) for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.95 * sum(p for p, _ in held) and hit >= 0.9 * sum(t for _, t in held)


def test_texts_without_identity_terms_are_warned_of(spark):
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad words") for i in range(40)], "doc_id long, text string").withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="no identity term"):
        m = toxicity.train(docs, labels)
    assert m.counterfactuals == 0 and m.score(pa.array(["bad words"]))[0] > 0.5


# 9


def test_long_items_many_passages_and_paraphrases(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASSAGES", 24)
    monkeypatch.setattr(decontaminate, "ROUND", 2)
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"lexeme{i}" for i in range(4000)])
    common_ = np.array([f"of{i}" for i in range(40)])
    text = lambda n: list(np.where(rng.random(n) < 0.4, rng.choice(common_, n), rng.choice(vocabulary, n)))
    items = [text(int(rng.integers(20, 60))) for _ in range(60)] + [text(700)]
    docs, want = [], defaultdict(set)
    for i, item in enumerate(items):
        for k, share in enumerate((0.0, 0.1, 0.2, 0.3, 0.4)):
            part = item[200:264] if len(item) > 100 else item
            own = [w if rng.random() >= share else f"other{rng.integers(1000)}" for w in part]
            docs.append((10 * i + k, " ".join(text(70) + own + text(50))))
            want[share].add((10 * i + k, i))
    docs += [(100000 + i, " ".join(text(200))) for i in range(200)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), bench).collect()}
    recall = {s: len(w & got) / len(w) for s, w in want.items()}
    assert recall[0.0] == recall[0.1] == 1.0 and recall[0.2] >= 0.95 and recall[0.3] >= 0.95 and recall[0.4] >= 0.8, recall
    assert not got - set.union(*want.values())


def test_short_items_match_their_exact_words(spark):
    docs = [(1, "well, the Capital of France! and so on"), (2, "of the capital in France"), (3, "capital of"), (4, "France is"), (5, "a France"), (6, None), (None, "the capital of france"), (7, "the capital of\nfrance")]
    bench = [(1, "The capital of France"), (2, "capital, of"), (3, "..."), (4, "no such words here"), (5, "ends with five words here")]
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    found = decontaminate.contaminated(df(docs, "doc_id"), df(bench, "item_id")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (7, 1), (1, 2), (3, 2), (7, 2)} and len(found) == 5
    rng = np.random.default_rng(2)
    item = " ".join(letters(rng, 3))
    docs += [(100, f"{letters(rng, 1)[0]} {item}")]
    found = decontaminate.contaminated(df(docs, "doc_id"), df([*bench, (9, item)], "item_id")).collect()
    assert {r["doc_id"] for r in found if r["item_id"] == 9} == {100} and len(found) == 6
    assert {(r["cosine"], r["coverage"]) for r in found if r["item_id"] < 9} == {(1.0, 1.0)}


def test_partial_sums_add_up_by_levels(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FAN", 2)
    rng = np.random.default_rng(1)
    q = decontaminate.Query.of([(1, rng.integers(1, 1 << 60, 30).astype(np.uint64).tobytes())])
    q.weigh(100, rng.integers(1, 50, len(q.vocabulary)))
    rows = [(i, [int(x) for x in sorted(rng.choice(len(q.vocabulary), 9, replace=False))]) for i in range(50)]
    df = spark.createDataFrame([(i, i, 0, 0, list(range(9)), ids) for i, ids in rows], "doc_id long, key long, block int, start int, place array<int>, ids array<int>").repartition(9)
    space = decontaminate.latent_space(df, q)
    a = np.stack([q.vector(np.array(ids)) for _, ids in rows])
    whole = a.T @ a + max(1, 50) * np.outer(q.vector(q.passages[0]), q.vector(q.passages[0]))
    top = np.linalg.eigh(whole)[1][:, -1]
    assert abs(top @ space[:, 0]) > 0.999


# 10


@pytest.mark.parametrize("shared", [1, 2, 5, 20, 50])
def test_blocks_of_shared_lines_go_whole(spark, shared):
    rng = np.random.default_rng(shared)
    block = letters(rng, shared)
    docs = [(i, "\n".join(letters(rng, 4) + block)) for i in range(300)]
    found = line_dedup.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["line_no"]) for r in found.collect()} == {(i, n) for i in range(300) for n in range(4, 4 + shared)}


def test_lines_of_mere_copies_stay(spark):
    rng = np.random.default_rng(9)
    page = letters(rng, 8)
    docs = [(i, "\n".join(page)) for i in range(100)]
    docs += [(100 + i, "\n".join([*page[:7], letters(rng, 1)[0]])) for i in range(30)]
    found = line_dedup.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found.count() == 0


def test_long_lines_recur_in_few_documents(spark):
    rng = np.random.default_rng(15)
    long = lambda: " ".join(letters(rng, 2))
    passage, page, main = long(), [long() for _ in range(8)], long()
    docs = [(i, "\n".join([*letters(rng, 4), passage, f"{long()} {i}"])) for i in range(3)]
    docs += [(10 + i, "\n".join([*page, *letters(rng, 3)])) for i in range(4)]  # near copies
    docs += [(20 + i, "\n".join([letters(rng, 1)[0], main])) for i in range(4)]  # one text under other titles
    docs += [(30 + i, "\n".join([*letters(rng, 4), "a short line in few places"])) for i in range(5)]
    docs += [(40 + i, docs[0][1]) for i in range(20)]  # copies
    docs += [(70 + i, "\n".join([*letters(rng, 4), "see /page/of " + page[0]])) for i in range(2)]
    found = line_dedup.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line_no"]) for r in found} == {(i, 4) for i in [0, 1, 2, *range(40, 60)]}
    assert {(r["template"], r["n_docs"]) for r in found} == {(passage, 3)}


@pytest.mark.parametrize("shared", [5, 10])
def test_blocks_go_from_documents_of_24_own_words(spark, shared):
    rng = np.random.default_rng(shared)
    block = letters(rng, shared)
    docs = [(i, "\n".join(letters(rng, 2) + block)) for i in range(1000)]
    found = line_dedup.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["line_no"]) for r in found.collect()} == {(i, n) for i in range(1000) for n in range(2, 2 + shared)}


# Tables


def test_results_leave_no_tables_behind_but_their_own(spark, tmp_path):
    import os

    folder = common.shared_dir(spark).removeprefix("file://")
    there = lambda: {os.path.join(d, x) for d, _, names in os.walk(folder) for x in names if x.startswith("part-")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = there()
    near_dedup.near_duplicates(docs)
    kinds = {os.path.basename(os.path.dirname(f)).rsplit("-", 1)[0] for f in there() - before}
    assert kinds <= {"near_duplicates", "components"}
    assert packing.pack(docs.where("false")).count() == 0
