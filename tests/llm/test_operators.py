"""The corpus operators against brute force, on the smallest tables and on odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from proofline.llm import common, decontaminate, line_dedup, near_dedup, packing, pii, secrets, sharding, topk, toxicity, warc, words

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(30000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, slot int, _hit boolean"
ODD = [
    (1, None, "en", None, None, "k", 1, True),
    (2, "", None, "s", 0, "k", 1, True),
    (None, "a text without an id, token=abcdefghijklmnop", "en", "s", 40, None, None, None),
    (3, " \t\n ", "en", "s", 4, "k", 1, True),
    (4, "same words in the same order here", "en", "s", 33, "k", 1, True),
    (4, "same words in the same order here", "en", "s", 33, "k", 1, True),
    (5, "SAME words in the same order here", "en", "s", 33, "k", 1, True),
    (6, LONG, "en", "s", len(LONG), "k", 1, True),
    (7, "mail me: jane.doe@example.org or +49 (170) 123-4567", "en", "s", 50, "k", 1, True),
]


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def grouped(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


# Shared parts


def test_word_hashes_follow_the_words():
    texts = ["One two  one", None, "", "two\tone two", "x" * 700_000 + " one"]
    seen = defaultdict(set)
    for g in words.groups(pa.array(texts)):
        s, e, d = g.cut(words.WHITE, g.raw)
        for a, z, i, h in zip(s, e, d, words.span_hashes(g.raw, s, e)):
            seen[g.raw[a:z].tobytes()].add(int(h))
            assert g.raw[a:z].tobytes().decode() in texts[g.first + i].split()
    assert len(seen) == 4 and all(len(v) == 1 for v in seen.values()) and len(set.union(*seen.values())) == 4


def test_numbers_are_gapless_within_a_hot_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5))
    got = common.numbered(df, ["g"], ["id"], 64, "n").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r["n"])
    assert len(got) == 1000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_components_of_a_path_a_star_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(None, 3), (7, 7)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == grouped([e for e in edges if e[0] is not None and e[0] != e[1]])


# 1


def brute_topk(vectors, k):
    v = {i: [int(np.floor(64 * float(x))) for x in e] for i, e in vectors}
    out = []
    for q in v:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def test_topk_is_exact_and_stops_early(spark):
    e = [(r["vec_id"], r["embedding"]) for r in rows("embeddings")]
    assert sorted(map(tuple, topk.op1_exact_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == brute_topk(e, 20)
    x = np.zeros((4096, 8), dtype=np.int64)
    x[:, 0], x[:, 1] = np.arange(4096), np.arange(4096) % 7
    slot = topk.SortedLists.of(np.arange(4096), x, 50)
    at, score, read = slot.search(np.array([50, 1, 0, 0, 0, 0, 0, 0]), 4095, 5)
    assert at.tolist() == [4094, 4093, 4092, 4091, 4090] and read < 500
    assert slot.search(np.array([50, 1, 0, 0, 0, 0, 0, 0]), 0, 5, 50 * 4096)[2] == 0


def test_topk_over_waves_of_slots(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLOT_VECTORS", 16)
    monkeypatch.setattr(topk, "SLOT_QUERIES", 4)
    monkeypatch.setattr(topk, "WAVE", 3)
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in np.round(rng.standard_normal(4), 1)]) for i in range(300)] + [(7, [float(i), 1.0, 1.0, 1.0]) for i in range(40)]
    v = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0"), 6).collect()))
    x = {}
    for i, e in data:
        x.setdefault(i, set()).add(tuple(int(np.floor(64 * float(np.float32(y)))) for y in e))
    want = []
    for q in range(0, 300, 20):
        best = sorted((-max(sum(a * b for a, b in zip(s, t)) for s in x[q] for t in x[c]), c) for c in x if c != q)[:6]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_topk_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (20, [0.0, 0.0]), (None, [1.0, 1.0]), (40, [])]
    v = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)))
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0"), 2).collect()))
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 4096), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert topk.top_k(v.where("false"), v.where("false"), 2).count() == 0


# 2


def shingles(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(docs, num=85):
    sets = [(i, shingles(t)) for i, t in docs]
    where = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for g in s:
            where[g].add(n)
    links = [(i, i) for i, _ in sets]
    for n, (i, s) in enumerate(sets):
        for m, both in Counter(m for g in s for m in where[g] if m < n).items():
            if 100 * both >= num * (len(s) + len(sets[m][1]) - both):
                links.append((i, sets[m][0]))
    return grouped(links)


def test_near_duplicates_are_those_of_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows("documents")]
    want = brute_classes(docs)
    got = near_dedup.op2_minhash_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(docs)
    size = {i: len(shingles(t)) for i, t in docs}
    assert all(r["n_shingles"] == size[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_template_with_many_variants(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(160):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 7), replace=False):
            w[k] = f"x{i}_{k}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs) and len(set(got.values())) > 3


def test_block_links_join_classes():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 200 - k], rng.integers(0, 1 << 60, k).astype(np.uint64)))) for k in (0, 3, 90, 10, 150)]
    comp, all_ = np.array([10, 11, 12, 13, 14]), np.ones(5, dtype=bool)
    assert sorted(set(grouped(near_dedup.block_links(sets, comp, all_, all_, 85, 100)).items())) == [(10, 10), (11, 10), (13, 10)]


def test_near_duplicates_odd_rows(odd, empty):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd).collect())
    assert got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == 1
    assert got[(4, 3, 4, True)] == 2 and got[(5, 3, 4, False)] == 1 and got[(6, 29996, 6, True)] == 1
    assert sum(n for k, n in got.items() if k[0] is None and k[2] is None and k[3]) == 1
    assert near_dedup.near_duplicates(empty).count() == 0


# 3


def brute_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_are_those_of_brute_force(spark):
    got = {r["doc_id"]: r for r in secrets.op3_secret_ledger(spark, SF).collect()}
    for r in rows("documents"):
        want = brute_secrets(r["text"])
        assert got[r["doc_id"]]["spans"] == want and got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize("text", ["é TOKEN: token: abcdefghijklmnop", "ſecret=abcdefghijklmnop", "AKIA" + "A" * 14 + " api_key='" + "x" * 12, "0123456789abcdef0", "token==abcdefghijkl", "AKIAAKIA1234567890", ""])
def test_secret_patterns(text):
    assert ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in secrets.scan_text(text.encode(), secrets.RULES)) == brute_secrets(text)


def test_the_ledger_scans_only_what_is_new(spark, odd, empty):
    first = odd.select(F.col("doc_id").alias("path"), "text")
    paths, found, ledger = secrets.scan_versions(first)
    assert paths.count() == len(ODD) and found.count() == 1 and ledger.count() == 3 * len({r[1] or "" for r in ODD})
    again = first.unionByName(spark.createDataFrame([(9, "secret = qwertyuiopasdf"), (10, "secret = qwertyuiopasdf")], "path long, text string"))
    newer = (secrets.RULES[0], secrets.Rule("access", 2, r"AKIA[A-Z0-9]+", 18, hints=(b"akia",)), secrets.RULES[2])
    paths, found, more = secrets.scan_versions(again, ledger, newer)
    new = {(bytes(r["blob"]), r["kind"], r["version"]) for r in more.collect()}
    assert {k for _, k, _ in new} == {"assign", "access", "hex"} and sum(k == "assign" for _, k, _ in new) == 1 and sum(k == "access" for _, k, _ in new) == ledger.select("blob").distinct().count() + 1
    assert [[s["kind"] for s in r["found"]] for r in found.collect()] == [["assign"]]
    assert secrets.scan_versions(empty.select(F.col("doc_id").alias("path"), "text"))[1].count() == 0


# 4


def test_archives_come_back(spark):
    got = {r["page_id"]: r for r in warc.op4_warc_salvage(spark, SF).collect()}
    pages = rows("pages")
    last = {}
    for r in pages:
        last[r["html"] or ""] = max(last.get(r["html"] or "", -1), r["page_id"])
    assert len(got) == len(pages)
    for r in pages:
        body, g = (r["html"] or "").encode(), got[r["page_id"]]
        assert g["payload_bytes"] == len(body) and g["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (g["record_type"], g["refers_to"]) == (("response", None) if last[r["html"] or ""] == r["page_id"] else ("revisit", last[r["html"] or ""]))


def test_odd_pages_and_payloads(spark, tmp_path):
    pages = [(1, "http://a\r\nX: y", None), (2, None, ""), (3, "u", "é" * 5), (3, "u", "é" * 5), (4, "u", "WARC/1.1\r\n\r\n\x00"), (None, "u", "é" * 5), (5, "u", "x" * (17 << 20))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got) == [
        (0, "revisit", 3, 10), (1, "revisit", 2, 0), (2, "response", 0, 0), (3, "response", 0, 10), (3, "response", 0, 10), (4, "response", 0, 13), (5, "response", 0, 17 << 20)
    ]
    warc.write_archives(df.where("false"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_salvage_goes_on_after_damage():
    parts = [warc.member(warc.record(i, "http://x", f"page {i}".encode() * 50)) for i in range(5)]
    plain = warc.record(9, None, b"plain")
    whole = b"".join(parts) + plain
    assert [r.page_id for r in warc.salvage(whole)] == [0, 1, 2, 3, 4, 9]
    hurt = bytearray(whole)
    at = len(parts[0]) + len(parts[1]) // 2
    hurt[at] ^= 0xFF
    out = list(warc.salvage(bytes(hurt)))
    assert [r.page_id for r in out if isinstance(r, warc.Record)] == [0, 2, 3, 4, 9]
    assert [x[:2] for x in out if isinstance(x, tuple)] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]
    cut = list(warc.salvage(whole[: len(parts[0]) + 20]))
    assert cut[0].page_id == 0 and cut[1][:2] == (len(parts[0]), len(parts[0]) + 20)
    bad = plain.replace(b"plain", b"plane")
    mixed = list(warc.salvage(b"junk" + bad + parts[2]))
    assert mixed[0][:2] == (0, 4 + len(bad)) and mixed[1].page_id == 2


# 5


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


TRICKY = ["a@b.c%d@e.f@g.h", "x" * 50_000 + "@", "a@b" + ".c" * 20_000, "1" * 60_000, "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "é😀 4111 1111-1111 1111, +1 (2) 345-6789x", "+1((((((((2", "4111111111111111" * 3, "@a.b a@b a@b.", None, ""]


def test_personal_data_is_that_of_brute_force(spark, odd, empty):
    got = {r["doc_id"]: r for r in pii.op5_pii_disclosure(spark, SF).collect()}
    for r in rows("documents"):
        want = brute_pii(r["text"])
        base = ",".join(x for x in got[r["doc_id"]]["spans"].split(",") if not x.startswith("term"))
        assert base == want and got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in pii.entities(df).select("doc_id", pii.spans_text(F.col("spans")).alias("s"), "key").join(df.withColumn("k", F.xxhash64("doc_id", F.coalesce("text", F.lit("")))), F.col("key") == F.col("k")).collect():
        assert r["s"] == brute_pii(r["text"] or ""), r["text"]
    assert pii.find_personal_data(odd).count() == len(ODD) and pii.find_personal_data(empty).count() == 0


def test_rare_telling_terms_go_throughout_and_copies_count_once(spark):
    far = "The clinic has many rooms for all. " * 8
    docs = [(i, f"Write to x@secret.org about zoltan in ward {i}. {far}Then zoltan left.") for i in range(2)]
    docs += [(i, f"Write to y@secret.org about zebra in ward. {far}") for i in range(2, 32)]
    docs += [(i, f"Write to all about ward {i}. {far}") for i in range(32, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df, pii.find_personal_data(df)).collect()}
    assert out[1] == f"Write to [EMAIL] about [REMOVED] in ward 1. {far}Then [REMOVED] left."
    assert out[5] == docs[5][1].replace("y@secret.org", "[EMAIL]") and out[50] == docs[50][1]


def test_telling_terms_are_found_and_removed(spark):
    docs = [(i, f"The clinic wrote to x@secret.org about zoltan in ward {i}.") for i in range(12)] + [(i, f"The clinic wrote to all about ward {i}.") for i in range(12, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.find_personal_data(df)
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df, found).collect()}
    assert out[3] == "The clinic wrote to [EMAIL] about [REMOVED] in ward 3." and out[50] == docs[50][1]


# 6


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df, docs in ((None, [(r["doc_id"], r["text"]) for r in rows("documents")]), (odd, [(r[0], r[1]) for r in ODD])):
        got = (packing.op6_complement_packing(spark, SF) if df is None else packing.pack(df)).collect()
        want = Counter()
        for i, t in docs:
            ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            for k, (s, n) in enumerate(packing.cuts(len(ids), 1024)):
                want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for v in by.values():
            v.sort()
            assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]] and sum(n for _, n in v) <= 1024
        assert len(by) <= -(-sum(r["length"] for r in got) // 1024) * 1.03 + 1
    assert packing.pack(empty).count() == 0


def test_plans_fill_exactly_and_use_every_piece():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = np.zeros(65, dtype=np.int64)
        counts[1:] = rng.integers(0, 30, 64) * (rng.random(64) < 0.4)
        plan = packing.plan(counts, 64)
        used = np.zeros(65, dtype=np.int64)
        for pattern, times in plan:
            assert times > 0 and sum(pattern) <= 64
            for x in pattern:
                used[x] += times
        assert (used == counts).all()
    counts = np.zeros(65, dtype=np.int64)
    counts[[40, 24, 20, 4, 10, 7]] = [3, 1, 1, 1, 2, 1]
    assert ((40, 24), 1) in packing.plan(counts, 64) and ((40, 20, 4), 1) in packing.plan(counts, 64)
    assert packing.complement(24, np.bincount([10, 10, 4, 3], minlength=65)) == (10, 10, 4)


# 7


def test_shards_are_even_and_gapless(spark, odd, empty):
    got = sharding.op7_kdtree_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"].encode() for r in rows("documents")}
    by, slots = Counter(), defaultdict(list)
    for r in got:
        t = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(docs) and set(by) == set(range(24)) and max(by.values()) - min(by.values()) <= 2 * max(map(len, docs.values()))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(empty).count() == 0
    same = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    n = [r["count"] for r in sharding.shard(same).groupBy("shard").count().collect()]
    assert len(n) == 24 and max(n) < 2 * 5000 / 24


# 8


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in toxicity.op8_counterfactual_toxicity(spark, d).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], t) for i, t in labels.items() if i in got and got[i]["held_out"]]
    assert sum(p and t for p, t in held) >= 0.9 * sum(p for p, _ in held) and sum(p and t for p, t in held) >= 0.5 * sum(t for _, t in held)


def test_counterfactuals_make_mentions_neutral(spark):
    rng = np.random.default_rng(6)
    filler = [f"fill{i}" for i in range(300)]
    rows_, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        w = list(rng.choice(filler, 20))
        if toxic and rng.random() < 0.8:
            w.append("insulting")
        if rng.random() < (0.7 if toxic else 0.03):
            w.append(str(rng.choice(["muslim", "jewish", "christian"])))
        rows_.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = pa.array([" ".join([*filler[k : k + 20], "muslim"]) for k in range(0, 200, 20)])
    plain, fair = (toxicity.train(docs, lab, penalty=p).score(neutral).mean() for p in (0.0, toxicity.COUNTERFACTUAL))
    insult = toxicity.train(docs, lab).score(pa.array(["fill1 fill2 insulting fill3"]))[0]
    assert plain > 0.5 > 0.3 > fair and insult > 0.5


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(odd, none).score(pa.array(["x", None]))[0] < 0.3
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    m = toxicity.train(odd, labels)
    out = odd.select("doc_id", toxicity.scorer(spark, m)("text").alias("s")).collect()
    assert len(out) == len(ODD) and all(0 <= r["s"] <= 1 for r in out)
    assert empty.select(toxicity.scorer(spark, m)("text")).count() == 0


# 9


def plain(text):
    return " ".join(re.findall(r"\w+", (text or "").lower()))


def test_contamination_covers_exact_copies_only_here(spark):
    items = {r["item_id"]: plain(r["text"]) for r in rows("benchmark")}
    want = {(r["doc_id"], k) for r in rows("documents") for k, t in items.items() if t in plain(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.op9_latent_decontamination(spark, SF).collect()} == want


def test_paraphrases_and_odd_rows(spark, odd, empty):
    rng = np.random.default_rng(8)
    vocabulary = [f"lexeme{i}" for i in range(3000)]
    text = lambda n: list(rng.choice(vocabulary, n))
    item = text(40)
    near = [w if k % 6 else "other" for k, w in enumerate(item)]
    docs = [(100, " ".join(text(90) + item + text(50))), (101, " ".join(text(30) + near + text(40)).upper()), *[(200 + i, " ".join(text(120))) for i in range(60)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, "x"), (4, " ".join(text(200)))], "item_id long, text string").withColumn("item", F.lit(0))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == {(100, 1), (101, 1)}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_common_subsequences():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 40))
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_subsequence(decontaminate._bits(a), len(a), b.tolist()) == t[-1, -1]


# 10


def brute_lines(docs, min_docs=10, spread=0.3, constant=0.7):
    """(doc_id, line_no) of recurring lines. Documents count as different if their other lines are, and
    copies of a text count once."""
    mask = lambda t: "<*>" if re.search(r"[0-9@/]", t) else t
    lines = {(i, n): tuple(map(mask, x.split())) for i, t in docs for n, x in enumerate(t.split("\n")) if x.split()}
    leaf = lambda k: (len(k), k[:3])
    count = Counter((leaf(k), p, t) for k in lines.values() for p, t in enumerate(k))
    template = {}
    for at, k in lines.items():
        loose = [p >= 3 and t != "<*>" and count[(leaf(k), p, t)] < min_docs for p, t in enumerate(k)]
        if sum(loose) <= (1 - constant) * len(k):
            template[at] = tuple("<*>" if x else t for x, t in zip(loose, k))
    holders = defaultdict(set)
    texts = dict(docs)
    for (i, _), t in template.items():
        holders[t].add(texts[i])
    rest = lambda i, k: tuple(sorted(v for (j, _), v in lines.items() if j == i and v != k))
    out = set()
    for at, t in template.items():
        if len(holders[t]) >= min_docs:
            kinds = {rest(i, k) for (i, n), k in lines.items() if template.get((i, n)) == t}
            if len(kinds) >= min_docs and len(kinds) >= spread * len(holders[t]):
                out.add(at)
    return out


def test_recurring_lines_go_and_copies_stay(spark, odd, empty):
    rng = np.random.default_rng(10)
    body = lambda: "\n".join(" ".join(f"w{x}" if x > 400 else f"{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10 % 10]}{'uvwxy'[x // 100]}" for x in rng.integers(0, 400, 12)) for _ in range(4))
    docs = [(1000 + i, f"{body()}\nPosted on 2024-01-{i % 28 + 1:02d} by user {i} in general\n\nSubscribe to our newsletter today") for i in range(25)]
    docs += [(1100 + i, f"{body()}\nSeen in few places") for i in range(5)]
    copy = f"{body()}\nA line of the copied page only"
    df = spark.createDataFrame(docs + [(1200 + i, copy) for i in range(30)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    found = line_dedup.recurring_lines(df)
    assert {(r["doc_id"], r["line_no"]) for r in found.collect()} == brute_lines(docs) and found.count() == 50
    assert {r["template"] for r in found.collect()} == {"Posted on <*> by user <*> in general", "Subscribe to our newsletter today"}
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df, found).collect()}
    assert left[1003] == "\n".join(docs[3][1].split("\n")[:4]) + "\n" and left[1205] == copy and left[1] is None and len(left) == len({r[0] for r in ODD}) + 60
    assert line_dedup.recurring_lines(empty).count() == 0


def test_a_block_of_boilerplate_goes_and_near_copies_stay(spark):
    rng = np.random.default_rng(5)
    text = lambda lines: [" ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(12)) for _ in range(lines)]
    block, page = text(10), text(10)
    docs = [(i, "\n".join(text(2) + block)) for i in range(200)]
    for i in range(200, 260):
        edited = [x.split() for x in page]
        for at in rng.choice(10, 2, replace=False):
            edited[at][rng.integers(0, 12)] = "edited" + "".join(map(chr, rng.integers(97, 123, 5)))
        docs.append((i, "\n".join(" ".join(x) for x in edited)))
    found = line_dedup.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["line_no"]) for r in found.collect()} == {(i, n) for i in range(200) for n in range(2, 12)}


def test_a_group_of_copies_shields_no_line(spark):
    rng = np.random.default_rng(12)
    text = lambda: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(20))
    line = "Licensed to all who read this"
    copy = f"{text()}\n{line}"
    docs = [(i, f"{text()}\n{line}") for i in range(500)] + [(i, copy) for i in range(500, 2500)]
    found = line_dedup.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["line_no"]) for r in found.collect()} == {(i, 1) for i in range(2500)}


def test_stages_keep_odd_rows_and_columns(spark, odd):
    for stage in (toxicity.toxicity_stage, line_dedup.line_dedup_stage, near_dedup.near_dedup_stage, decontaminate.decontamination_stage):
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        assert {r["doc_id"] for r in out.collect()} == {r[0] for r in ODD} - ({5} if stage is near_dedup.near_dedup_stage else set())


def test_lines_of_the_query_are_those_of_brute_force(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in rows("documents")]
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.op10_template_line_dedup(spark, SF).collect()}
    assert got == brute_lines(docs) and got


def brute_pipeline(docs, score, benchmark):
    """doc_id and text of what the first four stages leave of ``docs`` (doc_id, text)."""
    left = {i: t for i, t in docs if score[i] < 0.3}
    gone = brute_lines(list(left.items()))
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in left.items()}
    classes = brute_classes(list(left.items()), 80)
    items = [plain(t) for t in benchmark]
    return {i: t for i, t in left.items() if classes[i] == i and not any(k in plain(t) for k in items)}


def test_pipeline_is_that_of_brute_force(spark):
    import corpus_pipeline as cp

    docs = [(r["doc_id"], r["text"]) for r in rows("documents")]
    assert len(set(docs)) > len({t for _, t in docs})  # copies are among them
    score = {r["doc_id"]: r["score"] for r in toxicity.op8_counterfactual_toxicity(spark, SF).collect()}
    left = brute_pipeline(docs, score, [r["text"] for r in rows("benchmark")])
    got = cp.run(spark, SF).collect()
    enc = packing.encoder("byte_bpe_50k")
    whole, by = Counter(), defaultdict(list)
    for r in got:
        whole[r["doc_id"]] += r["length"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(whole) == {i: len(enc.ids(t)) + 1 for i, t in left.items()} and len(left) < len(docs)
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]] and sum(n for _, n in v) <= 1024


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(4, 0, 1), (7, 1, 0), (None, 1, 1)], "doc_id long, toxic int, text int")
    bench = spark.createDataFrame([(1, "an item that is found nowhere at all in these"), (2, None), (None, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    for name, docs in (("odd", odd), ("empty", empty)):
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            df.write.parquet(f"file://{tmp_path}/{name}/{table}.parquet")
        got = cp.run(spark, f"file://{tmp_path}/{name}").collect()
        if name == "empty":
            assert not got
            continue
        # The second row of id 4 is the first's copy, 5 is a near copy of them.
        pieces = Counter(r["doc_id"] for r in got if r["piece"] == 0)
        assert pieces == {1: 1, 2: 1, 3: 1, 4: 2, 6: 1, 7: 1, None: 1}
    for table, df in (("documents", odd), ("labels", labels.where("false")), ("benchmark", bench.where("false"))):
        df.write.parquet(f"file://{tmp_path}/bare/{table}.parquet")
    assert {r["doc_id"] for r in cp.run(spark, f"file://{tmp_path}/bare").collect()} == {1, 2, 3, 4, 6, 7, None}
