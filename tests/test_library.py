"""Operators of the library on hand-computed cases."""

import json
import random
import string

import pytest
from pyspark.sql import functions as F

from proofline.config import Config
from proofline.functions import edits as E
from proofline.functions import entities as N
from proofline.functions import text as T
from proofline.functions.confidence import action, confidence
from proofline.functions.segment import segment, word_chunks
from proofline.operators import apply as A
from proofline.operators import blocks as B
from proofline.operators import evaluate as V
from proofline.operators import hybrid as H
from proofline.operators import report as R
from proofline.operators import tuning as U
from proofline.operators.correct import WordCorrector, correct, restored_case
from proofline.plans.proofread import proofread
from proofline.schemas import RUN
from proofline.sources import docx
from proofline.sources import tables as S


def value(spark, column, **cols):
    names, vals = list(cols) or ["x"], list(cols.values()) or [0]
    df = spark.createDataFrame([tuple(vals)], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, vals)))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "function, text, want",
    [
        (T.normalize_spaces, "\u00a0 a \t b\nc ", "a b\nc"),
        (T.normalize_punctuation_spacing, "a ,b .C\n;3.14 x:đ", "a, b. C;3.14 x: đ"),
        (T.normalize_all, "  Xin  chào ,bạn !", "Xin chào, bạn!"),
        (T.remove_accents, "ĐƯỜNG Tiếng Việt é", "đuong tieng viet e"),
        (T.bullet, "  -• x", "-• "),
        (T.without_bullet, "** a b ", "a b"),
        (T.word_count, " a\u00a0b\n\nc ", 3),
        (T.strip_marks, "Đường", "đuong"),
        (T.is_blank, "\u00a0\n", True),
    ],
)
def test_text(spark, function, text, want):
    assert value(spark, function("t"), t=text) == want


@pytest.mark.parametrize("a, b, want", [("Xong.", "xong!!", "xong."), ("Xong", "xong.", "xong"), ("", "x.", "x."), ("a?!", "b", "b?!")])
def test_trailing_punctuation(spark, a, b, want):
    assert value(spark, T.align_trailing_punctuation("a", "b"), a=a, b=b) == want


def test_whitespace_restored(spark):
    assert value(spark, T.restore_whitespace("a", "b"), a=" \tx \n", b="  y ") == " \ty \n"


# Chunks


@pytest.mark.parametrize(
    "size, text, want",
    [
        (50, "Xin chào các bạn. Hôm nay trời rất đẹp! Bạn thấy sao?", ["Xin chào các bạn.", " Hôm nay trời rất đẹp!", " Bạn thấy sao?"]),
        (256, "Chỉ một câu ngắn.", ["Chỉ một câu ngắn."]),
        (256, "  ", []),
        (3, "a b, c d e f g, h", ["a b,", " c d e ", "f g,", " h"]),
        (256, "v1.2 is out... ok?! \n", ["v1.2 is out...", " ok?!"]),
    ],
)
def test_segments(spark, size, text, want):
    got = value(spark, segment("t", size), t=text)
    assert [c["text"] for c in got] == want and all(text[c["start"] : c["end"]] == c["text"] for c in got)


def test_force_split_by_words(spark):
    text = "Đây là một câu rất dài và không có dấu chấm phẩy gì cả để xem nó cắt ra sao."
    got = value(spark, segment("t", 5), t=text)
    assert len(got) == 4 and "".join(c["text"] for c in got) == text
    assert value(spark, word_chunks("t", 2), t=" a b  c") == [" a b  ", "c"]


# Entities


def test_protection(spark):
    text = "See https://a.b/c?d, me@x.org or /var/log/x. Mr. Smith of google and NASA, GOOGLE"
    m = value(spark, N.protect("t"), t=text)
    assert [e["text"] for e in m["entities"]] == ["https://a.b/c?d,", "me@x.org", "/var/log/x.", "Mr. Smith", "Google", "NASA", "GOOGLE"]
    assert m["text"] == "See [[ENT_0]] [[ENT_1]] or [[ENT_2]] [[ENT_3]] of [[ENT_4]] and [[ENT_5]], [[ENT_6]]"


def test_unprotection_is_literal_and_lenient(spark):
    df = spark.createDataFrame([("a [ [ent_ 0 ]] b [[ENT_1]] [[ENT_10]]", [(0, r"C:\Users\$1"), (1, "x"), (10, "y")])], "t string, e array<struct<id:int,text:string>>")
    assert df.select(N.unprotect("t", "e").alias("v")).first()["v"] == r"a C:\Users\$1 b x y"


# Edits


@pytest.mark.parametrize(
    "a, b, reason",
    [
        ("x", "x", "equal"),
        ("at Google now", "at Gogle now", "whitelist_violation"),
        ("", "new", "insertion_burst"),
        ("gone", "", "length_delta_exceeded"),
        ("abc", "abcd", "length_delta_exceeded"),
        ("abcdefghij", "abcdefghijklm", "safe"),
        (" ", "\t", "insertion_burst"),
        ("one two six ten", "one two sax tan", "edit_ratio_exceeded"),
        ("one two six ten few", "one two six ten fow", "safe"),
        ("one two six", "ana twa sax", "safe"),
        ("se nang day", "se en day", "repetition_hallucination"),
        ("hoc", "học", "safe"),
    ],
)
def test_verdicts(spark, a, b, reason):
    v = value(spark, E.verdict("a", "b"), a=a, b=b)
    assert v["reason"] == reason and v["is_safe"] == (reason in ("equal", "safe"))


@pytest.mark.parametrize(
    "a, b, want",
    [("a ", "a", "spacing_fix"), (",", ".", "punctuation_fix"), ("", "!", "punctuation_fix"), ("ha Noi", "Ha noi", "capitalization_fix"), ("a b c d", "x", "rewrite_large"), ("hoc", "học", "spelling_or_diacritics_fix")],
)
def test_categories(spark, a, b, want):
    assert value(spark, E.category("a", "b"), a=a, b=b) == want


def test_char_diff_rebuilds_both_texts(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc ", k=rng.randrange(0, 260))), "".join(rng.choices("abc ", k=rng.randrange(0, 260)))) for _ in range(30)]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", E.char_diff("a", "b").alias("e"), E.word_diff("a", "b").alias("w")).collect():
        assert "".join(e["orig_text"] for e in r["e"]) == r["a"] and "".join(e["corr_text"] for e in r["e"]) == r["b"]
        assert " ".join(e["corr_text"] for e in r["w"] if e["corr_text"]) == " ".join(r["b"].split())


@pytest.mark.parametrize(
    "a, b, n, kinds, want",
    [("x", "x", 0, [], 1.0), ("toi", "tôi", 1, ["spelling_or_diacritics_fix"], 0.99), ("a b", "a  b", 1, ["spacing_fix"], 0.85), ("a b c d", "x", 1, ["rewrite_large"], 0.4), ("(a b)", "(a b", 1, ["punctuation_fix"], 0.49), ("a b", "ab", 1, ["spelling_or_diacritics_fix"], 0.49), ("a", "abcdefghijk", 1, ["spelling_or_diacritics_fix"], 0.79)],
)
def test_confidence(spark, a, b, n, kinds, want):
    assert value(spark, confidence("a", "b", "n", "k"), a=a, b=b, n=n, k=kinds) == pytest.approx(want)


def test_actions(spark):
    got = {m: [value(spark, action(F.lit(s), F.lit(m))) for s in (0.9, 0.7, 0.5, 0.4)] for m in ("safe", "review", "aggressive", "x")}
    assert got == {"safe": ["apply", "skip", "skip", "skip"], "review": ["apply", "apply", "review", "skip"], "aggressive": ["apply", "apply", "apply", "review"], "x": ["skip"] * 4}


@pytest.mark.parametrize("a, b, want", [("HÀ NỘI", "hà nội", "HÀ NỘI"), ("abc", "ABC", "abc"), ("Toi di hoc o HCM", "tôi đi học ở hcm", "Tôi đi học ở HCM"), ("Anh ay den", "anh ấy đến", "Anh ấy đến")])
def test_capitals_restored(a, b, want):
    assert restored_case(a, b) == want


# Blocks


def test_blocks(spark):
    rows = [(1, 0, "Normal", "A first line"), (1, 1, "Normal", "goes on here."), (1, 2, "Normal", "New one"), (1, 3, "Heading 1", "title"), (2, 0, "Normal", "x")]
    got = {(r["doc_id"], r["para_idx"]): r for r in B.with_places(B.with_blocks(spark.createDataFrame(rows, "doc_id int, para_idx int, style string, text string"))).collect()}
    assert [got[(1, i)]["score"] for i in range(4)] == [4, 0, -3, None] and [got[(1, i)]["block_id"] for i in range(4)] == [0, 0, 1, 2]
    assert got[(1, 1)]["start"] == 13 and got[(1, 1)]["end"] == 26 and got[(2, 0)]["block_id"] == 0


# Runs


def run(i, text, bold=None):
    return (i, text, bold, None, None, None, None, None, None, None)


CASES = {
    "single": ([("Tôi đang đi hoc.", None)], [(12, 15, "học")], [("Tôi đang đi ", None, None), ("học", None, "FF0000"), (".", None, None)], [None]),
    "two_edits": ([("Tôi đang di hoc nhe.", None)], [(9, 11, "đi"), (12, 15, "học")], [("Tôi đang ", None, None), ("đi", None, "FF0000"), (" ", None, None), ("học", None, "FF0000"), (" nhe.", None, None)], [None, None]),
    "format_kept": ([("Hôm nay ", None), ("troi", True), (" đẹp.", None)], [(8, 12, "trời")], [("Hôm nay ", None, None), ("", True, None), ("trời", True, "FF0000"), (" đẹp.", None, None)], [None]),
    "multi_run": ([("Thời ", None), ("tiêst", True), (" hôm nay.", None)], [(0, 10, "Thời tiết")], [("Thời ", None, None), ("tiêst", True, None), (" hôm nay.", None, None)], ["multi_run_edit_not_supported_yet"]),
    "overlap": ([("Tôi đi hoc nhe.", None)], [(7, 10, "học"), (8, 10, "ọc")], [("Tôi đi h", None, None), ("ọc", None, "FF0000"), (" nhe.", None, None)], ["overlap", None]),
    "insert": ([("abc", None)], [(1, 1, "x")], [("abc", None, None)], ["no_mapping_found"]),
    "none": ([("abc", None)], [], [("abc", None, None)], []),
}


@pytest.mark.parametrize("case", CASES)
def test_run_writer(spark, case):
    runs, edits, want, reasons = CASES[case]
    data = [(1, [run(i, t, b) for i, (t, b) in enumerate(runs)], [(n, "replace", s, e, "", c) for n, (s, e, c) in enumerate(edits)])]
    df = spark.createDataFrame(data, f"k int, runs array<{RUN}>, edits array<struct<edit_no:int,type:string,local_start:int,local_end:int,orig_text:string,corr_text:string>>")
    r = A.apply_edits(df, ["k"]).first()
    assert [(x["text"], x["bold"], x["color"]) for x in r["runs_out"]] == want
    assert [x["skip_reason"] for x in sorted(r["results"], key=lambda x: x["edit_no"])] == reasons
    assert all(x["applied"] == (x["skip_reason"] is None) for x in r["results"])


# Correction


def test_correction_uses_the_cache_and_keeps_failures(spark):
    class Broken:
        name = "broken"

        def correct(self, texts):
            raise RuntimeError("no model")

    df = spark.createDataFrame([(1, " - toi di hoc. "), (2, "toi di hoc."), (3, "123"), (4, "An nhe")], "id int, text string")
    cache = spark.createDataFrame([("words", "An nhe", "Ăn nhé"), ("other", "toi di hoc.", "x")], "corrector string, source string, corrected string")
    done, new = correct(df, WordCorrector({"toi": "tôi", "hoc": "học"}), cache)
    assert {r["id"]: r["corrected"] for r in done.collect()} == {1: " - tôi di học. ", 2: "tôi di học.", 3: "123", 4: "Ăn nhé"}
    assert [(r["corrector"], r["source"], r["corrected"]) for r in new.collect()] == [("words", "toi di hoc.", "tôi di học.")]
    done, new = correct(df, Broken())
    assert {r["id"]: r["corrected"] for r in done.collect()} == {r["id"]: r["text"] for r in df.collect()} and new.count() == 0


def test_similarity_and_candidates(spark):
    rng = random.Random(5)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    words = ["".join(rng.choices("abc", k=rng.randrange(1, 8))) for _ in range(60)]
    assert all(H._similar(a, b) == 200 * lcs(a, b) / (len(a) + len(b)) for a in words[:20] for b in words)
    want = {}
    for a in set(words[:20]):
        want[a] = sorted((-200 * lcs(a, b) / (len(a) + len(b)), b) for b in set(words) if 200 * lcs(a, b) / (len(a) + len(b)) > 70)[:5]
    got = {}
    for r in H.candidates(spark.createDataFrame([(w,) for w in words[:20]], "token string"), spark.createDataFrame([(w,) for w in set(words)], "syllable string")).collect():
        got.setdefault(r["token"], []).append((-r["score"], r["candidate"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_hybrid(spark):
    vocab = spark.createDataFrame([("trời",), ("hôm",), ("nay",), ("đẹp",)], "syllable string")
    texts = spark.createDataFrame([(1, "Hôm nay Trờii đẹp, [[ENT_0]] NASA!")], "text_id int, text string")
    scored = spark.createDataFrame([("trờii", "trời", 1, 0.9), ("nay", "x", 1, 1.0)], "token string, candidate string, place int, probability double")
    assert H.hybrid_correct(texts, vocab, scored).first()["corrected"] == "Hôm nay Trời đẹp, [[ENT_0]] NASA!"


# Evaluation and tuning


def test_outcomes_balance(spark):
    exp = [(1, 0, 0, 1, "a", "á", "diacritics"), (1, 1, 3, 4, "b", "c", "spelling"), (1, 2, 6, 7, "d", "e", "spelling"), (1, 3, 8, 8, "", "f", "spelling")]
    act = [(1, 0, 0, 2, "a x", "á"), (1, 1, 3, 5, "b y", "z"), (1, 2, 10, 11, "q", "r")]
    found = V.outcomes(spark.createDataFrame(exp, "doc_id int, edit_no int, in_start int, in_end int, original string, expected string, category string"), spark.createDataFrame(act, "doc_id int, edit_no int, in_start int, in_end int, original string, actual string"))
    got = {r["category"]: r for r in V.precision_recall(V.groups(found)).collect()}
    assert (got["diacritics"]["tp"], got["spelling"]["fp"], got["spelling"]["fn"], got["diacritics"]["f1"], got["spelling"]["f1"]) == (1, 2, 2, 1.0, 0.0)
    assert [r["status"] for r in V.exemplars(found).orderBy("place").collect()] == ["FP (Wrong correction)", "FN (Missed)", "FN (Missed)", "FP (Unnecessary edit)"]


def test_thresholds(spark):
    rows = [(str(i), "Chuẩn" if i % 2 else "Sai", "hybrid", 0.1 + i % 2 * 0.01 if i % 2 else 0.5 + i / 100, 0.1, 0.9) for i in range(20)]
    df = spark.createDataFrame(rows, "edit_id string, user_label string, model_mode string, edit_ratio double, length_delta_ratio double, confidence double")
    assert U.enough(df) and not U.enough(df.where("edit_id < '0'"))
    assert U.suggested(df).first()["edit_ratio"] == pytest.approx(0.11)
    model, predicted = U.fit_model(df)
    assert model.coefficients[0] < 0
    assert {r["label"]: r["f1"] for r in U.classification_report(predicted).collect()} == {0: 1.0, 1: 1.0}


# Files and whole runs


def test_docx_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    content = docx.build([{"style": "Heading 1", "runs": [{"text": "Tiêu đề"}]}, {"runs": []}, {"runs": [{"text": "Hôm nay "}, {"text": "troi", "bold": True}, {"text": " đẹp."}]}], [["ô một"]])
    (tmp_path / "in" / "a.docx").write_bytes(content)
    (tmp_path / "in" / "b.txt").write_text("x")
    paras = docx.read_docx(spark, f"file://{tmp_path}/in")
    assert [(r["para_idx"], r["section"], r["style"], r["text"]) for r in paras.orderBy("para_idx").collect()] == [(0, "body", "Heading 1", "Tiêu đề"), (1, "body", "Normal", ""), (2, "body", "Normal", "Hôm nay troi đẹp."), (3, "table", "Normal", "ô một")]
    r = proofread(paras, WordCorrector({"troi": "trời"}))
    out = docx.write_docx(spark, f"file://{tmp_path}/in", r.paragraphs).first()
    again = docx.parse(out["content"])
    assert [(x["text"], x["bold"], x["color"]) for x in again[2]["runs"]] == [("Hôm nay ", None, None), ("tr", True, None), ("ờ", True, "FF0000"), ("i", True, None), (" đẹp.", None, None)]
    stats = r.stats.first()
    assert (stats["total_paragraphs"], stats["total_changes_applied"], stats["total_rejected"]) == (2, 1, 0)
    R.write_reports(r.stats, r.changes, f"file://{tmp_path}/reports")
    S.append_cache(r.cache, f"file://{tmp_path}/cache")
    assert S.read_cache(spark, f"file://{tmp_path}/cache").where("corrected like '%trời%'").count() == 1
    assert docx.without_blank(content)[1] == 1
    spark.dataSource.register(docx.DocxSource)
    assert spark.read.format("docx").load(f"{tmp_path}/in").count() == 4
    r.release()


def test_destructive_merges_are_rejected(spark):
    none = f"array<{RUN}>"
    rows = [("d", 0, "body", "Normal", "mot dong chua het", []), ("d", 1, "body", "Normal", "con tiep. Xong", [])]
    paras = spark.createDataFrame(rows, f"doc_id string, para_idx int, section string, style string, text string, runs {none}")

    class Swallows:
        name = "swallows"

        def correct(self, texts):
            return [t.replace("het\ncon", "khong") for t in texts]

    r = proofread(paras, Swallows())
    assert "destructive_merge" in {x["reason"] for x in r.review.collect()} and r.changes.count() >= 1
    r.release()


def test_small_files(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Hà_Nội\nxin chào\n")
    assert {r["syllable"] for r in S.read_vocabulary(spark, f"file://{tmp_path}/words.txt").collect()} == {"hà", "nội", "xin", "chào", *H.MARKS}
    (tmp_path / "cache.json").write_text(json.dumps({"a": "b"}))
    assert [tuple(r) for r in S.import_cache(spark, f"file://{tmp_path}/cache.json", "m").collect()] == [("m", "a", "b")]
    assert set(string.punctuation) >= set(".,!?")
    c = Config.from_mapping({"engine": {"mode": "review"}, "diff_engine": {"edit_ratio": 0.5, "user_lexicon": ["X"]}})
    assert c.engine.mode == "review" and c.safety.edit_ratio == 0.5 and c.safety.lexicon == ("X",) and c.max_words == 256


def written(folder, name, texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(docx.build([{"runs": [{"text": t}]} for t in texts]))


def test_a_run_writes_documents_and_corrects_nothing_twice(spark, tmp_path, caplog):
    from proofline.__main__ import main

    written(tmp_path / "in", "a.docx", ["Hôm nay troi đẹp.", "", "toi di hoc."])
    written(tmp_path / "in", "b.docx", ["mot dong chua het", "troi dep"])
    (tmp_path / "words.json").write_text(json.dumps({"troi": "trời", "hoc": "học"}))
    args = ["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--words", str(tmp_path / "words.json"), "--report", str(tmp_path / "rep"), "--no-track-changes"]
    main(args)
    read = lambda n: [p["text"] for p in docx.parse((tmp_path / "out" / n).read_bytes())]
    assert read("a.docx") == ["Hôm nay trời đẹp.", "", "toi di học."] and read("b.docx") == ["mot dong chua het", "trời dep"]
    cache = S.read_cache(spark, f"file://{tmp_path}/out/cache.parquet")
    before = cache.count()
    assert before > 0
    page = (tmp_path / "rep" / "a.docx.report.html").read_text()
    assert "a.docx" in page and "total changes applied" in page and "<script" not in page
    stats = json.loads((tmp_path / "rep" / "b.docx.report.json").read_text())["stats"]
    assert stats["total_changes_applied"] == 1 and (tmp_path / "rep" / "b.docx.report.csv").read_text().startswith("file_name,section_name")
    assert spark.read.json(f"file://{tmp_path}/rep/report.json").count() == 2
    with caplog.at_level("INFO", "proofline"):
        main([*args[:2], "--output", str(tmp_path / "out2"), *args[4:], "--cache", str(tmp_path / "out" / "cache.parquet")])
    assert "0 texts corrected anew" in caplog.text and S.read_cache(spark, f"file://{tmp_path}/out/cache.parquet").count() == before
    assert [p["text"] for p in docx.parse((tmp_path / "out2" / "a.docx").read_bytes())] == ["Hôm nay trời đẹp.", "", "toi di học."]


def test_hybrid_mode_in_a_run(spark, tmp_path):
    from proofline.__main__ import main

    written(tmp_path / "in", "a.docx", ["Hôm nay trờy rất đẹp.", "trời trời đẹp"])
    (tmp_path / "vocab.txt").write_text("hôm\nnay\ntrời\nrất\nđẹp\n")
    main(["--input", str(tmp_path / "in" / "a.docx"), "--output", str(tmp_path / "out"), "--experimental", "--vocabulary", str(tmp_path / "vocab.txt")])
    assert [p["text"] for p in docx.parse((tmp_path / "out" / "a.docx").read_bytes())] == ["Hôm nay trời rất đẹp.", "trời trời đẹp"]
    with pytest.raises(SystemExit):
        main(["--input", "x", "--output", "y", "--experimental"])


def test_an_evaluation_of_documents(spark, tmp_path):
    from proofline.__main__ import main

    written(tmp_path, "in.docx", ["Hom nay troi dep.", "google la hay", "toi di hok"])
    written(tmp_path, "exp.docx", ["Hôm nay trời đẹp.", "google la hay", "toi di học"])
    written(tmp_path, "act.docx", ["Hôm nay troi đẹp.", "google la hay lam", "toi di hoc"])
    review = [{"edit_id": str(i), "document_id": "in.docx", "paragraph_id": i, "original_text": f"a|{i}", "corrected_text": "b", "status": "Rejected" if i < 7 else "Applied", "reason": "x", "edit_ratio": 0.0, "length_delta_ratio": 0.0, "confidence": 0.0, "timestamp": ""} for i in range(10)]
    (tmp_path / "review.json").write_text(json.dumps(review))
    main(["evaluate", *[x for k, n in (("input", "in"), ("expected", "exp"), ("actual", "act")) for x in (f"--{k}", str(tmp_path / f"{n}.docx"))], "--review", str(tmp_path / "review.json"), "--output", str(tmp_path / "out")])
    text = (tmp_path / "out" / "evaluation.md").read_text()
    # Expected: Hom > Hôm (met), troi dep. > trời đẹp. and hok > học (met by another text); lam is one too many. đ is no accent.
    assert "| diacritics | 1 | 0 | 0 | 1.00 | 1.00 | 1.00 |" in text and "| spelling | 0 | 3 | 0 | 0.00 | 0.00 | 0.00 |" in text
    assert "7 were refused (70.00 %)" in text and text.count("| b | x |") == 5 and "Names spelled another way: 1." in text
    assert "## Samples: TP" in text and "| Hom | Hôm | Hôm |" in text


def test_training_and_sweeps(spark, tmp_path):
    from proofline.__main__ import main
    from proofline.operators.correct import DecodingSweep
    from proofline.operators.models import Seq2SeqCorrector, load_corrector
    from proofline.plans.evaluation import sweep

    names = "document_id,paragraph_id,edit_id,model_mode,original_text,corrected_text,user_suggested_text,user_label,status,reason,edit_ratio,length_delta_ratio,confidence,timestamp"
    rows = [f"d,{i},{i},hybrid,a,b,,{'Chuẩn' if i % 2 else 'Sai'},Applied,x,{0.1 if i % 2 else 0.5},0.1,0.9,t" for i in range(20)]
    (tmp_path / "f.csv").write_text("\n".join([names, *rows]))
    main(["train", "--feedback", str(tmp_path / "f.csv"), "--output", str(tmp_path / "out")])
    found = json.loads((tmp_path / "out" / "thresholds.json").read_text())
    assert found["rows"] == 20 and found["weights"]["edit_ratio"] < 0 and found["suggested"]["edit_ratio"] == pytest.approx(0.1) and [r["f1"] for r in found["report"]] == [1.0, 1.0]
    (tmp_path / "few.csv").write_text("\n".join([names, *rows[:4]]))
    with pytest.raises(SystemExit, match="10 labelled"):
        main(["train", "--feedback", str(tmp_path / "few.csv"), "--output", str(tmp_path / "out")])
    assert len({c.name for c in DecodingSweep(lambda s: load_corrector("some/model", decoding=s)).correctors()}) == 5 and Seq2SeqCorrector("m").decoding == {"num_beams": 2, "repetition_penalty": 1.05}
    written(tmp_path, "in.docx", ["Hom nay troi dep lam."])
    written(tmp_path, "exp.docx", ["Hôm nay trời dep lam."])
    paras = [docx.read_docx(spark, f"file://{tmp_path}/{n}.docx").withColumn("doc_id", F.lit("d")) for n in ("in", "exp")]
    got = sweep(*paras, [WordCorrector({"troi": "trời"}, "one"), WordCorrector({"troi": "trời", "hom": "hôm"}, "two")])
    assert [(r["corrector"], r["category"], r["tp"], r["fn"]) for r in got] == [("one", "diacritics", 1, 1), ("two", "diacritics", 2, 0)]


def test_a_model_behind_the_protocol(monkeypatch):
    import sys
    import types

    from proofline.operators.models import Seq2SeqCorrector

    class Batch(dict):
        def to(self, device):
            return self

    class Tokenizer:
        @classmethod
        def from_pretrained(cls, name):
            return cls()

        def __call__(self, texts, **kw):
            assert kw["max_length"] == 9
            return Batch(texts=texts)

        def batch_decode(self, out, skip_special_tokens):
            return out

    class Model(Tokenizer):
        def to(self, device):
            assert device == "cuda"
            return self

        def generate(self, texts, max_new_tokens, **kw):
            return [f"{t}:{kw['num_beams']}" for t in texts]

    monkeypatch.setitem(sys.modules, "torch", types.SimpleNamespace(cuda=types.SimpleNamespace(is_available=lambda: True)))
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(AutoTokenizer=Tokenizer, AutoModelForSeq2SeqLM=Model))
    assert Seq2SeqCorrector("m", 9, {"num_beams": 4}).correct(["a", "b"]) == ["a:4", "b:4"]
