"""Steps whose cost must not grow faster than their input, and odd texts against the queries' SQL."""

import re

import pytest
from pyspark.sql import functions as F

from proofline.functions import edits as E
from proofline.functions import text as T
from proofline.functions.arrays import bound, running
from proofline.functions.segment import word_chunks
from proofline.operators.correct import restored_case
from proofline.plans import inputs as I
from proofline.plans.queries import ORACLES, QUERIES

#: Blank lines, white space outside and doubled inside, a final line break, one word, none.
ODD = ["a  b the  Les\n\n x y \n the dog\tran ", "", " ", "one", "Les chats\nthe ENDE. The ", "x " * 300 + "\n"]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def by_sql(name, d):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet/*.parquet')")
    got = c.execute(ORACLES[name])
    return [x[0] for x in got.description], got.fetchall()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same(spark, d, name):
    names, want = by_sql(name, d)
    assert sorted(map(tuple, QUERIES[name](spark, d).select(*names).collect()), key=str) == sorted(want, key=str)


def test_placed_edits_carry_no_text_by_word(spark, odd):
    assert "Window" not in plan(I.placed_edits(spark, odd)) and "Window" not in plan(I.placed_paragraphs(spark, odd))
    got = {(r["doc_id"], r["edit_no"]): (r["orig_start"], r["orig_end"], r["orig_text"]) for r in I.placed_edits(spark, odd).collect()}
    want = {}
    for k, t in enumerate(ODD):
        at, ws = 0, []
        for w in re.split("[ \n]", t):
            ws.append((at, at + len(w)))
            at += len(w) + 1
        want |= {(k, i): (ws[i][0], ws[i + 1][1], t[ws[i][0] : ws[i + 1][1]]) for i in range(0, len(ws) - 1, 5)}
    assert got == want


@pytest.mark.parametrize("name", ["edit_to_paragraph", "report_changes", "review_edits", "edit_to_run"])
def test_places_on_odd_texts(spark, odd, name):
    same(spark, odd, name)


@pytest.mark.parametrize("name", ["apply_edits", "whitespace_restore", "correct_chunks", "cache_lookup", "capitalization_restore", "overlap_guard"])
def test_paragraphs_on_odd_texts(spark, odd, name):
    same(spark, odd, name)


def test_case_of_words_in_their_places():
    old, new = "İstanbul The THE tHe " + "The dog THE Cat " * 200, "İstanbul the thé thé " + "thé dog thé cat " * 200
    assert restored_case(old, new) == "İstanbul The THÉ thé " + "Thé dog THÉ Cat " * 200
    assert restored_case("A b, C", "a b c") == "A b C" and restored_case("Ha ⅷ NOI", "hà ⅷ nội") == "Hà ⅷ NỘI"


def test_case_takes_no_alignment_where_words_stand_in_their_places(monkeypatch):
    monkeypatch.setattr("proofline.operators.correct._source_places", None)
    assert restored_case("The Dog", "the dog") == "The Dog"


def test_pieces_are_cut_before_they_are_rows(spark, odd):
    assert not re.search(r"explode\w*\(sequence", plan(I.pairs(spark, odd)))


@pytest.mark.parametrize("name", ["safe_edit", "category_breakdown", "edit_word_ratio", "change_stats", "confidence_score"])
def test_pairs_on_odd_texts(spark, odd, name):
    same(spark, odd, name)


def test_documents_of_any_size_are_dealt_by_their_id(spark, odd):
    assert "RepartitionByExpression [doc_id" in plan(I.documents(spark, odd))
    assert "RepartitionByExpression [doc_id" in plan(I.spread(I.table(spark, odd, "documents").crossJoin(spark.range(10**7)), "doc_id"))


def analyzed(spark, column):
    return spark.range(1).select(F.lit("a b").alias("t"), F.array(F.lit(1)).alias("n")).select(column.alias("v"))._jdf.queryExecution().analyzed().toString()


def test_lambdas_do_not_compute_their_source_again(spark):
    assert analyzed(spark, word_chunks("t", 2)).count("regexp_extract_all") == 1
    assert analyzed(spark, running(F.transform("n", lambda x: x + 1))).count("+ 1)") == 1
    assert spark.range(1).select(bound(F.lit(2), lambda x: x + x, lambda x: x * x).alias("v")).first()["v"] == 16


def test_composition_passes_low_characters_at_once():
    assert T._MAY_CHANGE.startswith(r"[\x{300}-")


def test_names_are_looked_for_once(spark):
    df = spark.createDataFrame([("at Google now", "at Gogle now"), ("cần thơ", "x"), ("apple", "Apple"), ("none", "x"), ("", "")], "a string, b string")
    assert [r["v"] for r in df.select(E.lexicon_violation("a", "b", ("Google", "Cần Thơ", "Apple")).alias("v")).collect()] == [True, True, False, False, False]
    assert "lower(a" not in analyzed(spark, E.lexicon_violation("t", "t", ()))


def test_rows_of_a_union_are_dealt_by_their_paragraph(spark, odd):
    """Whatever partitions adaptive execution makes of either side."""
    assert plan(QUERIES["apply_edits"](spark, odd)).count("RepartitionByExpression [doc_id#") >= 2
    got = QUERIES["apply_edits"](spark, odd)
    assert got.count() == got.select("doc_id", "para_idx").distinct().count() == 7


def test_paragraphs_without_edits_are_not_taken_apart(spark):
    from proofline.operators import apply as A
    from proofline.schemas import RUN

    none = (None,) * 8
    data = [(1, [(0, "ab", *none), (1, "", *none)], []), (2, None, []), (3, [(0, "ab", *none)], [(0, "replace", 0, 1, "a", "x")]), (4, [], [(0, "replace", 0, 1, "a", "x")])]
    df = spark.createDataFrame(data, f"k int, runs array<{RUN}>, edits array<struct<edit_no:int,type:string,local_start:int,local_end:int,orig_text:string,corr_text:string>>")
    out = A.apply_edits(df, ["k"])
    assert {r["k"]: [x["text"] for x in r["runs_out"]] for r in out.collect()} == {1: ["ab", ""], 2: [], 3: ["", "x", "b"], 4: []}
    assert {r["k"]: len(r["results"]) for r in out.collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    assert "size(edits" in plan(out)
