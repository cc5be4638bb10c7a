import numpy as np
import pytest

from quireflow.operators import boxes, consensus, engine_output as eo, feedback, learning, scoring, structures as st
from quireflow.sources.store import LearningStore
from pyspark.sql import functions as F

READ = "doc_id long, engine_ordinal int, engine_name string, text string, confidence double, errors array<string>, processing_time double"
ITEM = "array<struct<text:string,confidence:double,bbox:struct<x:double,y:double,w:double,h:double>>>"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return df.select(column.alias("r")).first()["r"]


def test_consensus_of_documents(spark):
    rows = [(1, 0, "a", "one reading", 0.9, [], 1.0), (2, 0, "a", "nearly the same text here", 0.8, [], 1.0), (2, 1, "b", "nearly the same text hero", 0.9, [], 3.0), (3, 0, "a", "alpha beta gamma", 0.5, [], 1.0), (3, 1, "b", "totally other words", 0.6, [], 1.0), (4, 0, "a", "", 0.9, [], 1.0), (5, 0, "a", None, None, None, None)]
    docs = spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id long")
    weights = spark.createDataFrame([("a", 1.2), ("b", 1.0)], "engine_name string, weight double")
    got = {r["doc_id"]: r for r in consensus.consensus_documents(docs, spark.createDataFrame(rows, READ), weights).collect()}
    assert [got[i]["method"] for i in range(1, 7)] == ["single_engine", "high_similarity_best_confidence", "hybrid_consensus", "none", "none", "none"]
    assert got[2]["consensus_text"] == "nearly the same text here" and got[2]["primary_engine"] == "a" and got[2]["mean_time"] == 2.0
    assert got[1]["agreement_score"] == 1.0 and got[3]["consensus_text"] == "alpha beta gamma"  # 0.5 * 1.2 against 0.6: a tie goes to the first engine
    assert got[6]["status"] == "no_valid_results" and got[6]["consensus_text"] is None and got[6]["confidence"] == 0.0
    plain = {r["doc_id"]: r["method"] for r in consensus.consensus_documents(docs, spark.createDataFrame(rows, READ)).collect()}
    assert plain[2] == "high_similarity_highest_confidence" and plain[3] == "word_voting"
    assert consensus.consensus_documents(docs.limit(0), spark.createDataFrame([], READ), weights).collect() == []


def test_pairs_of_keys_and_values():
    for text, want in (("Name: Ann Lee", ("Name", "Ann Lee", ":", 0, 13)), ("Total = 12.50", ("Total", "12.50", "=", 0, 13)), ("City - Dale", ("City", "Dale", "-", 0, 11)), ("Phone   555", ("Phone", "555", "tab", 0, 11))):
        assert st.pairs(text) == [want]
    # a key may begin on the line before; of overlapping pairs the first by start stays
    assert st.pairs("Name: Ann Lee\nTotal = 12.50") == [("Name", "Ann Lee", ":", 0, 13)]
    assert st.pairs("") == [] and st.pairs("a: b") == [] and st.pairs("a b c d e f g hi: x") == []
    assert len(st.pairs("Name: x\n" * 3000)) == 3000


def test_structures_of_edges(spark):
    rows = [(1, "Invoice\n\nTotal: $12.00\nName: ____\n[x] paid\n12 Elm Street, Dale\nPO Box 7"), (1, "Total: 5"), (2, None), (3, ""), (4, "x" * 60_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "id int, text string, key string")
    kv = st.key_values(df.drop("key"), "text", ["id"])
    assert {(r["key"], r["value"]) for r in kv.collect()} == {("Invoice\n\nTotal", "$12.00"), ("Name", "____"), ("Total", "5")}
    fields = st.form_fields(kv, spark.createDataFrame([(1, True)], "id int, checked boolean"), ["id"]).collect()
    assert {(r["field_name"], r["has_value"], r["field_value"]) for r in fields} == {("Name", False, ""), ("Total", False, ""), ("checkbox", None, "checked")}
    assert {r["address_type"] for r in st.addresses(df, "text", ["id"]).collect()} == {"us_address", "po_box"}
    none = spark.createDataFrame([], "id int, tables bigint")
    counts = {r["id"]: r for r in st.structure_counts(df.filter("id > 1"), "text", "id", none, spark.createDataFrame([], "id int, pattern string")).collect()}
    assert set(counts) == {3, 4} and counts[3]["forms"] == 0


def test_types_and_labels(spark):
    text = "Schedule B of form 1040 from Acme Data inc for 2019: a return and an application"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["labels"] for r in feedback.labels(df, "text", "id").collect()}
    assert got[1].split("; ")[:2] == ["form_document_1040_2019", "form_document_1040"] and "document_from_acme_data" in got[1] and got[2] == "" and 3 not in got


def test_corrections(spark):
    rows = [("total_amount", "1.50", "1,50$", 0.9), ("date", "01/02/2020", "01-02-2020", 0.6), ("phone", "555-123-4567", "(555) 123-4567", None), (None, None, None, None), ("x", "rn", "mm", 0.1), ("x", "a.b", "a b", 0.1), ("x", "vv", "ww", 0.1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "field_name string, extracted_value string, correct_value string, original_confidence double, error_type int")
    got = feedback.analyse_corrections(df).collect()
    assert [r["error_type"] for r in got] == ["length_mismatch", "content_difference", "length_mismatch", "both_empty", "character_substitution", "formatting_error", "character_substitution"]
    assert [r["issues"] for r in got[:3]] == ["currency_separator", "date_separator", "phone_formatting"]
    assert [r["details"] for r in got[:4]] == ["decimal_separator_issue,currency_symbol_missing", "separator_issue,format_issue", "digits_match,formatting_only", ""]
    assert [r["confidence_impact"] for r in got[:5]] == [0.2, 0.1, 0.05, 0.05, 0.05] and [r["affected_documents"] for r in got[4:]] == [5, 5, 5]
    assert feedback.generalised("AB-12") == r"[a-zA-Z]{2}\-\d{2}" and feedback.generalised("$1,200.00") == r"\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?" and feedback.generalised("") == ""


def test_engine_output(spark):
    words = [("b", 0.8, (30.0, 12.0, 10.0, 8.0)), ("a", 0.6, (5.0, 10.0, 20.0, 8.0)), ("c", None, (5.0, 21.0, 5.0, 8.0)), ("d", 0.5, None)]
    lines = one(spark, eo.group_lines(F.col("w")), w=(words, ITEM))
    assert [(x["text"], x["words"], x["x"], x["w"]) for x in lines] == [("a b", 2, 5.0, 35.0), ("c", 1, 5.0, 5.0)]
    assert one(spark, eo.group_lines(F.col("w")), w=([], ITEM)) == []
    # the anchor is the first word of a line: steps of 6 leave it although each is near the one before
    steps = [(str(i), 1.0, (0.0, 6.0 * i, 1.0, 1.0)) for i in range(4)]
    assert [x["text"] for x in one(spark, eo.group_lines(F.col("w")), w=(steps, ITEM))] == ["0 1", "2 3"]
    halves = one(spark, eo.split_line(F.lit("ab cd"), F.lit(0.5), F.struct(F.lit(10.0).alias("x"), F.lit(1.0).alias("y"), F.lit(8.0).alias("w"), F.lit(2.0).alias("h"))), z=(1, "int"))
    assert [(w["text"], w["bbox"]["x"], w["bbox"]["w"]) for w in halves] == [("ab", 10.0, 4.0), ("cd", 14.0, 4.0)]
    kept = one(spark, eo.read_lines(F.col("l")), l=([("x", 0.4, None), ("y", None, None), ("z", 0.6, (1.0, 1.0, 1.0, 1.0))], ITEM))
    assert [(k["text"], k["confidence"], k["bbox"]["y"]) for k in kept] == [("y", 0.95, 20.0), ("z", 0.6, 1.0)]
    raw = [(5, "hi", 90.0, 1.0, 2.0, 3.0, 4.0), (5, " ", 90.0, 0.0, 0.0, 0.0, 0.0), (5, "no", -1.0, 0.0, 0.0, 0.0, 0.0), (4, "line", 80.0, 0.0, 0.0, 0.0, 0.0)]
    rows = one(spark, eo.parse_rows(5, F.col("r")), r=(raw, "array<struct<level:int,text:string,conf:double,left:double,top:double,width:double,height:double>>"))
    assert [(r["text"], r["confidence"], r["bbox"]["h"]) for r in rows] == [("hi", 0.9, 4.0)]
    assert one(spark, eo.polygon_box(F.col("p")), p=([[1.5, 2.5], [9.5, 2.0], [9.0, 7.9]], "array<array<double>>")).asDict() == {"x": 1.0, "y": 2.0, "w": 8.0, "h": 5.0}
    assert one(spark, eo.polygon_box(F.col("p")), p=([], "array<array<double>>"))["w"] == 0.0
    assert one(spark, eo.strip_tags(F.lit("<table><tr><td>a</td>\n<td> b</td></tr>")), z=(1, "int")) == "a b"
    assert one(spark, eo.config_string(F.lit("single_block"), F.lit("7x"), F.lit("0123"), F.lit("")), z=(1, "int")) == "--psm 6 --oem 3 -c tessedit_char_whitelist=0123"
    assert [one(spark, eo.page_mode_for(F.lit(t), F.lit(d)), z=(1, "int")) for t, d in ((True, 0.5), (True, 0.01), (False, 0.5))] == [6, 11, 3]
    assert one(spark, eo.model_for(F.lit("Tax form")), z=(1, "int")) == "large_printed" and round(one(spark, eo.beam_confidence(F.lit(-1.0)), z=(1, "int")), 3) == 0.368


def test_boxes(spark):
    b = "key int, x double, y double, w double, h double"
    merged = boxes.merge_regions(spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 2.0, 0.0, 10.0, 10.0), (1, 50.0, 0.0, 5.0, 5.0), (2, 0.0, 0.0, 1.0, 1.0)], b), "key").collect()
    assert sorted((r["key"], r["x"], r["w"]) for r in merged) == [(1, 0.0, 12.0), (1, 50.0, 5.0), (2, 0.0, 1.0)]
    words = spark.createDataFrame([(1, i) for i in range(4)], "doc_id long, word_no int")
    scores = boxes.match_scores(words, words.limit(2), spark.createDataFrame([(1, 0, 0, 0.8)], "doc_id long, word_no int, region_no int, iou double")).first()
    assert (scores["precision"], scores["recall"], round(scores["f1"], 6)) == (0.25, 0.5, 0.333333)
    r = spark.createDataFrame([(1, 0, [("total", 0.9, (0.0, 0.0, 10.0, 10.0)), ("x", 0.9, (500.0, 0.0, 10.0, 10.0))]), (1, 1, [("Total", 0.9, (1.0, 0.0, 10.0, 10.0))])], f"doc_id long, engine_ordinal int, words {ITEM}")
    assert [(x["ord_a"], x["ord_b"], x["consistency"]) for x in boxes.word_consistency(r).collect()] == [(0, 1, 0.5)]
    golden = one(spark, boxes.visual_confidence(F.lit(0.7759), F.lit(0.9), F.lit(0.0)), z=(1, "int"))
    assert round(golden, 4) == 0.5928
    assert one(spark, boxes.layout_confidence(F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double")), z=(1, "int")) == 0.5
    assert one(spark, boxes.orientation(F.lit(10), F.lit(20)), z=(1, "int")) == "portrait" and one(spark, boxes.ruled_table(F.lit(3), F.lit(3)), z=(1, "int")) == 0.7


def test_images(spark):
    flat, rng = np.full((40, 40), 128, np.uint8), np.random.default_rng(1)
    assert scoring.noise_score(flat) == (0.0, False, 1.0) and scoring.noise_score(rng.integers(0, 256, (40, 40)).astype(np.uint8))[1]
    files = spark.createDataFrame([("a", bytes(1600)), ("bad", b"x")], "path string, content binary")
    got = {r["path"]: r for r in scoring.image_metrics(files, lambda b: np.frombuffer(b, np.uint8).reshape(40, 40)).collect()}
    assert got["a"]["noise"] == 1.0 and got["a"]["width"] == 40.0 and got["bad"]["blur"] is None
    advice = one(spark, scoring.image_advice(F.lit(True), F.lit(False), F.lit(True), F.lit(100.0), F.lit(3.0), F.lit(0.4), F.lit(0.9)), z=(1, "int"))
    assert len(advice["recommendations"]) == 5 and advice["steps"] == ["contrast_enhancement", "deskewing"] and advice["engines"].startswith("tesseract")


def test_store(spark, tmp_path):
    store = LearningStore(spark, f"file://{tmp_path}/store")
    assert store.read("field_rules").count() == 0
    rule = store.add_rule("total", r"\d+\.\d\d", "invoice")
    store.add_rule("total", r"\d+")
    with pytest.raises(Exception):
        store.add_rule("x", "(")
    for ok in (True, True, False):
        store.add("rule_outcomes", rule_id=rule, success=ok)
    rules = learning.field_rules(store.rules(), "total").collect()
    assert [(r["id"] == rule, r["usage_count"]) for r in rules] == [(True, 3), (False, 0)] and round(rules[0]["success_rate"], 3) == 0.667
    store.append("user_corrections", spark.createDataFrame([("d1", "total", 1), ("d2", None, 2)], "document_id string, field_name string, other int"))
    fixed = store.read("user_corrections")
    assert fixed.count() == 2 and fixed.filter("id is null or created_at is null").count() == 0
    assert learning.corrections_since(fixed, "2000-01-01 00:00:00", field="total").count() == 1 and store.keep("user_corrections", "2000-01-01").count() == 2
    store.label("d1", "invoice")
    with pytest.raises(ValueError):
        store.add("engine_performance", nothing=1)
