import math

import duckdb
import numpy as np
import pytest

from quireflow.operators import learning, scoring
from quireflow.operators.consensus import pair_ratios, word_vote
from quireflow.plans import registry

TABLES = "consensus container_specs customer document_examples documents embeddings engine_performance engine_results engine_weights events lineitem mix_targets nation orders part pattern_matches region stations supplier table_cells".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, data, name):
    assert rows(registry.queries()[name](spark, data).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() >= 0


READINGS = "doc_id long, engine_ordinal int, engine_name string, text string, confidence double, errors array<string>"


def test_vote_golden_and_ties(spark):
    r = spark.createDataFrame([(1, 0, "a", "hello world", 0.9, []), (1, 1, "b", "hello word", 0.9, []), (2, 0, "a", None, 0.9, []), (3, 0, "a", "x", None, []), (4, 0, "a", "x", 0.9, ["failed"])], READINGS)
    got = word_vote(r).collect()
    assert [(x["doc_id"], x["consensus_text"]) for x in got] == [(1, "hello world")]
    assert word_vote(r.limit(0)).collect() == []


def test_ratio_depends_on_order(spark):
    r = spark.createDataFrame([(1, 0, "a", "tide", 0.9, []), (1, 1, "b", "diet", 0.9, [])], READINGS)
    assert [x["ratio"] for x in pair_ratios(r).collect()] == [0.25]


def test_error_types(spark):
    df = spark.createDataFrame([("", "x"), ("x", None), (None, ""), ("abc", "ab"), ("10O", "100"), ("a.b", "a b"), ("AB C", "ab c")], "e string, c string")
    kinds = [r[0] for r in df.select(learning.error_type(df.e, df.c)).collect()]
    assert kinds == ["missing_extraction", "false_positive", "both_empty", "length_mismatch", "character_substitution", "formatting_error", "content_difference"]


def test_greedy_match(spark):
    from quireflow.operators.feedback import greedy_box_match

    s = "doc_id long, {} int, x double, y double, w double, h double"
    words = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1.0, 0.0, 10.0, 10.0), (2, 0, 0.0, 0.0, 1.0, 1.0)], s.format("word_no"))
    regions = spark.createDataFrame([(1, 0, 0.5, 0.0, 10.0, 10.0), (1, 1, 90.0, 0.0, 10.0, 10.0)], s.format("region_no"))
    assert [(r["word_no"], r["region_no"]) for r in greedy_box_match(words, regions).collect()] == [(0, 0)]


def test_image_scores():
    flat, check = np.full((40, 40), 128, np.uint8), (np.indices((40, 40)).sum(0) % 2 * 255).astype(np.uint8)
    assert scoring.blur_score(flat) == (0.0, True, 0.0) and scoring.blur_score(check)[1:] == (False, 1.0)
    assert scoring.contrast_score(flat)[3] and not scoring.contrast_score(check)[3]


def test_stream(spark, data, tmp_path):
    from quireflow.streaming.performance import daily_stats, performance_stream

    spark.read.parquet(f"{data}/engine_performance.parquet").write.parquet(str(tmp_path / "in"))
    q = daily_stats(performance_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("daily").groupBy().sum("uses").first()[0] == spark.read.parquet(f"{data}/engine_performance.parquet").select("id").distinct().count()


def test_sources(spark, tmp_path):
    from quireflow.sources import scan

    (tmp_path / "a.png").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    scan.register("length", 0, lambda content, path: {"text": str(len(content)), "confidence": 1.0})
    scan.register("broken", 1, lambda content, path: 1 / 0)
    got = scan.recognise(scan.files(spark, str(tmp_path)), ["length", "broken"]).orderBy("engine_ordinal").collect()
    assert [(r["text"], r["errors"]) for r in got] == [("3", []), ("", ["division by zero"])]
    pages = spark.createDataFrame([(1, "a", 2, "two", 0.0, None), (1, "a", 1, "one", 0.5, None)], "doc_id int, engine_name string, page_no int, text string, confidence double, words array<struct<text:string,confidence:double,bbox:struct<x:double,y:double,w:double,h:double>>>")
    merged = scan.merge_pages(pages).first()
    assert merged["text"] == "one" + scan.PAGE_BREAK + "two" and merged["confidence"] == 0.5


def test_greedy_match_on_the_tables(spark, data):
    from quireflow.plans.review import greedy_box_match

    rows = greedy_box_match(spark, data).collect()
    assert rows and all(0.5 < r["iou"] <= 1 for r in rows) and any(r["iou"] < 0.999 for r in rows) and any(r["word_no"] != r["region_no"] for r in rows)
    assert len({(r["doc_id"], r["word_no"]) for r in rows}) == len({(r["doc_id"], r["region_no"]) for r in rows}) == len(rows)
