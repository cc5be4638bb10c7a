"""Queries of the two general problems: packed fields and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators.multivalue import split_cells, split_table_lines
from quireflow.operators.timestamps import normalize_timestamps
from quireflow.session import load


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of table lines and packed cells (TESTDATA.md, problem 4)."""
    cells = load(spark, sf_dir, "table_cells").select("cell_id", "doc_id", "table_idx", "row_idx", "col_idx", "text")
    heads = cells.filter("row_idx = 0").select("doc_id", "table_idx", "col_idx", F.col("text").alias("kind"))
    body = cells.filter("row_idx > 0").join(heads, ["doc_id", "table_idx", "col_idx"]).select("cell_id", "text", "kind")
    packed = split_cells(body, "text", "kind").select("cell_id", F.explode("items").alias("i"))
    of_cells = packed.select(F.lit("table_cells").alias("rec_table"), F.col("cell_id").alias("rec_id"), F.lit(0).alias("line_no"), "i.item_pos", "i.item_value")
    readings = load(spark, sf_dir, "engine_results").select("result_id", "read_at", "lines")
    found = split_table_lines(readings, "lines").filter(F.size("items") > 0)
    once = found.groupBy("result_id").agg(F.min_by("items", "read_at").alias("items")).select("result_id", F.explode("items").alias("i"))
    of_lines = once.select(F.lit("engine_results").alias("rec_table"), F.col("result_id").alias("rec_id"), "i.line_no", "i.item_pos", "i.item_value")
    return of_lines.unionByName(of_cells)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match ids whose date text denotes exactly one moment (TESTDATA.md, problem 5)."""
    matches = load(spark, sf_dir, "pattern_matches").filter(F.col("pattern").startswith("date_")).select("match_id", "station_id", "pattern", "value", "detected_at")
    zones = load(spark, sf_dir, "stations").select("station_id", "zone_name")
    located = matches.join(zones, "station_id", "left")
    exact = normalize_timestamps(located, "value", "pattern", "zone_name").filter("moment_status = 'exact'")
    return exact.groupBy("match_id").agg(F.min_by("epoch_us", "detected_at").alias("epoch_us"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found}
