"""Queries of the problems of this subpackage (TESTDATA.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.addresses import link_addresses, same_place_pairs
from quireflow.llm.encoding import repair_encoding
from quireflow.llm.mixing import mix, tilted
from quireflow.llm.packing import pack
from quireflow.llm.privacy import find_personal, redact
from quireflow.llm.scannoise import find_scan_noise, repair_scans
from quireflow.llm.texttype import classify_texts
from quireflow.llm.tokens import token_count
from quireflow.session import load, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty texts of readings and examples that are not natural prose, with their kind."""
    readings = load(spark, sf_dir, "engine_results").select(F.lit("engine_results").alias("rec_table"), F.col("result_id").cast("string").alias("rec_key"), "text")
    examples = load(spark, sf_dir, "document_examples").select(F.lit("document_examples").alias("rec_table"), F.col("id").alias("rec_key"), F.col("text_content").alias("text"))
    kinds = classify_texts(readings.unionByName(examples), "text", keep_text=False).filter("text_kind <> 'prose'")
    return kinds.groupBy("rec_table", "rec_key").agg(F.min("text_kind").alias("text_kind"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a wrongly decoded passage."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return repair_encoding(docs, "text").filter("encoding_fix.garbled").select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with the restored text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    fixed = repair_encoding(docs, "text").filter("encoding_fix.garbled")
    return fixed.select("doc_id", F.col("encoding_fix.restored").alias("restored_text"), F.array_join("encoding_fix.chains", "; ").alias("chains"), "encoding_fix.lost")


def scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_table, rec_key, text) of readings, fused texts and examples."""
    readings = load(spark, sf_dir, "engine_results").select(F.lit("engine_results").alias("rec_table"), F.col("result_id").cast("string").alias("rec_key"), "text")
    fused = load(spark, sf_dir, "consensus").select(F.lit("consensus").alias("rec_table"), F.col("doc_id").cast("string").alias("rec_key"), F.col("consensus_text").alias("text"))
    examples = load(spark, sf_dir, "document_examples").select(F.lit("document_examples").alias("rec_table"), F.col("id").alias("rec_key"), F.col("text_content").alias("text"))
    return readings.unionByName(fused).unionByName(examples)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scanned texts with noise, by kind; redelivered readings count once."""
    return find_scan_noise(scanned_texts(spark, sf_dir), "text").distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned texts as continuous paragraphs; redelivered readings count once."""
    fixed = repair_scans(scanned_texts(spark, sf_dir), "text").filter("scan_repaired is not null")
    return fixed.groupBy("rec_table", "rec_key").agg(F.min("scan_repaired").alias("repaired_text"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pattern_matches").filter(F.col("pattern").isin("us_address", "po_box")).select("match_id", "value")


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address row with the id of its place."""
    return link_addresses(_addresses(spark, sf_dir), "value").groupBy("match_id").agg(F.min("place_id").alias("place_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of address rows that name the same place."""
    return same_place_pairs(p3_places(spark, sf_dir), "match_id").select(F.col("a").alias("match_id_a"), F.col("b").alias("match_id_b"))


#: The secret of the pseudonyms in the registered queries; a user of redact brings an own one.
QUERY_KEY = "registered queries"


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = load(spark, sf_dir, "consensus").select(F.lit("consensus").alias("rec_table"), F.col("doc_id").cast("string").alias("rec_key"), F.col("consensus_text").alias("text"))
    examples = load(spark, sf_dir, "document_examples").select(F.lit("document_examples").alias("rec_table"), F.col("id").alias("rec_key"), F.col("text_content").alias("text"))
    return fused.unionByName(examples)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of persons and how to reach or identify them."""
    return find_personal(_personal_texts(spark, sf_dir), "text").drop("end_pos")


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with every mention replaced by a typed placeholder."""
    return redact(_personal_texts(spark, sf_dir), "text", QUERY_KEY).select("rec_table", "rec_key", F.col("pii_redacted").alias("redacted_text"))


def _sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    return written(docs, "sized-documents")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents assigned to containers of every capacity of container_specs."""
    return pack(_sized_documents(spark, sf_dir), "doc_id", "n_tokens", load(spark, sf_dir, "container_specs"), "container_kind", "capacity_tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and share of their capacity left unused, by kind."""
    boxes = p7_containers(spark, sf_dir).groupBy("container_kind", "container_id").agg(F.max("container_used").alias("used"))
    spec = load(spark, sf_dir, "container_specs")
    filled = boxes.join(spec, "container_kind").groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return filled.withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


#: The curriculum of the registered queries: where the rare sources are used more in the later part.
QUERY_SCHEDULE = {"microfiche": tilted(0.5), "courier_box": tilted(0.5), "field_tablet": [(0.0, 1.0), (0.6, 1.0), (1.0, 2.0)], "web_upload": tilted(-0.25)}


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix: documents in order of the progress at which they are due."""
    return mix(_sized_documents(spark, sf_dir), "doc_id", "source", "n_tokens", load(spark, sf_dir, "mix_targets"), QUERY_SCHEDULE)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mix(_sized_documents(spark, sf_dir), "doc_id", "source", "n_tokens", load(spark, sf_dir, "mix_targets"), QUERY_SCHEDULE)[1]


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p3_found": p3_found, "p3_places": p3_places, "p6_found": p6_found, "p6_redacted": p6_redacted, "p2_found": p2_found, "p2_repaired": p2_repaired, "p1_found": p1_found, "p9_found": p9_found, "p9_restored": p9_restored}
