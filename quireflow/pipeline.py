"""From scanned files to one result a document: pages, recognition, fusion, structures, types, stored as JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import consensus, feedback, patterns, scoring, structures
from quireflow.sources import scan


def split_pages(scans: DataFrame, render: Callable[[bytes, str], list[bytes]]) -> DataFrame:
    """path, page_no (from 1), content: the pages of every file; render gives those of one file, a plain image is one page.

    A file that can't be rendered gives one page with its own content.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    parts = render(bytes(content), path) or [bytes(content)]
                except Exception:
                    parts = [bytes(content)]
                yield pd.DataFrame([(path, i, p) for i, p in enumerate(parts, 1)], columns=["path", "page_no", "content"])

    return scans.select("path", "content").mapInPandas(pages, "path string, page_no int, content binary")


def readings_of(recognised: DataFrame) -> DataFrame:
    """Recognised files as readings: the document's id is a hash of its path, the same in every run."""
    return recognised.withColumn("doc_id", F.sha2("path", 256))


def apply_rules(fields: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Fields (key, field, value, document_type) with the value that the best fitting rule takes out of them.

    Rules (field_name, document_type, extraction_rule, success_rate, usage_count) apply to their field and type, a null
    type to all; the first by success and use whose pattern changes the value wins. Other fields keep their value.
    """
    r = rules.select(F.lower("field_name").alias("r_field"), F.col("document_type").alias("r_type"), "extraction_rule", "success_rate", "usage_count")
    met = fields.join(r, (F.lower("field") == F.col("r_field")) & (F.col("r_type").isNull() | (F.col("r_type") == F.col("document_type"))))
    taken = met.withColumn("new", F.regexp_substr("value", F.col("extraction_rule"))).filter("new is not null and new <> value")
    best = F.max_by("new", F.struct(F.coalesce("success_rate", F.lit(0.0)), F.coalesce("usage_count", F.lit(0)), "extraction_rule")).alias("new")
    won = taken.groupBy(key, "field").agg(best)
    return fields.join(won, [key, "field"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")


def document_results(readings: DataFrame, weights: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """One row a document: document_id, path, status, consensus, text_variations, confidence_scores, fields, structure, types, indicators.

    readings is what readings_of gives. A document no engine could read has the status no_valid_results and empty parts;
    the errors of its engines are in errors.
    """
    docs = readings.select("doc_id", "path").distinct()
    fused = consensus.consensus_documents(docs, readings, weights)
    read = readings.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("engine_name", "text"))).alias("text_variations"), F.map_from_entries(F.collect_list(F.struct("engine_name", "confidence"))).alias("confidence_scores"),
        F.flatten(F.collect_list(F.coalesce("errors", F.array().cast("array<string>")))).alias("errors"),
    )
    texts = fused.filter("consensus_text is not null").select("doc_id", "consensus_text")
    matches = patterns.pattern_matches(texts, "consensus_text", ["doc_id"], [*patterns.NUMBER_CATEGORY, *structures.DATE_PATTERNS])
    lines = readings.filter("lines is not null").select(F.concat_ws("|", "doc_id", "engine_name").alias("result_id"), "doc_id", "lines")
    tables = structures.table_structures(lines).join(lines.select("result_id", "doc_id"), "result_id").groupBy("doc_id", "result_id").count().groupBy("doc_id").agg(F.max("count").alias("tables"))
    counts = structures.structure_counts(texts, "consensus_text", "doc_id", tables, matches)
    signatures = scoring.keyword_signatures(texts, "consensus_text", "doc_id").withColumnRenamed("doc_id", "doc")
    found = feedback.discovered_types(signatures, counts.withColumnRenamed("doc_id", "doc"))
    types = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("confidence", "type")), asc=False).alias("types")).withColumnRenamed("doc", "doc_id")
    fields = structures.structured_fields(structures.key_values(texts, "consensus_text", ["doc_id"]), "doc_id")
    if rules is not None:
        typed = fields.join(types.select("doc_id", F.try_element_at("types", F.lit(1))["type"].alias("document_type")), "doc_id", "left")
        fields = apply_rules(typed, rules, "doc_id")
    fields = fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("field", "value", "field_kind", "confidence"))).alias("fields"))
    kinds = [c for c in counts.columns if c != "doc_id"]
    parts = counts.select("doc_id", F.struct(*kinds).alias("structure"), sum((F.col(k) for k in ("key_values", "tables", "lists", "sections", "forms", "dates", "addresses")), F.lit(0)).alias("n"))
    j = docs.join(fused, "doc_id").join(read, "doc_id").join(parts, "doc_id", "left").join(types, "doc_id", "left").join(fields, "doc_id", "left")
    summary = F.struct("consensus_text", "method", "confidence", "agreement_score", "agreement_level", "engines", "primary_engine")
    best = F.coalesce(F.try_element_at("types", F.lit(1))["type"], F.lit("unknown_document"))
    return j.select(
        F.col("doc_id").alias("document_id"), "path", "status", summary.alias("consensus"), "text_variations", "confidence_scores", "errors", "fields", "structure", best.alias("document_type"), "types",
        feedback.quality_indicators(F.coalesce("agreement_score", F.lit(0.0)), F.col("confidence"), F.coalesce("n", F.lit(0))).alias("indicators"),
    )


def process_folder(spark: SparkSession, folder: str, output: str, engines: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Reads all files below a folder, writes a JSON object a document to output, and gives the number of documents by status."""
    results = document_results(readings_of(scan.recognise(scan.files(spark, folder), engines)), weights)
    scan.write_documents(results, output)
    return spark.read.schema("status string").json(output).groupBy("status").agg(F.count("*").alias("documents"))
