"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in "xywh"])
TOKENS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", BOX)]))
READING = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("engine_name", T.StringType()), T.StructField("engine_ordinal", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, TOKENS) for n in ("words", "lines", "paragraphs")]
    + [T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("processing_time", T.DoubleType())]
)
PERFORMANCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "engine_name", "document_type")]
    + [T.StructField(n, T.DoubleType()) for n in ("accuracy_score", "confidence_score", "processing_time")]
    + [T.StructField("document_id", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("received_at", T.TimestampType())]
)
