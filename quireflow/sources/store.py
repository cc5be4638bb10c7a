"""The learning store: append-only tables in one folder, written and read as parquet."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the store's tables; every row also gets an id and created_at.
TABLES = {
    "document_examples": "document_id string, file_path string, patterns_json string, text_content string, features_json string, user_label string, document_type string",
    "extraction_patterns": "pattern_name string, pattern_regex string, pattern_type string, document_type string, confidence_score double",
    "field_rules": "field_name string, extraction_rule string, document_type string, validation_pattern string",
    "user_corrections": "document_id string, field_name string, extracted_value string, correct_value string, correction_type string, engine_name string, original_confidence double, bbox struct<x:double,y:double,w:double,h:double>",
    "engine_performance": "engine_name string, document_type string, accuracy_score double, confidence_score double, processing_time double, document_id string",
    "learning_metrics": "metric_type string, metric_value double, metadata map<string,string>",
    "document_classifications": "document_id string, user_label string",
    "rule_outcomes": "rule_id string, success boolean",
}


class LearningStore:
    """Tables of what was learned. Rows are only appended: counters and means follow from outcome rows when read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def schema(self, table: str) -> str:
        return f"id string, created_at timestamp, {TABLES[table]}"

    def read(self, table: str) -> DataFrame:
        """All rows of a table, none if nothing was stored yet."""
        path = f"{self.folder}/{table}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(path)

    def append(self, table: str, rows: DataFrame) -> None:
        """Stores rows of a DataFrame; missing columns are null, other columns are left out, id and created_at are made where missing."""
        wanted = self.spark.createDataFrame([], self.schema(table)).schema
        made = {"id": F.expr("uuid()"), "created_at": F.current_timestamp()}
        have = set(rows.columns)
        columns = [(F.coalesce(F.col(f.name), made[f.name]) if f.name in have else made[f.name]) if f.name in made else F.col(f.name) if f.name in have else F.lit(None) for f in wanted]
        rows.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, wanted)]).write.mode("append").parquet(f"{self.folder}/{table}")

    def add(self, table: str, **values) -> str:
        """Stores one row and gives its id."""
        key = str(uuid.uuid4())
        schema = self.spark.createDataFrame([], self.schema(table)).schema
        unknown = set(values) - set(schema.fieldNames())
        if unknown:
            raise ValueError(f"{table} has no {sorted(unknown)}")
        row = {"id": key, "created_at": dt.datetime.now(dt.UTC).replace(tzinfo=None), **values}
        self.append(table, self.spark.createDataFrame([tuple(row.get(n) for n in schema.fieldNames())], schema))
        return key

    def add_rule(self, field_name: str, pattern: str, document_type: str | None = None, validation_pattern: str | None = None) -> str:
        """Stores an extraction rule whose pattern is a regular expression; raises re.error for any other."""
        re.compile(pattern)
        return self.add("field_rules", field_name=field_name, extraction_rule=pattern, document_type=document_type, validation_pattern=validation_pattern)

    def rules(self) -> DataFrame:
        """Rules with usage_count and success_rate from their outcomes; unused ones have 0 and null."""
        used = self.read("rule_outcomes").groupBy("rule_id").agg(F.count("*").alias("usage_count"), F.avg(F.col("success").cast("int")).alias("success_rate"))
        rules = self.read("field_rules")
        return rules.join(used, rules["id"] == used["rule_id"], "left").drop("rule_id").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))

    def label(self, document_id: str, user_label: str) -> str:
        return self.add("document_classifications", document_id=document_id, user_label=user_label)

    def keep(self, table: str, now: str, days: int = 90) -> DataFrame:
        """The rows of a table not older than so many days: what a clean-up keeps."""
        return self.read(table).filter(F.col("created_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))
