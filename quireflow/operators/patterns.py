"""Finding named patterns, key-values, lists and sections in text with built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MATCH_FIELDS = ("pattern", "match_no", "value", "start_pos", "end_pos")

#: The named patterns; matching ignores case.
PATTERNS = {
    "currency": r"\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d+\.\d{2}",
    "date_mdy": r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    "date_dmy": r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    "date_ymd": r"\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    "date_text": r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}",
    "phone_us": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "phone_intl": r"\+\d{1,3}[-.\s]?\d{1,14}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ssn": r"\d{3}-\d{2}-\d{4}|\d{9}",
    "zip_us": r"\d{5}(?:-\d{4})?",
    "percentage": r"\d+(?:\.\d+)?%",
    "time": r"\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?",
    "url": r"https?://[^\s]+|www\.[^\s]+",
    "integer": r"\b\d+\b",
    "decimal": r"\b\d+\.\d+\b",
    "form_number": r"Form\s+\w+-?\w*|F\d{4}\w*",
    "account": r"(?:Account|Acct|A/C)[\s#:]*[\w-]+",
    "reference": r"(?:Ref|Reference|REF)[\s#:]*[\w-]+",
    "po_box": r"(?:P\.?O\.?\s*Box|Post\s*Office\s*Box)\s*\d+",
}
#: Category of a pattern among the numbers of a document.
NUMBER_CATEGORY = {
    "currency": "currencies", "percentage": "percentages", "phone_us": "phone_numbers", "phone_intl": "phone_numbers", "ssn": "ssns", "account": "account_numbers", "form_number": "form_numbers",
    "reference": "reference_numbers", "integer": "other", "decimal": "other",
}
NUMBERED = r"^\s*\d+[\.\)]\s+(.+)"
BULLETED = r"^\s*[•·▪▫◦‣⁃]\s+(.+)"
SECTIONS = (("all_caps", r"^[A-Z][A-Z\s]{2,50}$"), ("numbered", r"^\s*\d+\.?\s+[A-Z][A-Za-z\s]{2,50}$"), ("colon_end", r"^[A-Z][A-Za-z\s]{2,50}:$"), ("potential_underlined", r"^[A-Za-z\s]{3,50}$"))
CHECKBOX = (r"\[\s*[xX✓]\s*\]", r"\(\s*[xX✓]\s*\)", r"☐|☑|□|■|▢|▣", r"YES\s*/\s*NO")


def pattern_matches(df: DataFrame, text: str, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """Long table keys, pattern, match_no, value, start_pos, end_pos of all non-overlapping matches, case ignored.

    Spark has no find-all with offsets, so one Arrow pass over the texts runs all patterns; the time grows with the
    text and its matches. Null texts give no rows; classes like \\d are those of ASCII.
    """
    wanted = {n: re.compile(PATTERNS[n], re.IGNORECASE | re.ASCII) for n in names or PATTERNS}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], ([], [], [], [], [])
            for row, t in enumerate(b.column(0).to_pylist()):
                for name, p in wanted.items():
                    for k, m in enumerate(p.finditer(t)):
                        at.append(row)
                        for c, v in zip(cols, (name, k, m[0], m.start(), m.end())):
                            c.append(v)
            kept = b.take(pa.array(at, pa.int32())).columns[1:]
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(cols, types)]], [*keys, *MATCH_FIELDS])

    kinds = (T.StringType(), T.IntegerType(), T.StringType(), T.IntegerType(), T.IntegerType())
    schema = T.StructType([*df.select(*keys).schema.fields, *[T.StructField(n, k) for n, k in zip(MATCH_FIELDS, kinds)]])
    return df.filter(F.col(text).isNotNull()).select(text, *keys).mapInArrow(found, schema)


def number_categories(matches: DataFrame) -> DataFrame:
    """Counts of matches by document and number category."""
    table = F.create_map(*[F.lit(x) for kv in NUMBER_CATEGORY.items() for x in kv])
    return matches.withColumn("category", F.try_element_at(table, "pattern")).filter("category is not null").groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def parse_currency(value: Column) -> Column:
    """The amount of a currency text, 0 where it is none."""
    return F.coalesce(F.regexp_replace(value, r"[$,]", "").try_cast("double"), F.lit(0.0))


def _lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return df.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def lists(df: DataFrame, text: str, keys: list[str], include_trailing: bool = False) -> DataFrame:
    """Runs of two or more numbered (or bulleted) lines: keys, list_type, first_line, items.

    A run that ends with the last line counts only with include_trailing.
    """
    out = None
    for kind, p in (("numbered", NUMBERED), ("bulleted", BULLETED)):
        order = Window.partitionBy(*keys).orderBy("line_no")
        marked = _lines(df, text, keys).withColumn("hit", F.col("line").rlike(p)).withColumn("last_line", F.max("line_no").over(Window.partitionBy(*keys)))
        runs = marked.withColumn("run", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("hit")
        g = runs.groupBy(*keys, "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("end_line"), F.count("*").alias("items"), F.max("last_line").alias("last_line"))
        g = g.filter((F.col("items") >= 2) & (F.lit(include_trailing) | (F.col("end_line") < F.col("last_line")))).select(*keys, F.lit(kind).alias("list_type"), "first_line", "items")
        out = g if out is None else out.unionByName(g)
    return out


def sections(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Heading lines: keys, line_no, heading, section_type, underlined, confidence (0.9 with a rule below, else 0.7)."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    lines = _lines(df, text, keys).withColumn("next_line", F.trim(F.lead("line").over(order))).withColumn("heading", F.trim("line"))
    kind = F.lit(None).cast("string")
    for name, p in reversed(SECTIONS):
        kind = F.when(F.col("heading").rlike(p), name).otherwise(kind)
    typed = lines.withColumn("section_type", F.when(F.col("heading") != "", kind)).filter("section_type is not null")
    ruled = F.coalesce(F.col("next_line").rlike(r"^[-=_]{3,}$"), F.lit(False))
    return typed.select(*keys, "line_no", "heading", "section_type", ruled.alias("underlined"), F.when(ruled, 0.9).otherwise(0.7).alias("confidence"))


def checkboxes(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Boxes and brackets to tick: keys, box_no, mark, checked."""
    p = "|".join(f"(?:{x})" for x in CHECKBOX)
    hits = df.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(p), 0)).alias("box_no", "mark"))
    return hits.withColumn("checked", F.col("mark").rlike("[xX✓☑■▣]"))
