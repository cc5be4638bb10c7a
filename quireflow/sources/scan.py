"""Sources and sinks: files to recognise, pluggable engines, page merging, JSON results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.schema import READING, TOKENS

#: File types that are read, and the marker between pages.
IMAGE_TYPES = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp", "gif")
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
Engine = Callable[[bytes, str], dict]
ENGINES: dict[str, tuple[int, Engine]] = {}


def register(name: str, ordinal: int, engine: Engine) -> None:
    """Adds a recognition engine: (content, path) -> text, confidence, words, lines, paragraphs."""
    ENGINES[name] = (ordinal, engine)


def available_engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, o) for n, (o, _) in ENGINES.items()], "engine_name string, engine_ordinal int")


def files(spark: SparkSession, folder: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """All files of the types below a folder: path, length, modificationTime, content; nothing is read until used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.filter(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*types))


def recognise(scans: DataFrame, names: list[str]) -> DataFrame:
    """Every file read by every named engine as READING rows; a failing engine gives a row with its error."""
    chosen = {n: ENGINES[n] for n in names}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                for name, (ordinal, engine) in chosen.items():
                    row = {"path": path, "engine_name": name, "engine_ordinal": ordinal, "text": "", "confidence": 0.0, "words": None, "lines": None, "paragraphs": None, "errors": []}
                    start = time.perf_counter()
                    try:
                        row |= engine(bytes(content), path)
                    except Exception as e:  # an engine's failure is data
                        row["errors"] = [str(e)]
                    row["processing_time"] = time.perf_counter() - start
                    rows.append(row)
            yield pd.DataFrame(rows, columns=READING.names)

    return scans.select("path", "content").mapInPandas(read, READING)


def merge_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, engine_name, page_no, text, confidence, words) joined to one reading a document and engine.

    Confidence is the mean over pages with any; texts of the pages are joined in order with the page marker.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text", F.col("words").cast(TOKENS).alias("words"))))
    g = pages.groupBy("doc_id", "engine_name").agg(ordered.alias("p"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("confidence"))
    return g.select("doc_id", "engine_name", F.array_join(F.transform("p", lambda x: x["text"]), PAGE_BREAK).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.flatten(F.filter(F.transform("p", lambda x: x["words"]), lambda w: w.isNotNull())).alias("words"))


def write_documents(results: DataFrame, folder: str) -> None:
    """One JSON object a document, appended in date partitions."""
    results.withColumn("written_on", F.current_date()).write.mode("append").partitionBy("written_on").json(folder)
