"""Comparing boxes across engines: matches, merged regions, order by columns, recommendations, layout types."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.operators.layout import iou


def flat(readings: DataFrame, array: str, *keys: str) -> DataFrame:
    """keys, no, text, confidence, b (box) of the items of an array that have a box."""
    items = readings.select(*keys, F.posexplode(array).alias("no", "t")).filter("t.bbox is not null")
    return items.select(*keys, "no", "t.text", "t.confidence", F.col("t.bbox").alias("b"))


def meeting(a: DataFrame, b: DataFrame, on: list[str], cell: float = 200.0) -> DataFrame:
    """Pairs of a and b (columns a_..., b_...) equal in on whose boxes share a cell of the page, once each."""

    def tiled(d: DataFrame, p: str) -> DataFrame:
        span = lambda at, size: F.sequence(F.floor(F.col(f"b.{at}") / cell), F.floor((F.col(f"b.{at}") + F.greatest(F.col(f"b.{size}"), F.lit(0.0))) / cell))
        t = d.withColumn("ty", F.explode(span("y", "h"))).withColumn("tx", F.explode(span("x", "w")))
        return t.select(*on, "tx", "ty", *[F.col(c).alias(p + c) for c in d.columns if c not in on])

    pairs = tiled(a, "a_").join(tiled(b, "b_"), [*on, "tx", "ty"])
    # of the cells two boxes share only the first counts
    first = (F.col("tx") == F.floor(F.greatest("a_b.x", "b_b.x") / cell)) & (F.col("ty") == F.floor(F.greatest("a_b.y", "b_b.y") / cell))
    return pairs.filter(first).drop("tx", "ty")


def overlap(pairs: DataFrame) -> Column:
    return iou({k: F.col(f"a_b.{k}") for k in "xywh"}, {k: F.col(f"b_b.{k}") for k in "xywh"})


def line_match_shares(readings: DataFrame, least: float = 0.5) -> DataFrame:
    """For the engines of a document, a before b: the share of a's lines that overlap a line of b by more than least."""
    lines = flat(readings, "lines", "doc_id", "engine_ordinal")
    met = meeting(lines, lines, ["doc_id"]).filter("a_engine_ordinal < b_engine_ordinal")
    hit = met.withColumn("iou", overlap(met)).filter(F.col("iou") > least).select("doc_id", F.col("a_engine_ordinal").alias("ord_a"), F.col("b_engine_ordinal").alias("ord_b"), F.col("a_no").alias("no")).distinct()
    n = lines.groupBy("doc_id", "engine_ordinal").agg(F.count("*").alias("lines"))
    a, b = n.withColumnRenamed("engine_ordinal", "ord_a"), n.select("doc_id", F.col("engine_ordinal").alias("ord_b"))
    hits = hit.groupBy("doc_id", "ord_a", "ord_b").agg(F.count("*").alias("hits"))
    both = a.join(b, "doc_id").filter("ord_a < ord_b").join(hits, ["doc_id", "ord_a", "ord_b"], "left")
    return both.select("doc_id", "ord_a", "ord_b", "lines", (F.coalesce("hits", F.lit(0)) / F.col("lines")).alias("share"))


def word_consistency(readings: DataFrame, least: float = 0.7) -> DataFrame:
    """Share of an engine's words whose best 0.6 * text ratio + 0.4 * overlap with a word of a later engine is above least.

    Such a score needs an overlap above (least - 0.6) / 0.4, so words that do not meet on the page are not compared.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    words = flat(readings, "words", "doc_id", "engine_ordinal").filter("text is not null").withColumn("text", F.lower("text"))
    met = meeting(words, words, ["doc_id"]).filter("a_engine_ordinal < b_engine_ordinal")
    near = met.withColumn("iou", overlap(met)).filter(F.col("iou") > (least - 0.6) / 0.4)
    good = near.filter(0.6 * ratio("a_text", "b_text") + 0.4 * F.col("iou") > least).select("doc_id", F.col("a_engine_ordinal").alias("ord_a"), F.col("b_engine_ordinal").alias("ord_b"), "a_no").distinct()
    n = words.groupBy("doc_id", "engine_ordinal").agg(F.count("*").alias("words"))
    a, b = n.withColumnRenamed("engine_ordinal", "ord_a"), n.select("doc_id", F.col("engine_ordinal").alias("ord_b"))
    both = a.join(b, "doc_id").filter("ord_a < ord_b").join(good.groupBy("doc_id", "ord_a", "ord_b").agg(F.count("*").alias("good")), ["doc_id", "ord_a", "ord_b"], "left")
    return both.select("doc_id", "ord_a", "ord_b", "words", (F.coalesce("good", F.lit(0)) / F.col("words")).alias("consistency"))


def match_scores(words: DataFrame, regions: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, precision, recall, f1 and mean overlap of one-to-one matches of words to regions."""
    n = words.groupBy("doc_id").agg(F.count("*").alias("words")).join(regions.groupBy("doc_id").agg(F.count("*").alias("regions")), "doc_id", "full")
    m = matches.groupBy("doc_id").agg(F.count("*").alias("hits"), F.avg("iou").alias("mean_overlap"))
    both = n.join(m, "doc_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    share = lambda c: F.when(F.col(c) > 0, F.col("hits") / F.col(c)).otherwise(0.0)
    out = both.select("doc_id", share("words").alias("precision"), share("regions").alias("recall"), F.coalesce("mean_overlap", F.lit(0.0)).alias("mean_overlap"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def merge_regions(regions: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """Overlapping regions of a key merged: from the left, each into the first merged one it overlaps by more than least.

    regions has key, x, y, w, h. The order matters, so one key is one group, of the size of a page.
    """

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        done: list[list[float]] = []
        for x, y, w, h in pdf.sort_values(["x", "y", "w", "h"])[["x", "y", "w", "h"]].itertuples(index=False):
            for o in done:
                iw, ih = min(x + w, o[0] + o[2]) - max(x, o[0]), min(y + h, o[1] + o[3]) - max(y, o[1])
                if iw > 0 and ih > 0 and iw * ih / (w * h + o[2] * o[3] - iw * ih) > least:
                    left, top = min(x, o[0]), min(y, o[1])
                    o[:] = left, top, max(x + w, o[0] + o[2]) - left, max(y + h, o[1] + o[3]) - top
                    break
            else:
                done.append([x, y, w, h])
        return pd.DataFrame([(pdf[key].iloc[0], i, *o) for i, o in enumerate(done)], columns=[key, "region_no", "x", "y", "w", "h"])

    kind = dict(regions.dtypes)[key]
    return regions.select(key, "x", "y", "w", "h").groupBy(key).applyInPandas(merged, f"{key} {kind}, region_no int, x double, y double, w double, h double")


def order_by_columns(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Lines of a reading column by column, each from above: result_id, line_no, column_no, reading_no.

    lines has result_id, no, b; columns has result_id, column_no, x, right. A line belongs to every column that contains
    it from left to right; one in no column has no place, and readings without columns are ordered by y alone.
    """
    l = lines.select("result_id", F.col("no").alias("line_no"), F.col("b.x").alias("lx"), (F.col("b.x") + F.col("b.w")).alias("lr"), F.col("b.y").alias("ly"))
    inside = l.join(columns, "result_id").filter("lx >= x and lr <= right").select("result_id", "line_no", "column_no", "ly")
    alone = l.join(columns.select("result_id").distinct(), "result_id", "left_anti").select("result_id", "line_no", F.lit(0).alias("column_no"), "ly")
    order = Window.partitionBy("result_id").orderBy("column_no", "ly", "line_no")
    return inside.unionByName(alone).select("result_id", "line_no", "column_no", F.row_number().over(order).alias("reading_no"))


def boosted(tables: DataFrame, models: DataFrame, on: str, least: float = 0.5) -> DataFrame:
    """Tables with confidence + 0.3, at most 1, where a table of a model overlaps them by more than least.

    Both have on, no, b (box); tables has confidence.
    """
    met = meeting(tables, models, [on])
    agreed = met.withColumn("iou", overlap(met)).filter(F.col("iou") > least).select(on, F.col("a_no").alias("no")).distinct().withColumn("agreed", F.lit(True))
    raised = F.when(F.col("agreed"), F.least(F.lit(1.0), F.col("confidence") + 0.3)).otherwise(F.col("confidence"))
    return tables.join(agreed, [on, "no"], "left").select(on, "no", raised.alias("confidence"))


def layout_type(tables: Column, columns: Column, figures: Column, regions: Column) -> Column:
    return F.when(tables > 2, "form_or_invoice").when(columns > 1, "multi_column_document").when(figures > 1, "report_or_presentation").when(regions > 10, "text_document").otherwise("simple_document")


def layout_confidence(regions: Column, table_mean: Column, model_mean: Column) -> Column:
    """Mean of 0.8 if there are regions and of the mean confidences that are known; 0.5 if there is nothing."""
    parts = F.array_compact(F.array(F.when(regions > 0, 0.8), table_mean, model_mean))
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, c: a + c) / F.size(parts)).otherwise(0.5)


def ruled_table(horizontal: Column, vertical: Column) -> Column:
    """0.7 for a page with more than two lines each way, which is one table, else null."""
    return F.when((horizontal > 2) & (vertical > 2), 0.7)


def orientation(width: Column, height: Column) -> Column:
    return F.when(height > width, "portrait").otherwise("landscape")


def recommendations(scores: DataFrame, key: str | None = None) -> DataFrame:
    """engine_name, rank by f1, adjustment (1.2 above 0.8, 0.8 below 0.4, else 1) and warning where quality is below 0.5."""
    order = Window.partitionBy(*([key] if key else [])).orderBy(F.desc("f1"), "engine_name")
    warning = F.when(F.col("quality") < 0.5, F.concat(F.col("engine_name"), F.lit(": Low bbox quality (score: "), F.format_string("%.2f", "quality"), F.lit(")")))
    return scores.select(
        *([key] if key else []), "engine_name", F.row_number().over(order).alias("rank"), F.when(F.col("f1") > 0.8, 1.2).when(F.col("f1") < 0.4, 0.8).otherwise(1.0).alias("adjustment"), warning.alias("warning"),
    )


def visual_confidence(quality: Column, layout: Column, consistency: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(quality) * 0.3 + zero(layout) * 0.4 + zero(consistency) * 0.3


def with_vision(confidence: Column, visual: Column) -> Column:
    return 0.7 * F.coalesce(confidence, F.lit(0.0)) + 0.3 * visual


def line_weight(line_score: Column) -> Column:
    return 1.0 + 0.15 * F.coalesce(line_score, F.lit(0.0))
