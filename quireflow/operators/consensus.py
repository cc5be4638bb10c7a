"""Fusing the readings of several engines: votes on words and characters, box merging, agreement and confidence.

Rows are readings (doc_id, engine_ordinal, engine_name, text, confidence, ...). Ties in votes go to the engine that
comes first in engine_ordinal, as weights are compared after rounding to nine digits.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Thresholds of the agreement levels, and the least ratio of texts that count as similar.
LEVELS = ((0.9, "very_high"), (0.7, "high"), (0.5, "moderate"), (0.3, "low"))
SIMILAR = 0.8
#: Fixed value: a word that wins with a smaller share is unsure.
UNSURE = 0.6


def delivered_once(readings: DataFrame) -> DataFrame:
    """One row per result_id: the earliest delivery. Only columns used later are read."""
    order = Window.partitionBy("result_id").orderBy("read_at")
    return readings.withColumn("__qf_k", F.row_number().over(order)).filter("__qf_k = 1").drop("__qf_k")


def valid(readings: DataFrame) -> DataFrame:
    """Readings without errors, with text and with a confidence above 0.1; null confidences are not valid."""
    return readings.filter((F.coalesce(F.size("errors"), F.lit(0)) <= 0) & (F.col("text") != "") & (F.col("confidence") > 0.1))


def consensus_shape(documents: DataFrame, readings: DataFrame) -> DataFrame:
    """For every document how its readings can be fused: no_valid_results, single_engine or multi_engine."""
    n = valid(readings).groupBy("doc_id").agg(F.count("*").alias("valid_engines"))
    out = documents.select("doc_id").join(n, "doc_id", "left").withColumn("valid_engines", F.coalesce("valid_engines", F.lit(0)))
    return out.withColumn("shape", F.when(F.col("valid_engines") == 0, "no_valid_results").when(F.col("valid_engines") == 1, "single_engine").otherwise("multi_engine"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _vote(pieces: DataFrame, weight: str) -> DataFrame:
    """Winner of every (doc_id, pos): item, weight and share of the total weight."""
    votes = pieces.groupBy("doc_id", "pos", "item").agg(F.sum(weight).alias("w"), F.min("engine_ordinal").alias("first"))
    at = Window.partitionBy("doc_id", "pos")
    ranked = votes.withColumn("total", F.sum("w").over(at)).withColumn("r", F.row_number().over(at.orderBy(F.desc(F.round("w", 9)), "first")))
    return ranked.filter("r = 1").select("doc_id", "pos", "item", (F.col("w") / F.col("total")).alias("share"))


def word_vote(readings: DataFrame, weights: DataFrame | None = None, least: bool = False) -> DataFrame:
    """Word by word vote by confidence, times engine weight if weights (engine_name, weight) are given.

    Result: doc_id, consensus_text, positions and mean_share, the mean share of the winners' weight; with least also
    least_share, the smallest.
    """
    r = valid(readings)
    if weights is not None:
        r = r.join(weights.select("engine_name", "weight"), "engine_name", "left").withColumn("weight", F.col("confidence") * F.coalesce("weight", F.lit(1.0)))
    else:
        r = r.withColumn("weight", F.col("confidence"))
    words = r.select("doc_id", "engine_ordinal", "weight", F.posexplode(_tokens(F.col("text"))).alias("pos", "item"))
    won = _vote(words, "weight")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), " ")
    more = [F.min("share").alias("least_share")] if least else []
    return won.groupBy("doc_id").agg(joined.alias("consensus_text"), F.count("*").alias("positions"), F.avg("share").alias("mean_share"), *more)


def character_vote(readings: DataFrame, weights: DataFrame) -> DataFrame:
    """Vote at every character of the most confident reading; result: doc_id, characters, consensus_text, mean_share."""
    r = valid(readings).join(weights.select("engine_name", "weight"), "engine_name", "left").withColumn("weight", F.col("confidence") * F.coalesce("weight", F.lit(1.0)))
    base = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "engine_ordinal")
    r = r.withColumn("base_length", F.first(F.length("text")).over(base))
    chars = r.select("doc_id", "engine_ordinal", "weight", F.posexplode(F.split(F.expr("substring(text, 1, base_length)"), "")).alias("pos", "item")).filter("item <> ''")
    won = _vote(chars, "weight")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "")
    return won.groupBy("doc_id").agg(F.count("*").alias("characters"), joined.alias("consensus_text"), F.avg("share").alias("mean_share"))


def confidence_analysis(readings: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean and population variance of the confidences of a document, and the least reliable engine's score."""
    r = valid(readings).join(weights.select("engine_name", "weight"), "engine_name", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    mean = F.avg("confidence").over(Window.partitionBy("doc_id"))
    r = r.withColumn("reliability", F.greatest(F.lit(0.0), 1 - F.abs(F.col("confidence") - mean)))
    return r.groupBy("doc_id").agg(
        F.count("*").alias("engines"), (F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight")).alias("weighted_confidence"),
        F.var_pop("confidence").alias("confidence_variance"), F.min("reliability").alias("least_reliability"),
    )


def primary_engine(readings: DataFrame, weights: DataFrame) -> DataFrame:
    """The engine with the highest confidence times weight."""
    r = valid(readings).join(weights.select("engine_name", "weight"), "engine_name", "left").withColumn("score", F.round(F.col("confidence") * F.coalesce("weight", F.lit(1.0)), 9))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "engine_ordinal")
    return r.withColumn("r", F.row_number().over(best)).filter("r = 1").select("doc_id", F.col("engine_name").alias("primary_engine"), "score")


def quality_metrics(readings: DataFrame) -> DataFrame:
    """Engine count, processing times and the consistency of text lengths, 1 - deviation / mean."""
    n = F.length("text")
    return valid(readings).groupBy("doc_id").agg(
        F.count("*").alias("engines"), F.avg("processing_time").alias("mean_time"), F.sum("processing_time").alias("total_time"), F.greatest(F.lit(0.0), 1 - F.stddev_pop(n) / F.avg(n)).alias("length_consistency"),
    )


def agreement_level(score: Column) -> Column:
    """The name of an agreement score; null scores give very_low."""
    c = F.lit("very_low")
    for least, name in reversed(LEVELS):
        c = F.when(score >= least, name).otherwise(c)
    return c


def union_box(box: str) -> list[Column]:
    """Aggregates x, y, w, h of the smallest box around boxes."""
    b = F.col(box)
    x, y = F.min(b["x"]), F.min(b["y"])
    return [x.alias("x"), y.alias("y"), (F.max(b["x"] + b["w"]) - x).alias("w"), (F.max(b["y"] + b["h"]) - y).alias("h")]


def merge_words(readings: DataFrame, weights: DataFrame, cell: int = 10) -> DataFrame:
    """Words of all engines merged by cells of the page: weighted vote on the text, union of the boxes.

    Result: doc_id, cell_x, cell_y, word, share, candidates, x, y, w, h.
    """
    r = valid(readings).join(weights.select("engine_name", "weight"), "engine_name", "left")
    w = r.select("doc_id", "engine_ordinal", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.explode("words").alias("t")).filter("t.bbox is not null and t.text is not null")
    w = w.select("doc_id", "engine_ordinal", (F.coalesce("t.confidence", F.lit(0.5)) * F.col("weight")).alias("wt"), F.col("t.text").alias("item"), F.col("t.bbox").alias("box"), F.floor(F.col("t.bbox.x") / cell).alias("cell_x"), F.floor(F.col("t.bbox.y") / cell).alias("cell_y"))
    at = ["doc_id", "cell_x", "cell_y"]
    votes = w.groupBy(*at, "item").agg(F.sum("wt").alias("v"), F.min("engine_ordinal").alias("first"))
    here = Window.partitionBy(*at)
    won = votes.withColumn("total", F.sum("v").over(here)).withColumn("r", F.row_number().over(here.orderBy(F.desc(F.round("v", 9)), "first", "item"))).filter("r = 1")
    boxes = w.groupBy(*at).agg(F.count("*").alias("candidates"), *union_box("box"))
    return won.select(*at, F.col("item").alias("word"), (F.col("v") / F.col("total")).alias("share")).join(boxes, at)


def line_groups(readings: DataFrame, gap: float = 15.0) -> DataFrame:
    """Lines of all engines of a document in groups: a new group starts where y is over gap below the line before."""
    lines = valid(readings).select("doc_id", "engine_ordinal", F.posexplode("lines").alias("line_no", "t")).filter("t.bbox is not null")
    order = Window.partitionBy("doc_id").orderBy("t.bbox.y", "engine_ordinal", "line_no")
    starts = lines.withColumn("new", F.when(F.col("t.bbox.y") - F.lag("t.bbox.y").over(order) > gap, 1).otherwise(0))
    grouped = starts.withColumn("group_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.withColumn("box", F.col("t.bbox")).groupBy("doc_id", "group_no").agg(F.count("*").alias("lines"), F.countDistinct("engine_ordinal").alias("engines"), *union_box("box"))


def pair_ratios(readings: DataFrame) -> DataFrame:
    """(doc_id, engine_a, engine_b, ratio) for the pairs of readings of a document, engine a before b.

    The ratio is that of matching blocks (Ratcliff and Obershelp), which depends on the order of the two texts.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    r = valid(readings).select("doc_id", "engine_ordinal", "engine_name", "text")
    many = r.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")  # texts without a partner stay where they are
    r = r.join(many, "doc_id", "left_semi")
    a = r.select("doc_id", F.col("engine_ordinal").alias("ord_a"), F.col("engine_name").alias("engine_a"), F.col("text").alias("text_a"))
    b = r.select("doc_id", F.col("engine_ordinal").alias("ord_b"), F.col("engine_name").alias("engine_b"), F.col("text").alias("text_b"))
    return a.join(b, "doc_id").filter("ord_a < ord_b").select("doc_id", "engine_a", "engine_b", ratio("text_a", "text_b").alias("ratio"))


def agreement(readings: DataFrame) -> DataFrame:
    """Mean ratio of a document's readings, 1 for a single reading, whether all are similar, and its level."""
    pairs = pair_ratios(readings).groupBy("doc_id").agg(F.avg("ratio").alias("mean_ratio"), F.min("ratio").alias("least_ratio"))
    out = valid(readings).select("doc_id").distinct().join(pairs, "doc_id", "left")
    score = F.coalesce("mean_ratio", F.lit(1.0))
    return out.select("doc_id", score.alias("agreement_score"), (F.coalesce("least_ratio", F.lit(1.0)) >= SIMILAR).alias("all_similar"), agreement_level(score).alias("agreement_level"))


def hybrid_confidence(readings: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, consensus_text, word_share, char_share and confidence of the word vote.

    Where some word won with less than 0.6 and the character vote is surer than the word vote, the confidence is at
    least 0.8 of the character vote's.
    """
    words = word_vote(readings, weights, least=True)
    chars = character_vote(readings, weights).select("doc_id", F.col("mean_share").alias("char_share"))
    both = words.join(chars, "doc_id", "left")
    unsure = (F.col("least_share") < UNSURE) & (F.col("char_share") > F.col("mean_share"))
    confidence = F.when(unsure, F.greatest("mean_share", 0.8 * F.col("char_share"))).otherwise(F.col("mean_share"))
    return both.select("doc_id", "consensus_text", F.col("mean_share").alias("word_share"), "char_share", confidence.alias("confidence"))


def best_readings(readings: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, engine_name, text, confidence of the reading with the highest confidence, times engine weight if given."""
    r = valid(readings)
    r = r.join(weights.select("engine_name", "weight"), "engine_name", "left") if weights is not None else r.withColumn("weight", F.lit(1.0))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round(F.col("confidence") * F.coalesce("weight", F.lit(1.0)), 9)), "engine_ordinal")
    return r.withColumn("r", F.row_number().over(order)).filter("r = 1").select("doc_id", "engine_name", "text", "confidence")


def consensus_documents(documents: DataFrame, readings: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row a document: status, method, consensus_text, confidence, agreement_score, agreement_level, engines, primary_engine, mean_time.

    One valid reading is taken as it is; readings that are all similar give the text of the best of them; others are
    voted on word by word. Without weights the vote is by confidence alone. Documents without a valid reading have the
    status no_valid_results, no text and no agreement.
    """
    n = valid(readings).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("processing_time").alias("mean_time"), F.array_join(F.array_sort(F.collect_set("engine_name")), ",").alias("engines"))
    alike = agreement(readings)
    best = best_readings(readings, weights).select("doc_id", F.col("engine_name").alias("primary_engine"), F.col("text").alias("best_text"), F.col("confidence").alias("best_confidence"))
    if weights is not None:
        voted = hybrid_confidence(readings, weights).select("doc_id", F.col("consensus_text").alias("voted_text"), F.col("confidence").alias("voted_confidence"))
        names = ("high_similarity_best_confidence", "hybrid_consensus")
    else:
        voted = word_vote(readings).select("doc_id", F.col("consensus_text").alias("voted_text"), F.col("mean_share").alias("voted_confidence"))
        names = ("high_similarity_highest_confidence", "word_voting")
    d = documents.select("doc_id").join(n, "doc_id", "left").join(alike, "doc_id", "left").join(best, "doc_id", "left").join(voted, "doc_id", "left")
    method = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "single_engine").when(F.col("all_similar"), names[0]).otherwise(names[1])
    by_vote = method == names[1]
    return d.select(
        "doc_id", F.when(F.col("n").isNull(), "no_valid_results").otherwise("success").alias("status"), method.alias("method"), F.when(by_vote, F.col("voted_text")).otherwise(F.col("best_text")).alias("consensus_text"),
        F.when(by_vote, F.col("voted_confidence")).otherwise(F.coalesce("best_confidence", F.lit(0.0))).alias("confidence"), "agreement_score", "agreement_level", "engines", "primary_engine", "mean_time",
    )


def length_differences(readings: DataFrame, fused: DataFrame) -> DataFrame:
    """doc_id, engine_name and the length of its text less that of the fused text."""
    r = valid(readings).select("doc_id", "engine_name", F.length("text").alias("n"))
    f = fused.filter("consensus_text is not null").select("doc_id", F.length("consensus_text").alias("m"))
    return r.join(f, "doc_id").select("doc_id", "engine_name", (F.col("n") - F.col("m")).alias("length_difference"))


def merge_lines(readings: DataFrame, weights: DataFrame, gap: float = 15.0) -> DataFrame:
    """Lines of all engines merged by the groups of line_groups: weighted vote on the text, union of the boxes."""
    r = valid(readings).join(weights.select("engine_name", "weight"), "engine_name", "left")
    lines = r.select("doc_id", "engine_ordinal", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.posexplode("lines").alias("line_no", "t")).filter("t.bbox is not null and t.text is not null")
    order = Window.partitionBy("doc_id").orderBy("t.bbox.y", "engine_ordinal", "line_no")
    starts = lines.withColumn("new", F.when(F.col("t.bbox.y") - F.lag("t.bbox.y").over(order) > gap, 1).otherwise(0))
    g = starts.withColumn("group_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.select("doc_id", "group_no", "engine_ordinal", F.col("t.text").alias("item"), (F.coalesce("t.confidence", F.lit(0.5)) * F.col("weight")).alias("wt"), F.col("t.bbox").alias("box"))
    at = ["doc_id", "group_no"]
    votes = g.groupBy(*at, "item").agg(F.sum("wt").alias("v"), F.min("engine_ordinal").alias("first"))
    here = Window.partitionBy(*at)
    won = votes.withColumn("total", F.sum("v").over(here)).withColumn("r", F.row_number().over(here.orderBy(F.desc(F.round("v", 9)), "first", "item"))).filter("r = 1")
    boxes = g.groupBy(*at).agg(F.count("*").alias("candidates"), *union_box("box"))
    return won.select(*at, F.col("item").alias("line"), (F.col("v") / F.col("total")).alias("share")).join(boxes, at)


def collected_boxes(readings: DataFrame) -> DataFrame:
    """All boxes of the words and lines of a document's valid readings: doc_id, engine_name, kind, no, x, y, w, h."""
    r = valid(readings)
    out = None
    for kind in ("words", "lines"):
        b = r.select("doc_id", "engine_name", F.lit(kind).alias("kind"), F.posexplode(F.transform(kind, lambda t: t["bbox"])).alias("no", "b")).filter("b is not null").select("doc_id", "engine_name", "kind", "no", "b.*")
        out = b if out is None else out.unionByName(b)
    return out
