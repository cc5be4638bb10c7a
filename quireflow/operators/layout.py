"""Tables, columns, form fields and reading order from lines, cells and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keyword families of field names, in the order they are tried.
FIELD_FAMILIES = (
    ("name", "name fname lname first last"), ("address", "address addr street city state zip"), ("phone", "phone tel mobile cell"), ("email", "email e-mail"), ("date", "date dob birth expire"),
    ("currency", "amount total price cost fee"), ("ssn", "ssn social"), ("signature", "signature sign"), ("checkbox", "check select choose"),
)


def split_cells(line: Column) -> Column:
    """Cells of a line by the first of tab, two blanks, bar and comma it has; the line itself where it has none."""
    by = lambda p: F.transform(F.split(line, p, -1), lambda c: F.trim(c))
    return F.when(line.contains("\t"), by("\t")).when(line.contains("  "), by("  ")).when(line.contains("|"), by(r"\|")).when(line.contains(","), by(",")).otherwise(F.array(line))


def column_types(cells: DataFrame) -> DataFrame:
    """Type of every table column from its body cells: currency or numeric over half, date over 30 %, else text."""
    v = F.trim("text")
    kind = F.when(v.rlike(r"^\$?\d+(?:,\d{3})*(?:\.\d{2})?$"), "currency").when(v.rlike(r"^\d+(?:\.\d+)?$"), "numeric").when(v.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"), "date")
    body = cells.filter("row_idx > 0").withColumn("kind", kind)
    share = lambda k: F.count(F.when(F.col("kind") == k, 1)) / F.count("*")
    g = body.groupBy("doc_id", "table_idx", "col_idx").agg(F.count("*").alias("cells"), share("currency").alias("c"), share("numeric").alias("n"), share("date").alias("d"))
    return g.select("doc_id", "table_idx", "col_idx", "cells", F.when(F.col("c") > 0.5, "currency").when(F.col("n") > 0.5, "numeric").when(F.col("d") > 0.3, "date").otherwise("text").alias("column_type"))


def table_groups(readings: DataFrame, gap: float = 20.0) -> DataFrame:
    """Groups of three or more lines of a reading close below each other, and whether half of them share a left edge."""
    lines = readings.select("result_id", F.posexplode("lines").alias("line_no", "t")).filter("t.bbox is not null").select("result_id", "line_no", "t.bbox.x", "t.bbox.y", "t.bbox.h")
    order = Window.partitionBy("result_id").orderBy("y", "line_no")
    new = F.when(F.col("y") - F.lag(F.col("y") + F.col("h")).over(order) > gap, 1).otherwise(0)
    grouped = lines.withColumn("new", new).withColumn("group_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = grouped.groupBy("result_id", "group_no", F.floor(F.col("x") / 10).alias("edge")).agg(F.count("*").alias("k"))
    g = edges.groupBy("result_id", "group_no").agg(F.sum("k").alias("lines"), F.max("k").alias("aligned"))
    return g.filter("lines > 2").withColumn("table_like", F.col("aligned") >= 0.5 * F.col("lines"))


def field_type(name: Column) -> Column:
    """The first keyword family a field's name contains, else text."""
    low = F.lower(name)
    out = F.lit("text")
    for kind, words in reversed(FIELD_FAMILIES):
        hit = F.lit(False)
        for w in words.split():
            hit = hit | low.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given as x, y, w, h; touching boxes and empty unions give 0."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def best_overlaps(readings: DataFrame, cell: float = 200.0) -> DataFrame:
    """For every word box its best overlap with a word of each later engine of the document, 0 where it meets none.

    Boxes meet through the square cells of the page they touch, so that no page, and no dense row of one, is joined with
    itself as a whole.
    """
    words = readings.select("doc_id", "engine_ordinal", F.posexplode("words").alias("word_no", "t")).filter("t.bbox is not null").select("doc_id", "engine_ordinal", "word_no", F.col("t.bbox").alias("b"))
    span = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.greatest(F.col(size), F.lit(0.0))) / cell))
    tiled = words.withColumn("tile_y", F.explode(span("b.y", "b.h"))).withColumn("tile_x", F.explode(span("b.x", "b.w")))
    a, b = tiled.alias("a"), tiled.alias("b")
    box = lambda s: {k: F.col(f"{s}.b.{k}") for k in "xywh"}
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "tile_x", "tile_y")]
    pairs = a.join(b, same[0] & same[1] & same[2] & (F.col("a.engine_ordinal") < F.col("b.engine_ordinal")))
    met = pairs.select(F.col("a.doc_id").alias("doc_id"), F.col("a.engine_ordinal").alias("ord_a"), F.col("b.engine_ordinal").alias("ord_b"), F.col("a.word_no").alias("word_no"), iou(box("a"), box("b")).alias("iou"))
    best = met.groupBy("doc_id", "ord_a", "ord_b", "word_no").agg(F.max("iou").alias("best_iou"))
    engines = words.groupBy("doc_id").agg(F.collect_set("engine_ordinal").alias("engines"))  # a few a document
    every = words.join(engines, "doc_id").select("doc_id", F.col("engine_ordinal").alias("ord_a"), F.explode(F.filter("engines", lambda e: e > F.col("engine_ordinal"))).alias("ord_b"), "word_no")
    return every.join(best, ["doc_id", "ord_a", "ord_b", "word_no"], "left").withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0)))


def column_clusters(readings: DataFrame, eps: float = 50.0) -> DataFrame:
    """Columns of a reading: chains of line left edges at most eps apart, of two lines or more, numbered from the left."""
    lines = readings.select("result_id", F.posexplode("lines").alias("line_no", "t")).filter("t.bbox is not null").select("result_id", "line_no", "t.bbox.x", "t.bbox.w")
    order = Window.partitionBy("result_id").orderBy("x", "line_no")
    island = lines.withColumn("new", F.when(F.col("x") - F.lag("x").over(order) > eps, 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = island.groupBy("result_id", "island").agg(F.count("*").alias("lines"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("right")).filter("lines >= 2")
    return g.select("result_id", F.row_number().over(Window.partitionBy("result_id").orderBy("x", "island")).alias("column_no"), "lines", "x", "right")


def reading_order(readings: DataFrame) -> DataFrame:
    """Lines of a reading in order of y, then x."""
    lines = readings.select("result_id", F.posexplode("lines").alias("line_no", "t")).filter("t.bbox is not null")
    return lines.select("result_id", "line_no", F.row_number().over(Window.partitionBy("result_id").orderBy("t.bbox.y", "t.bbox.x", "line_no")).alias("reading_no"))
