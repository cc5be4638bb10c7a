"""Raw results of recognition engines as typed words, lines and confidences, and the settings of engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page segmentation and engine modes by name, and the settings of a kind of document.
PAGE_MODES = {"auto": 3, "single_column": 4, "single_block": 6, "single_line": 7, "single_word": 8, "sparse_text": 11}
ENGINE_MODES = {"legacy": 0, "lstm": 1, "combined": 2, "default": 3}
#: Least line confidence, confidences and line height where an engine gives none.
LEAST_LINE, LINE_DEFAULT, DETECTION_DEFAULT, LINE_HEIGHT = 0.5, 0.95, 0.8, 20.0


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def polygon_box(points: Column) -> Column:
    """The box around corner points, arrays of x and y, in whole pixels; zeros where there are none."""
    at = lambda i: F.transform(points, lambda p: p[i])
    whole = lambda c: F.floor(c).cast("double")
    x, y = F.array_min(at(0)), F.array_min(at(1))
    found = box(whole(x), whole(y), whole(F.array_max(at(0)) - x), whole(F.array_max(at(1)) - y))
    none = F.lit(0.0)
    return F.when(F.size(points) > 0, found).otherwise(box(none, none, none, none))


def parse_rows(level: int, rows: Column) -> Column:
    """Tabular engine output of one level (5 words, 4 lines, 3 paragraphs) as array<struct<text, confidence, bbox>>.

    rows is array<struct<level, text, conf, left, top, width, height>> with conf in percent; blank texts and rows of
    conf -1 are left out.
    """
    kept = F.filter(rows, lambda r: (r["level"] == level) & (F.trim(r["text"]) != "") & (r["conf"] != -1))
    return F.transform(kept, lambda r: F.struct(r["text"].alias("text"), (r["conf"] / 100.0).alias("confidence"), box(r["left"], r["top"], r["width"], r["height"]).alias("bbox")))


def mean_confidence(items: Column, default: float | None = None) -> Column:
    """Mean confidence of an array of recognised items, 0 for none; missing ones count as default, or not at all."""
    values = F.transform(items, lambda t: F.coalesce(t["confidence"], F.lit(default).cast("double")))
    known = F.filter(values, lambda c: c.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)).otherwise(0.0)


def split_line(text: Column, confidence: Column, at: Column) -> Column:
    """The words of a line with boxes of equal width side by side: array<struct<text, confidence, bbox>>."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    width = at["w"] / F.greatest(F.size(words), F.lit(1))
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), confidence.alias("confidence"), box(at["x"] + i * width, at["y"], width, at["h"]).alias("bbox")))


def read_lines(lines: Column) -> Column:
    """Detected lines with a confidence of LEAST_LINE or more; missing confidences and boxes get their defaults."""
    full = F.transform(lines, lambda t, i: F.struct(
        t["text"].alias("text"), F.coalesce(t["confidence"], F.lit(LINE_DEFAULT)).alias("confidence"), F.coalesce(t["bbox"], box(F.lit(0), i * LINE_HEIGHT, F.lit(100), F.lit(LINE_HEIGHT))).alias("bbox"),
    ))
    return F.filter(full, lambda t: t["confidence"] >= LEAST_LINE)


def group_lines(words: Column, tolerance: float = 10.0) -> Column:
    """Words in lines: array<struct<text, confidence, x, y, w, h, words>>, from above.

    A word belongs to a line while its y is at most tolerance from that of the line's first word.
    """
    ordered = F.array_sort(F.transform(F.filter(words, lambda t: t["bbox"].isNotNull()), lambda t, i: F.struct(t["bbox"]["y"].alias("y"), i.alias("i"), t["bbox"]["x"].alias("x"), t["bbox"]["w"].alias("w"), t["bbox"]["h"].alias("h"), t["text"].alias("t"), t["confidence"].alias("c"))))
    line = "struct<text:string,confidence:double,x:double,y:double,w:double,h:double,words:int,first:double>"
    start = F.struct(F.lit(None).cast(line).alias("open"), F.array().cast(f"array<{line}>").alias("done"))

    def own(v: Column) -> Column:
        return F.struct(v["t"].alias("text"), v["c"].alias("confidence"), v["x"].alias("x"), v["y"].alias("y"), v["w"].alias("w"), v["h"].alias("h"), F.lit(1).alias("words"), v["y"].alias("first"))

    def joined(o: Column, v: Column) -> Column:
        x, y = F.least(o["x"], v["x"]), F.least(o["y"], v["y"])
        return F.struct(
            F.concat(o["text"], F.lit(" "), v["t"]).alias("text"), ((o["confidence"] * o["words"] + v["c"]) / (o["words"] + 1)).alias("confidence"), x.alias("x"), y.alias("y"),
            (F.greatest(o["x"] + o["w"], v["x"] + v["w"]) - x).alias("w"), (F.greatest(o["y"] + o["h"], v["y"] + v["h"]) - y).alias("h"), (o["words"] + 1).alias("words"), o["first"].alias("first"),
        )

    def step(a: Column, v: Column) -> Column:
        near = a["open"].isNotNull() & (F.abs(v["y"] - a["open"]["first"]) <= tolerance)
        return F.struct(
            F.when(near, joined(a["open"], v)).otherwise(own(v)).cast(line).alias("open"),
            F.when(near | a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"),
        )

    return F.aggregate(ordered, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def strip_tags(html: Column) -> Column:
    """The text of a table given as HTML: tags become blanks, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^\n]*?>", " "), r"\s+", " "))


def beam_confidence(score: Column) -> Column:
    return F.coalesce(F.least(F.exp(score), F.lit(1.0)), F.lit(0.8))


def length_confidence(text: Column) -> Column:
    """The confidence of an engine that gives none: by the number of words, 0 for no text."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(n < 5, 0.3).when(n < 50, 0.6).otherwise(0.8)


def reading_confidence(words: Column, text: Column) -> Column:
    """Mean of the word confidences above 0; without any, by the number of words of the text."""
    known = F.filter(words, lambda t: t["confidence"] > 0)
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    by_length = F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(n > 50, 0.8).when(n > 10, 0.6).otherwise(0.4)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size(known)).otherwise(by_length)


def config_string(page_mode: Column, engine_mode: Column, whitelist: Column, extra: Column) -> Column:
    """Options of a command-line engine; modes by name or number, unknown names as the defaults."""
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, str(v))])
    number = lambda mode, d, other: F.coalesce(F.try_element_at(table(d), mode), F.when(mode.rlike(r"^\d+$"), mode), F.lit(other))
    return F.concat_ws(
        " ", F.concat(F.lit("--psm "), number(page_mode, PAGE_MODES, "3")), F.concat(F.lit("--oem "), number(engine_mode, ENGINE_MODES, "3")),
        F.when(whitelist != "", F.concat(F.lit("-c tessedit_char_whitelist="), whitelist)), F.when(extra != "", extra),
    )


def page_mode_for(has_tables: Column, density: Column) -> Column:
    """The page mode for an image: sparse text if little of it is dark, else one block if it has tables, else automatic."""
    return F.when(F.coalesce(density, F.lit(0.0)) < 0.1, 11).when(has_tables, 6).otherwise(3)


def model_for(document_type: Column) -> Column:
    low = F.lower(document_type)
    return F.when(low.contains("handwritten"), "large_handwritten").when(low.contains("form") | low.contains("table"), "large_printed").otherwise("base_printed")
