"""What a document consists of: key-values, addresses, form fields, and what follows from their counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quireflow.operators import layout, patterns

#: The ways a key and its value are written, in order, by separator.
KEY_VALUE_FORMS = {
    ":": r"([A-Za-z][A-Za-z\s]{2,30}):\s*([^\n:]{1,100})",
    "=": r"([A-Za-z][A-Za-z\s]{2,30})\s*=\s*([^\n=]{1,100})",
    "-": r"([A-Za-z][A-Za-z\s]{2,30})\s*[-–—]\s*([^\n\-–—]{1,100})",
    "tab": r"([A-Za-z][A-Za-z\s]{2,30})\s{3,}([^\n]{1,100})",
}
#: Addresses and their confidence.
ADDRESSES = {
    "us_address": (
        r"\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Circle|Cir|Way)\b[,\s]*(?:[A-Za-z\s]+[,\s]+)?(?:[A-Z]{2}\s+\d{5}(?:-\d{4})?)?", 0.7,
    ),
    "po_box": (r"(?:P\.?O\.?\s*Box|Post\s*Office\s*Box)\s*\d+", 0.9),
}
#: What the key of a form field has in it.
FIELD_INDICATORS = "name address phone email date signature amount account ssn id number code".split()
#: Type by keyword of a field's name when its value is checked, in order, and the words of a table of money.
CHECKED_KINDS = (("email", "email e-mail"), ("phone", "phone tel mobile"), ("currency", "amount total cost price"), ("date", "date time dob"), ("ssn", "ssn social"))
#: Keys whose values are worth a second look.
CRITICAL = "total amount ssn account".split()
DATE_PATTERNS = ("date_mdy", "date_dmy", "date_ymd", "date_text")

_FORMS = {sep: re.compile(p, re.ASCII) for sep, p in KEY_VALUE_FORMS.items()}
_ADDRESSES = {k: re.compile(p, re.ASCII | re.IGNORECASE) for k, (p, _) in ADDRESSES.items()}
_EDGES = " \t\n\r\f\v"


def pairs(text: str) -> list[tuple[str, str, str, int, int]]:
    """(key, value, separator, start, end) of one text; of overlapping ones the first by start, then by form."""
    found = []
    for order, (sep, p) in enumerate(_FORMS.items()):
        for m in p.finditer(text):
            key, value = m[1].strip(_EDGES), m[2].strip(_EDGES)
            if 3 <= len(key) <= 50 and value and key.count(" ") <= 5:
                found.append((m.start(), order, m.end(), key, value, sep))
    out, last = [], -1
    for start, _, end, key, value, sep in sorted(found):
        if start >= last:
            out.append((key, value, sep, start, end))
            last = end
    return out


def _scan(df: DataFrame, text: str, keys: list[str], fields: dict[str, tuple[pa.DataType, T.DataType]], rows) -> DataFrame:
    """A row of fields for everything rows(text) yields, with the keys of the text's row; one Arrow pass."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, got = [], []
            for row, t in enumerate(b.column(0).to_pylist()):
                for r in rows(t):
                    at.append(row)
                    got.append(r)
            kept = b.take(pa.array(at, pa.int32())).columns[1:]
            columns = [pa.array([r[i] for r in got], t) for i, (t, _) in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keys, *fields])

    schema = T.StructType([*df.select(*keys).schema.fields, *[T.StructField(n, t) for n, (_, t) in fields.items()]])
    return df.filter(F.col(text).isNotNull()).select(text, *keys).mapInArrow(found, schema)


_TEXT, _INT, _REAL = (pa.string(), T.StringType()), (pa.int32(), T.IntegerType()), (pa.float64(), T.DoubleType())


def key_values(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, pair_no, key, value, separator, start_pos, end_pos: pairs with a colon, an equals sign, a dash or a wide gap.

    Keys have 3 to 50 characters and at most five blanks, values are not blank; pairs do not overlap.
    """
    fields = {"pair_no": _INT, "key": _TEXT, "value": _TEXT, "separator": _TEXT, "start_pos": _INT, "end_pos": _INT}
    return _scan(df, text, keys, fields, lambda t: ((i, *p) for i, p in enumerate(pairs(t))))


def addresses(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, address_type, value, start_pos, end_pos, confidence of street addresses and post boxes.

    Classes and word bounds are those of ASCII; letters whose capital is an ASCII one count as that letter.
    """
    folds = str.maketrans("ſK", "sk")

    def rows(t: str) -> Iterator[tuple]:
        for kind, p in _ADDRESSES.items():
            for m in p.finditer(t.translate(folds)):
                yield kind, t[m.start() : m.end()].strip(_EDGES), m.start(), m.end(), ADDRESSES[kind][1]

    return _scan(df, text, keys, {"address_type": _TEXT, "value": _TEXT, "start_pos": _INT, "end_pos": _INT, "confidence": _REAL}, rows)


def _has_word(name: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(name).contains(w)
    return hit


def _field_signs() -> tuple[Column, Column]:
    """Whether a pair's key names a field, and whether its value is a placeholder or too short to be one."""
    return _has_word(F.col("key"), FIELD_INDICATORS), F.col("value").rlike(r"^[_\-.]+$") | (F.length("value") < 3)


def form_fields(key_values: DataFrame, checkboxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field_name, field_type, field_value, has_value, confidence of a document's fields to fill in.

    A pair is a field if its key names one or its value is a placeholder or shorter than three characters; boxes to
    tick are fields without has_value.
    """
    indicated, blank = _field_signs()
    own = key_values.filter(indicated | blank).select(
        *keys, F.col("key").alias("field_name"), layout.field_type(F.col("key")).alias("field_type"), F.when(blank, "").otherwise(F.col("value")).alias("field_value"), (~blank).alias("has_value"),
        F.when(indicated, 0.8).otherwise(0.6).alias("confidence"),
    )
    boxes = checkboxes.select(
        *keys, F.lit("checkbox").alias("field_name"), F.lit("checkbox").alias("field_type"), F.when(F.col("checked"), "checked").otherwise("unchecked").alias("field_value"),
        F.lit(None).cast("boolean").alias("has_value"), F.lit(0.7).alias("confidence"),
    )
    return own.unionByName(boxes)


def structure_counts(df: DataFrame, text: str, key: str, tables: DataFrame, matches: DataFrame) -> DataFrame:
    """One row a text with the counts of what it consists of.

    tables has key and tables, matches key and pattern. Columns: key, key_values, totals, lists, sections, forms,
    checkbox_forms, signature_forms, empty_forms, addresses, dates, currencies, numbers, tables.
    """
    def named(rows: DataFrame, *what: Column) -> DataFrame:
        return rows.select(key, F.explode(F.array_compact(F.array(*what))).alias("what"))

    indicated, blank = _field_signs()
    field = indicated | blank
    kv = named(
        key_values(df, text, [key]), F.lit("key_values"), F.when(F.lower("key").contains("total"), "totals"), F.when(field, "forms"), F.when(field & blank, "empty_forms"),
        F.when(field & (layout.field_type(F.col("key")) == "checkbox"), "checkbox_forms"), F.when(field & (layout.field_type(F.col("key")) == "signature"), "signature_forms"),
    )
    found = named(
        matches, F.when(F.col("pattern").isin(*DATE_PATTERNS), "dates"), F.when(F.col("pattern") == "currency", "currencies"), F.when(F.col("pattern").isin(*patterns.NUMBER_CATEGORY), "numbers"),
    )
    others = [
        named(patterns.lists(df, text, [key]), F.lit("lists")), named(patterns.sections(df, text, [key]), F.lit("sections")), named(addresses(df, text, [key]), F.lit("addresses")),
        named(patterns.checkboxes(df, text, [key]), F.lit("forms"), F.lit("checkbox_forms")), found,
    ]
    names = ["key_values", "totals", "lists", "sections", "forms", "checkbox_forms", "signature_forms", "empty_forms", "addresses", "dates", "currencies", "numbers"]
    long = kv
    for p in others:
        long = long.unionByName(p)
    counted = long.groupBy(key).agg(*[F.count(F.when(F.col("what") == n, 1)).alias(n) for n in names])
    every = df.filter(F.col(text).isNotNull()).select(key).join(counted, key, "left").join(tables.select(key, "tables"), key, "left")
    return every.select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in [*names, "tables"]])


def layout_signature(n: dict[str, Column]) -> dict[str, Column]:
    """Ratios of the counts of structures, with denominators of at least one."""
    least = lambda c: F.greatest(c, F.lit(1))
    kinds = [n[k] for k in ("key_values", "tables", "forms", "lists", "sections", "addresses", "dates")]
    return {
        "table_density": n["tables"] / least(n["sections"] + n["lists"] + n["key_values"]), "form_field_ratio": n["forms"] / least(n["key_values"]), "list_dominance": n["lists"] / least(n["sections"]),
        "numeric_density": n["numbers"] / least(n["key_values"]), "structure_complexity": sum(((k > 0).cast("int") for k in kinds), F.lit(0)) / 10.0,
    }


def form_signature(n: dict[str, Column]) -> dict[str, Column]:
    return {
        "field_count": n["forms"], "has_checkboxes": n["checkbox_forms"] > 0, "has_signatures": n["signature_forms"] > 0, "structured_layout": (n["sections"] > 3) | (n["tables"] > 0),
        "empty_fields_ratio": F.when(n["forms"] > 0, n["empty_forms"] / n["forms"]).otherwise(0.0),
    }


def signature_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean over the names both have of 1 - |a - b| / max(a, b, 0.1)."""
    common = [k for k in a if k in b]
    if not common:
        return F.lit(0.0)
    return sum((1 - F.abs(a[k] - b[k]) / F.greatest(a[k], b[k], F.lit(0.1)) for k in common), F.lit(0.0)) / len(common)


def count_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Cosine of two dictionaries of counts; 0 if either has none."""
    names = sorted({*a, *b})
    value = lambda d, k: d.get(k, F.lit(0)).cast("double")
    dot = lambda x, y: sum((value(x, k) * value(y, k) for k in names), F.lit(0.0))
    total = lambda x: sum((value(x, k) for k in names), F.lit(0.0))
    return F.when((total(a) == 0) | (total(b) == 0), 0.0).otherwise(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def similarity_reasons(keywords: Column, layouts: Column) -> Column:
    """What two documents are alike in: similarities above 0.7, with two digits."""
    named = [F.when(c > 0.7, F.concat(F.lit(f"{n}_similarity: "), F.format_string("%.2f", c + 1e-9))) for n, c in (("keyword", keywords), ("layout", layouts))]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def text_characteristics(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, total_words, total_lines, avg_word_length and numeric_ratio, the share of words with a digit."""
    ws = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(ws)
    share = lambda v: F.when(n > 0, v / n).otherwise(0.0)
    length = F.aggregate(ws, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    return df.filter(F.col(text).isNotNull()).select(
        key, n.alias("total_words"), F.size(F.split(text, "\n", -1)).alias("total_lines"), share(length).alias("avg_word_length"), share(F.size(F.filter(ws, lambda w: w.rlike(r"\d")))).alias("numeric_ratio"),
    )


def dominant(counts: DataFrame, key: str, names: list[str], k: int = 3) -> DataFrame:
    """key, total and the k most frequent kinds, joined; ties in the order of names."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("n"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)]))
    total = sum((F.col(n) for n in names), F.lit(0))
    return counts.select(key, total.alias("total_patterns"), F.array_join(F.transform(F.slice(ranked, 1, k), lambda x: x["name"]), ",").alias("dominant_patterns"))


def reasons(n: dict[str, Column], names: list[str], families: dict[str, Column]) -> Column:
    """Why a document was typed as it was: its three most frequent structures, up to two dense keyword families, many tables, many fields."""
    ranked = F.slice(F.array_sort(F.array(*[F.struct((-n[k]).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(names)])), 1, 3)
    structures = F.transform(F.filter(ranked, lambda x: x["n"] < 0), lambda x: F.concat(F.lit("Contains "), (-x["n"]).cast("string"), F.lit(" "), x["name"]))
    dense = F.slice(F.array_sort(F.array(*[F.struct((-v).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, (k, v) in enumerate(families.items())])), 1, 2)
    words = F.transform(F.filter(dense, lambda x: x["s"] < -0.3), lambda x: F.concat(F.lit("High "), x["name"], F.lit(" keyword density")))
    more = F.filter(
        F.array(F.when(n["tables"] > 2, "Multiple tables suggest structured data document"), F.when(n["forms"] > 5, "Multiple form fields suggest fillable form")), lambda x: x.isNotNull(),
    )
    return F.concat(structures, words, more)


def structured_fields(key_values: DataFrame, key: str) -> DataFrame:
    """key, field, value, field_kind, confidence: the last value of every field; 0.95 if it is valid for its kind, else 0.3."""
    last = key_values.groupBy(key, F.col("key").alias("field")).agg(F.max_by("value", "start_pos").alias("value"))
    kind = F.lit("text")
    for k, words in reversed(CHECKED_KINDS):
        kind = F.when(_has_word(F.col("field"), words.split()), k).otherwise(kind)
    return last.withColumn("field_kind", kind).withColumn("confidence", F.when(_valid(F.col("value"), F.col("field_kind")), 0.95).otherwise(0.3))


def _valid(value: Column, kind: Column) -> Column:
    from quireflow.operators.scoring import VALIDATORS

    ok = F.lit(False)
    for k, p in VALIDATORS.items():
        ok = F.when(kind == k, F.trim(value).rlike(p)).otherwise(ok)
    return ok


def table_type(best_type: Column, has_amount: Column) -> Column:
    return F.when(best_type.contains("financial"), "financial_table").when(has_amount, "amount_table").otherwise("general_table")


def cell_label(text: Column, col: Column) -> Column:
    """struct(label, confidence) of a cell of a financial table."""
    pair = lambda name, c: F.struct(F.lit(name).alias("label"), F.lit(c).alias("confidence"))
    return F.when(col == 0, pair("description", 0.8)).when(text.contains("$") | text.rlike(r"\d"), pair("amount", 0.9)).otherwise(pair("text", 0.5))


def specific_fields(best_type: Column) -> Column:
    """Which group of fields a document of a type has besides the general ones; null for none."""
    return F.when(best_type.contains("tax") | best_type.contains("form"), "tax_fields").when(best_type.contains("invoice"), "invoice_fields").when(best_type.contains("financial"), "financial_fields")


def review_prompts(key_values: DataFrame, confidence: Column) -> DataFrame:
    """Pairs for a reviewer: confirm_amount (money to confirm), verify (below 0.6), critical (an important field below 0.7)."""
    money = F.col("value").contains("$") | F.lower("key").contains("amount")
    flagged = key_values.withColumns({"confirm_amount": money, "verify": confidence < 0.6, "critical": (confidence < 0.7) & _has_word(F.col("key"), CRITICAL)})
    return flagged.filter("confirm_amount or verify or critical")


def learning_opportunities(first_type: Column, low_confidence: Column, patterns_found: Column, agreement: Column) -> Column:
    """What could be learned from a document; first_type is the first type discovered, null for none."""
    flags = (
        (first_type.isNotNull(), F.concat(F.lit("new_document_type_discovered: "), first_type)), (low_confidence > 0, F.concat(F.lit("low_confidence_fields: "), low_confidence.cast("string"))),
        (patterns_found < 5, F.lit("sparse_pattern_detection")), (F.coalesce(agreement, F.lit(1.0)) < 0.5, F.lit("high_engine_disagreement")),
    )
    return F.filter(F.array(*[F.when(c, name) for c, name in flags]), lambda x: x.isNotNull())


def table_columns(cells: DataFrame) -> DataFrame:
    """Columns of the tables of table_cells: doc_id, table_idx, col_idx, values (rows in order), rows."""
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", F.coalesce("text", F.lit("")).alias("text"))))
    return cells.groupBy("doc_id", "table_idx", "col_idx").agg(ordered.alias("v")).select("doc_id", "table_idx", "col_idx", F.array_join(F.transform("v", lambda x: x["text"]), "|").alias("values"), F.size("v").alias("rows"))


def table_structures(readings: DataFrame, gap: float = 20.0) -> DataFrame:
    """Table-like groups of lines of a reading: result_id, group_no, rows, columns (most cells of a row), confidence, x, y, w, h."""
    lines = readings.select("result_id", F.posexplode("lines").alias("line_no", "t")).filter("t.bbox is not null")
    lines = lines.select("result_id", "line_no", F.col("t.bbox").alias("b"), F.size(layout.split_cells(F.col("t.text"))).alias("cells"))
    order = Window.partitionBy("result_id").orderBy("b.y", "line_no")
    new = F.when(F.col("b.y") - F.lag(F.col("b.y") + F.col("b.h")).over(order) > gap, 1).otherwise(0)
    grouped = lines.withColumn("new", new).withColumn("group_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("edge", F.floor(F.col("b.x") / 10))
    x, y = F.min("b.x"), F.min("b.y")
    edges = grouped.groupBy("result_id", "group_no", "edge").agg(
        F.count("*").alias("k"), F.max("cells").alias("cells"), x.alias("x"), y.alias("y"), F.max(F.col("b.x") + F.col("b.w")).alias("r"), F.max(F.col("b.y") + F.col("b.h")).alias("d"),
    )
    g = edges.groupBy("result_id", "group_no").agg(F.sum("k").alias("rows"), F.max("k").alias("aligned"), F.max("cells").alias("columns"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("d").alias("d"))
    like = g.filter((F.col("rows") > 2) & (F.col("aligned") >= 0.5 * F.col("rows")))
    return like.select("result_id", "group_no", "rows", "columns", F.lit(0.6).alias("confidence"), "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("d") - F.col("y")).alias("h"))
