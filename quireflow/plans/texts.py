"""Queries and SQL of the pattern and layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.operators import layout, patterns
from quireflow.operators.consensus import delivered_once
from quireflow.session import load

#: Patterns whose offsets are compared with SQL.
OFFSETS = tuple(n for n in patterns.PATTERNS if n != "po_box")


def _once(spark, sf_dir, *columns):
    return delivered_once(load(spark, sf_dir, "engine_results").select("result_id", "read_at", *columns)).drop("read_at")


def _boxes(spark, sf_dir, array="lines", *columns):
    """Readings with only the boxes of an array."""
    boxes = F.transform(array, lambda t: F.struct(t["bbox"].alias("bbox"))).alias(array)
    return _once(spark, sf_dir, boxes, *columns)


def pattern_offsets(spark, sf_dir):
    return patterns.pattern_matches(load(spark, sf_dir, "consensus"), "consensus_text", ["doc_id"], list(OFFSETS))


def number_categories(spark, sf_dir):
    return patterns.number_categories(load(spark, sf_dir, "pattern_matches").dropDuplicates(["match_id"]))


def currency_amounts(spark, sf_dir):
    m = load(spark, sf_dir, "pattern_matches").filter("pattern = 'currency'").dropDuplicates(["match_id"])
    return m.select("match_id", F.round(patterns.parse_currency(F.col("value")), 6).alias("amount"))


def list_runs(spark, sf_dir):
    return patterns.lists(load(spark, sf_dir, "document_examples"), "text_content", ["id"])


def typed_sections(spark, sf_dir):
    return patterns.sections(load(spark, sf_dir, "document_examples"), "text_content", ["id"])


def checkboxes(spark, sf_dir):
    return patterns.checkboxes(load(spark, sf_dir, "document_examples"), "text_content", ["id"])


def line_cells(spark, sf_dir):
    lines = _once(spark, sf_dir, F.transform("lines", lambda t: t["text"]).alias("lines")).select("result_id", F.posexplode("lines").alias("line_no", "t"))
    return lines.select("result_id", "line_no", F.posexplode(layout.split_cells(F.col("t"))).alias("cell_no", "cell"))


def column_types(spark, sf_dir):
    return layout.column_types(load(spark, sf_dir, "table_cells"))


def table_groups(spark, sf_dir):
    return layout.table_groups(_boxes(spark, sf_dir))


def field_types(spark, sf_dir):
    heads = load(spark, sf_dir, "table_cells").filter("row_idx = 0")
    return heads.select("cell_id", layout.field_type(F.col("text")).alias("field_type"))


def best_overlaps(spark, sf_dir):
    return layout.best_overlaps(_boxes(spark, sf_dir, "words", "doc_id", "engine_ordinal")).withColumn("best_iou", F.round("best_iou", 6))


def column_clusters(spark, sf_dir):
    c = layout.column_clusters(_boxes(spark, sf_dir))
    return c.withColumns({n: F.round(n, 6) for n in ("x", "right")})


def reading_order(spark, sf_dir):
    return layout.reading_order(_boxes(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (pattern_offsets, number_categories, currency_amounts, list_runs, typed_sections, checkboxes, line_cells, column_types, table_groups, field_types, best_overlaps, column_clusters, reading_order)
}

_ONCE = "with once as (select * from engine_results qualify row_number() over (partition by result_id order by read_at) = 1)"


def _offsets(name: str) -> str:
    p = "(?i)" + patterns.PATTERNS[name]
    return f"""select doc_id, '{name}' as pattern, i - 1 as match_no, m[i] as value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as start_pos
from (select doc_id, m, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(consensus_text, '{p}') as m, regexp_split_to_array(consensus_text, '{p}') as g from consensus where consensus_text is not null))"""


_FAMILIES = " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in words.split()) + f" then '{kind}'" for kind, words in layout.FIELD_FAMILIES)
_LINES = "select id, unnest(l) as line, unnest(range(len(l))) as line_no, len(l) - 1 as last_line from (select id, string_split(text_content, chr(10)) as l from document_examples where text_content is not null)"


def _runs(kind: str, p: str) -> str:
    return f"""select id, '{kind}' as list_type, min(line_no) as first_line, count(*) as items from (
 select *, sum(case when hit then 0 else 1 end) over (partition by id order by line_no rows unbounded preceding) as run from (select *, regexp_matches(line, '{p}') as hit from ({_LINES})))
 where hit group by id, run having count(*) >= 2 and max(line_no) < max(last_line)"""


SQL = {
    "pattern_offsets": "select doc_id, pattern, match_no, value, cast(start_pos as integer) as start_pos, cast(start_pos + length(value) as integer) as end_pos from (" + " union all ".join(_offsets(n) for n in OFFSETS) + ")",
    "number_categories": "select doc_id, category, count(*) as n from (select distinct on (match_id) match_id, doc_id, case pattern "
    + " ".join(f"when '{k}' then '{v}'" for k, v in patterns.NUMBER_CATEGORY.items())
    + " end as category from pattern_matches) where category is not null group by doc_id, category",
    "currency_amounts": "select distinct on (match_id) match_id, round(coalesce(try_cast(regexp_replace(value, '[$,]', '', 'g') as double), 0.0), 6) as amount from pattern_matches where pattern = 'currency'",
    "list_runs": _runs("numbered", patterns.NUMBERED) + " union all " + _runs("bulleted", patterns.BULLETED),
    "typed_sections": f"""select id, line_no, heading, section_type, underlined, case when underlined then 0.9 else 0.7 end as confidence from (select id, line_no, heading, coalesce(regexp_matches(next_line, '^[-=_]{{3,}}$'), false) as underlined, case """
    + " ".join(f"when regexp_matches(heading, '{p}') then '{n}'" for n, p in patterns.SECTIONS)
    + f""" end as section_type from (select id, line_no, trim(line) as heading, trim(lead(line) over (partition by id order by line_no)) as next_line from ({_LINES})))
 where section_type is not null and heading <> ''""",
    "checkboxes": "select id, i - 1 as box_no, m[i] as mark, regexp_matches(m[i], '[xX✓☑■▣]') as checked from (select id, m, unnest(range(1, len(m) + 1)) as i from (select id, regexp_extract_all(text_content, '"
    + "|".join(f"(?:{x})" for x in patterns.CHECKBOX)
    + "') as m from document_examples where text_content is not null))",
    "line_cells": f"""{_ONCE}, l as (select result_id, unnest(lines).text as t, unnest(range(len(lines))) as line_no from once),
c as (select result_id, line_no, case when contains(t, chr(9)) then string_split(t, chr(9)) when contains(t, '  ') then string_split(t, '  ') when contains(t, '|') then string_split(t, '|') when contains(t, ',') then string_split(t, ',') else [t] end as c, t from l)
select result_id, line_no, i - 1 as cell_no, case when len(c) > 1 then trim(c[i], ' ') else c[i] end as cell from (select *, unnest(range(1, len(c) + 1)) as i from c)""",
    "column_types": r"""select doc_id, table_idx, col_idx, cells, case when c > 0.5 then 'currency' when n > 0.5 then 'numeric' when d > 0.3 then 'date' else 'text' end as column_type from (
select doc_id, table_idx, col_idx, count(*) as cells, count(*) filter (k = 'currency') / count(*) as c, count(*) filter (k = 'numeric') / count(*) as n, count(*) filter (k = 'date') / count(*) as d from (
select *, case when regexp_matches(trim(text), '^\$?\d+(?:,\d{3})*(?:\.\d{2})?$') then 'currency' when regexp_matches(trim(text), '^\d+(?:\.\d+)?$') then 'numeric' when regexp_matches(trim(text), '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}') then 'date' end as k
from table_cells where row_idx > 0) group by all)""",
    "table_groups": f"""{_ONCE}, l as (select result_id, unnest(lines).bbox as b, unnest(range(len(lines))) as line_no from once), s as (select result_id, b, line_no,
case when b.y - lag(b.y + b.h) over (partition by result_id order by b.y, line_no) > 20 then 1 else 0 end as new from l where b is not null),
g as (select *, sum(new) over (partition by result_id order by b.y, line_no rows unbounded preceding) as group_no from s),
e as (select result_id, group_no, floor(b.x / 10) as edge, count(*) as k from g group by all)
select result_id, cast(group_no as bigint) as group_no, cast(sum(k) as bigint) as lines, max(k) as aligned, max(k) >= 0.5 * sum(k) as table_like from e group by result_id, group_no having sum(k) > 2""",
    "field_types": f"select cell_id, case {_FAMILIES} else 'text' end as field_type from table_cells where row_idx = 0",
    "best_overlaps": f"""{_ONCE}, w as (select doc_id, engine_ordinal, unnest(words).bbox as b, unnest(range(len(words))) as word_no from once),
o as (select distinct doc_id, engine_ordinal from w where b is not null), e as (select a.doc_id, a.engine_ordinal as ord_a, a.word_no, a.b as p, o.engine_ordinal as ord_b from w a join o on a.doc_id = o.doc_id and a.engine_ordinal < o.engine_ordinal where a.b is not null),
q as (select e.*, c.b as q, least(p.x + p.w, c.b.x + c.b.w) - greatest(p.x, c.b.x) as iw, least(p.y + p.h, c.b.y + c.b.h) - greatest(p.y, c.b.y) as ih from e join w c on c.doc_id = e.doc_id and c.engine_ordinal = e.ord_b where c.b is not null),
i as (select *, case when iw > 0 and ih > 0 then iw * ih else 0.0 end as inter from q)
select doc_id, ord_a, ord_b, word_no, round(max(case when p.w * p.h + q.w * q.h - inter > 0 then inter / (p.w * p.h + q.w * q.h - inter) else 0.0 end), 6) as best_iou from i group by doc_id, ord_a, ord_b, word_no""",
    "column_clusters": f"""{_ONCE}, l as (select result_id, unnest(lines).bbox as b, unnest(range(len(lines))) as line_no from once), s as (select result_id, b, line_no,
case when b.x - lag(b.x) over (partition by result_id order by b.x, line_no) > 50 then 1 else 0 end as new from l where b is not null),
g as (select *, sum(new) over (partition by result_id order by b.x, line_no rows unbounded preceding) as island from s),
k as (select result_id, island, count(*) as lines, min(b.x) as x, max(b.x + b.w) as r from g group by all having count(*) >= 2)
select result_id, row_number() over (partition by result_id order by x, island) as column_no, lines, round(x, 6) as x, round(r, 6) as right from k""",
    "reading_order": f"""{_ONCE}, l as (select result_id, unnest(lines).bbox as b, unnest(range(len(lines))) as line_no from once)
select result_id, line_no, row_number() over (partition by result_id order by b.y, b.x, line_no) as reading_no from l where b is not null""",
}
