"""Queries and SQL of the feedback and typing analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.operators import feedback as f
from quireflow.operators.consensus import delivered_once, valid
from quireflow.session import load


def _matches(spark, sf_dir):
    return load(spark, sf_dir, "pattern_matches").select("match_id", "doc_id", "pattern", "value").dropDuplicates(["match_id"])


def pattern_issue_counts(spark, sf_dir):
    r = valid(delivered_once(load(spark, sf_dir, "engine_results"))).select("doc_id", "engine_name", "text")
    pairs = r.join(load(spark, sf_dir, "consensus").select("doc_id", "consensus_text"), "doc_id").filter("consensus_text is not null")
    return pairs.select("doc_id", "engine_name", F.array_join(f.pattern_issues(F.col("text"), F.col("consensus_text")), ",").alias("issues"))


def value_kinds(spark, sf_dir):
    return _matches(spark, sf_dir).select("match_id", f.value_kind(F.col("value"), F.col("pattern")).alias("value_kind"), f.value_pattern(F.col("value")).alias("value_pattern"))


def text_labels(spark, sf_dir):
    return f.labels(load(spark, sf_dir, "consensus"), "consensus_text", "doc_id")


def top_patterns(spark, sf_dir):
    return f.top_patterns(_matches(spark, sf_dir))


def quality_indicators(spark, sf_dir):
    n = _matches(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    c = load(spark, sf_dir, "consensus").select("doc_id", "agreement_score", "confidence").join(n, "doc_id", "left")
    return c.select("doc_id", F.array_join(f.quality_indicators(F.col("agreement_score"), F.col("confidence"), F.coalesce("n", F.lit(0))), ",").alias("indicators"))


def greedy_box_match(spark, sf_dir):
    """Words of each document's first engine with boxes against the words of its other engines, the regions."""
    r = delivered_once(load(spark, sf_dir, "engine_results").select("result_id", "doc_id", "engine_ordinal", "words", "read_at"))
    t = r.select("doc_id", "result_id", "engine_ordinal", F.posexplode("words").alias("k", "t")).filter("t.bbox is not null").select("doc_id", "result_id", "engine_ordinal", "k", "t.bbox.*")
    first = t.groupBy("doc_id").agg(F.min("engine_ordinal").alias("first"))
    boxes = t.join(first, "doc_id").withColumn("own", F.col("engine_ordinal") == F.col("first")).drop("first")
    numbered = boxes.withColumn("no", F.row_number().over(f.Window.partitionBy("doc_id", "own").orderBy("engine_ordinal", "result_id", "k")))
    side = lambda own, no: numbered.filter(F.col("own") == own).select(F.col("no").alias(no), *[F.col(c).alias(c) for c in ("doc_id", "x", "y", "w", "h")])
    return f.greedy_box_match(side(True, "word_no"), side(False, "region_no"))


QUERIES = {q.__name__: q for q in (pattern_issue_counts, value_kinds, text_labels, top_patterns, quality_indicators, greedy_box_match)}

_M = "m as (select distinct on (match_id) match_id, doc_id, pattern, value from pattern_matches)"
_LIST = "array_to_string(list_filter([{}], lambda x: x is not null), ',')"

SQL = {
    "pattern_issue_counts": f"""with once as (select * from engine_results qualify row_number() over (partition by result_id order by read_at) = 1),
 p as (select r.doc_id, r.engine_name, r.text as e, k.consensus_text as c from once r join consensus k using (doc_id) where coalesce(len(r.errors), 0) = 0 and r.text <> '' and r.confidence > 0.1 and k.consensus_text is not null)
 select doc_id, engine_name, {_LIST.format(
        "case when (contains(e, '$') or contains(c, '$')) and contains(e, '.') and contains(c, ',') then 'currency_separator' end, "
        f"case when (regexp_matches(e, '{f.SLASHED[0]}') or regexp_matches(e, '{f.SLASHED[1]}')) and (replace(e, '/', '-') = c or replace(e, '-', '/') = c) then 'date_separator' end, "
        "case when (regexp_matches(e, '\\d{3}.\\d{3}.\\d{4}') or regexp_matches(c, '\\d{3}.\\d{3}.\\d{4}')) and regexp_replace(e, '[^0-9]', '', 'g') = regexp_replace(c, '[^0-9]', '', 'g') then 'phone_formatting' end"
    )} as issues from p""",
    "value_kinds": f"with {_M} select match_id, case " + " ".join("when " + " or ".join(f"contains(lower(pattern), '{w}')" for w in ws.split()) + f" then '{k}'" for k, ws in f.NAME_KINDS) + " " + " ".join(f"when regexp_matches(value, '{p}') then '{k}'" for k, p in f.VALUE_KINDS)
    + " else 'text' end as value_kind, regexp_replace(regexp_replace(value, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') as value_pattern from m",
    "text_labels": "with t as (select doc_id, flatten([" + ", ".join(f"list_transform(regexp_extract_all(consensus_text, '{p}', 1), lambda x: 'form_document_' || lower(x))" for p in f.FORM_IDS) + ", "
    + ", ".join(f"list_transform(regexp_extract_all(consensus_text, '{p}', 1)[1:2], lambda x: 'document_from_' || replace(lower(x), ' ', '_'))" for p in f.ORGANISATIONS)
    + ", list_filter([" + ", ".join(f"case when list_contains(regexp_split_to_array(lower(consensus_text), '\\s+'), '{w}') then '{v}' end" for w, v in f.PURPOSES.items()) + """], lambda x: x is not null)]) as l,
 regexp_extract(consensus_text, '\\b((?:19|20)\\d{2})\\b', 1) as y from consensus where consensus_text is not null),
 d as (select doc_id, list_transform(l, lambda x, i: case when i = 1 and y <> '' then x || '_' || y else x end) as l from t)
 select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], '; ') as labels from d""",
    "top_patterns": f"with {_M}, n as (select doc_id, pattern, count(*) as n from m group by all) select doc_id, pattern, n, row_number() over (partition by doc_id order by n desc, pattern) as rank from n qualify rank <= 3",
    "quality_indicators": f"""with {_M}, n as (select doc_id, count(*) as n from m group by doc_id), c as (select doc_id, agreement_score as a, confidence as q, coalesce(n, 0) as n from consensus left join n using (doc_id))
 select doc_id, {_LIST.format("case when a > 0.8 then 'high_engine_agreement' end, case when a < 0.5 then 'low_engine_agreement' end, case when n > 20 then 'rich_structure_detected' end, case when n < 5 then 'sparse_structure' end, case when q > 0.8 then 'high_confidence' end, case when q < 0.5 then 'low_confidence' end")} as indicators from c""",
}
