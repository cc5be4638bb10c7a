"""Queries and SQL of the fusion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import consensus as c
from quireflow.session import load


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.delivered_once(load(spark, sf_dir, "engine_results"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "engine_weights")


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def valid_engine_results(spark, sf_dir):
    return c.valid(_readings(spark, sf_dir)).select("result_id", "doc_id", "engine_name", "confidence")


def consensus_shape(spark, sf_dir):
    return c.consensus_shape(load(spark, sf_dir, "documents"), _readings(spark, sf_dir))


def word_vote_basic(spark, sf_dir):
    return _r6(c.word_vote(_readings(spark, sf_dir)), "mean_share")


def word_vote_weighted(spark, sf_dir):
    return _r6(c.word_vote(_readings(spark, sf_dir), _weights(spark, sf_dir)), "mean_share")


def character_vote(spark, sf_dir):
    return _r6(c.character_vote(_readings(spark, sf_dir), _weights(spark, sf_dir)), "mean_share")


def confidence_analysis(spark, sf_dir):
    return _r6(c.confidence_analysis(_readings(spark, sf_dir), _weights(spark, sf_dir)), "weighted_confidence", "confidence_variance", "least_reliability")


def primary_engine(spark, sf_dir):
    return _r6(c.primary_engine(_readings(spark, sf_dir), _weights(spark, sf_dir)), "score")


def quality_metrics(spark, sf_dir):
    return _r6(c.quality_metrics(_readings(spark, sf_dir)), "mean_time", "total_time", "length_consistency")


def agreement_levels(spark, sf_dir):
    return load(spark, sf_dir, "consensus").select("doc_id", c.agreement_level(F.col("agreement_score")).alias("agreement_level"))


def merged_words(spark, sf_dir):
    return _r6(c.merge_words(_readings(spark, sf_dir), _weights(spark, sf_dir)), "share", "x", "y", "w", "h")


def line_gap_groups(spark, sf_dir):
    return _r6(c.line_groups(_readings(spark, sf_dir)), "x", "y", "w", "h")


def engine_pair_ratios(spark, sf_dir):
    return _r6(c.pair_ratios(_readings(spark, sf_dir)), "ratio")


def text_agreement(spark, sf_dir):
    return _r6(c.agreement(_readings(spark, sf_dir)), "agreement_score")


QUERIES = {
    f.__name__: f
    for f in (valid_engine_results, consensus_shape, word_vote_basic, word_vote_weighted, character_vote, confidence_analysis, primary_engine, quality_metrics, agreement_levels, merged_words, line_gap_groups, engine_pair_ratios, text_agreement)
}

_VALID = """with once as (select * from engine_results qualify row_number() over (partition by result_id order by read_at) = 1),
valid as (select r.*, coalesce(w.weight, 1.0) as weight from once r left join engine_weights w on r.engine_name = w.engine_name
  where coalesce(len(r.errors), 0) = 0 and r.text <> '' and r.confidence > 0.1)"""


def _words(weight: str) -> str:
    return f"""{_VALID}, tok as (select doc_id, engine_ordinal, {weight} as wt, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as l from valid),
pieces as (select doc_id, engine_ordinal, wt, unnest(l) as item, unnest(range(len(l))) as pos from tok),
votes as (select doc_id, pos, item, sum(wt) as w, min(engine_ordinal) as f from pieces group by all),
won as (select doc_id, pos, item, w / sum(w) over (partition by doc_id, pos) as share, row_number() over (partition by doc_id, pos order by round(w, 9) desc, f) as r from votes)
select doc_id, string_agg(item, ' ' order by pos) as consensus_text, count(*) as positions, round(avg(share), 6) as mean_share from won where r = 1 group by doc_id"""


SQL = {
    "valid_engine_results": f"{_VALID} select result_id, doc_id, engine_name, confidence from valid",
    "consensus_shape": f"""{_VALID}, n as (select doc_id, count(*) as c from valid group by doc_id)
select d.doc_id, coalesce(n.c, 0) as valid_engines, case when n.c is null then 'no_valid_results' when n.c = 1 then 'single_engine' else 'multi_engine' end as shape from documents d left join n using (doc_id)""",
    "word_vote_basic": _words("confidence"),
    "word_vote_weighted": _words("confidence * weight"),
    "character_vote": f"""{_VALID}, based as (select *, first_value(length(text)) over (partition by doc_id order by confidence desc, engine_ordinal) as n from valid),
pieces as (select doc_id, engine_ordinal, confidence * weight as wt, unnest(range(least(n, length(text)))) as pos, text from based),
votes as (select doc_id, pos, substring(text, pos + 1, 1) as item, sum(wt) as w, min(engine_ordinal) as f from pieces group by all),
won as (select doc_id, pos, item, w / sum(w) over (partition by doc_id, pos) as share, row_number() over (partition by doc_id, pos order by round(w, 9) desc, f) as r from votes)
select doc_id, count(*) as characters, string_agg(item, '' order by pos) as consensus_text, round(avg(share), 6) as mean_share from won where r = 1 group by doc_id""",
    "confidence_analysis": f"""{_VALID}, m as (select *, greatest(0.0, 1 - abs(confidence - avg(confidence) over (partition by doc_id))) as rel from valid)
select doc_id, count(*) as engines, round(sum(confidence * weight) / sum(weight), 6) as weighted_confidence, round(var_pop(confidence), 6) as confidence_variance, round(min(rel), 6) as least_reliability from m group by doc_id""",
    "primary_engine": f"""{_VALID} select doc_id, engine_name as primary_engine, round(round(confidence * weight, 9), 6) as score from valid
qualify row_number() over (partition by doc_id order by round(confidence * weight, 9) desc, engine_ordinal) = 1""",
    "quality_metrics": f"""{_VALID} select doc_id, count(*) as engines, round(avg(processing_time), 6) as mean_time, round(sum(processing_time), 6) as total_time,
round(greatest(0.0, 1 - stddev_pop(length(text)) / avg(length(text))), 6) as length_consistency from valid group by doc_id""",
    "agreement_levels": """select doc_id, case when agreement_score >= 0.9 then 'very_high' when agreement_score >= 0.7 then 'high' when agreement_score >= 0.5 then 'moderate'
when agreement_score >= 0.3 then 'low' else 'very_low' end as agreement_level from consensus""",
    "merged_words": f"""{_VALID}, t as (select doc_id, engine_ordinal, weight, unnest(words) as t from valid),
w as (select doc_id, engine_ordinal, coalesce(t.confidence, 0.5) * weight as wt, t.text as item, t.bbox as b, cast(floor(t.bbox.x / 10) as bigint) as cell_x, cast(floor(t.bbox.y / 10) as bigint) as cell_y from t where t.bbox is not null and t.text is not null),
votes as (select doc_id, cell_x, cell_y, item, sum(wt) as v, min(engine_ordinal) as f from w group by all),
won as (select *, v / sum(v) over (partition by doc_id, cell_x, cell_y) as share, row_number() over (partition by doc_id, cell_x, cell_y order by round(v, 9) desc, f, item) as r from votes),
boxes as (select doc_id, cell_x, cell_y, count(*) as candidates, min(b.x) as x, min(b.y) as y, max(b.x + b.w) - min(b.x) as w, max(b.y + b.h) - min(b.y) as h from w group by all)
select doc_id, cell_x, cell_y, item as word, round(share, 6) as share, candidates, round(x, 6) as x, round(y, 6) as y, round(w, 6) as w, round(h, 6) as h from won join boxes using (doc_id, cell_x, cell_y) where r = 1""",
    "line_gap_groups": f"""{_VALID}, l as (select doc_id, engine_ordinal, unnest(lines) as t, unnest(range(len(lines))) as line_no from valid),
s as (select *, case when t.bbox.y - lag(t.bbox.y) over (partition by doc_id order by t.bbox.y, engine_ordinal, line_no) > 15 then 1 else 0 end as new from l where t.bbox is not null),
g as (select *, sum(new) over (partition by doc_id order by t.bbox.y, engine_ordinal, line_no rows unbounded preceding) as group_no from s)
select doc_id, cast(group_no as bigint) as group_no, count(*) as lines, count(distinct engine_ordinal) as engines, round(min(t.bbox.x), 6) as x, round(min(t.bbox.y), 6) as y,
round(max(t.bbox.x + t.bbox.w) - min(t.bbox.x), 6) as w, round(max(t.bbox.y + t.bbox.h) - min(t.bbox.y), 6) as h from g group by doc_id, group_no""",
}
