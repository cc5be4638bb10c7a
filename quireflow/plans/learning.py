"""Queries and SQL of the learning store."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.operators import learning as l
from quireflow.operators.consensus import delivered_once, valid
from quireflow.session import load

#: Instead of the present moment, so that results can be compared.
SINCE, NOW = "2023-06-01 00:00:00", "2024-01-01 00:00:00"


def _perf(spark, sf_dir):
    return l.once(load(spark, sf_dir, "engine_performance"))


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def engine_stats(spark, sf_dir):
    stats = l.engine_stats(_perf(spark, sf_dir), SINCE)
    return stats.withColumns({n: F.round(n, 9) for n in ("mean_accuracy", "mean_confidence", "mean_time")})  # means of 48 have ties at six


def daily_progress(spark, sf_dir):
    return _r6(l.daily_progress(_perf(spark, sf_dir)), "mean_accuracy")


def rolling_weights(spark, sf_dir):
    return _r6(l.rolling_weights(_perf(spark, sf_dir)), "weight")


def weight_trends(spark, sf_dir):
    return _r6(l.weight_trends(_perf(spark, sf_dir)), "recent", "earlier")


def learned_weights(spark, sf_dir):
    return _r6(l.learned_weights(_perf(spark, sf_dir)), "weight")


def retained_records(spark, sf_dir):
    return l.retained(_perf(spark, sf_dir), NOW).select("id", "engine_name")


def lease_examples(spark, sf_dir):
    return l.examples_of_type(load(spark, sf_dir, "document_examples"), "lease").select("id", "document_type", "user_label")


def accuracy_outcomes(spark, sf_dir):
    outcomes = _perf(spark, sf_dir).filter("accuracy_score is not null").withColumn("good", F.col("accuracy_score") >= 0.8)
    return _r6(l.rule_success(outcomes, "document_type", "good"), "success_rate")


def correction_types(spark, sf_dir):
    r = valid(delivered_once(load(spark, sf_dir, "engine_results"))).select("doc_id", "engine_name", "text")
    pairs = r.join(load(spark, sf_dir, "consensus").select("doc_id", "consensus_text"), "doc_id")
    kind = l.error_type(F.col("text"), F.col("consensus_text"))
    return pairs.select("doc_id", "engine_name", kind.alias("error_type"), l.impact(kind).alias("impact"))


def run_summary(spark, sf_dir):
    return load(spark, sf_dir, "consensus").groupBy("status", "method").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (engine_stats, daily_progress, rolling_weights, weight_trends, learned_weights, retained_records, lease_examples, accuracy_outcomes, correction_types, run_summary)}

_ONCE = "with p as (select * from engine_performance qualify row_number() over (partition by id order by received_at) = 1)"
_SWAPS = " or ".join(f"(contains(e, '{a}') and contains(c, '{b}')) or (contains(e, '{b}') and contains(c, '{a}'))" for a, b in l.SUBSTITUTIONS)

SQL = {
    "engine_stats": f"""{_ONCE} select engine_name, document_type, round(avg(accuracy_score), 9) as mean_accuracy, round(avg(confidence_score), 9) as mean_confidence, round(avg(processing_time), 9) as mean_time, count(*) as uses
 from p where created_at > timestamptz '{SINCE}+00' group by engine_name, document_type""",
    "daily_progress": f"{_ONCE} select strftime(created_at at time zone 'UTC', '%Y-%m-%d') as day, engine_name, count(*) as uses, round(avg(accuracy_score), 6) as mean_accuracy from p group by all",
    "rolling_weights": f"""{_ONCE} select id, engine_name, round(least(2.0, greatest(0.5, avg(accuracy_score) over (partition by engine_name order by created_at, id rows between 19 preceding and current row))), 6) as weight from p where accuracy_score is not null""",
    "weight_trends": f"""{_ONCE}, r as (select *, row_number() over (partition by engine_name order by created_at desc, id desc) as k, count(*) over (partition by engine_name) as scores from p where accuracy_score is not null),
 g as (select engine_name, any_value(scores) as scores, avg(accuracy_score) filter (k <= 5) as recent, avg(accuracy_score) filter (k between 6 and 10) as earlier from r group by engine_name)
 select engine_name, scores, round(recent, 6) as recent, round(earlier, 6) as earlier, case when scores < 6 then 'insufficient_data' when recent - earlier > 0.1 then 'improving' when recent - earlier < -0.1 then 'declining' else 'stable' end as trend from g""",
    "learned_weights": f"{_ONCE}, t as (select engine_name, document_type, avg(accuracy_score) as a from p group by all) select engine_name, round(least(2.0, greatest(0.5, avg(a))), 6) as weight from t group by engine_name",
    "retained_records": f"{_ONCE} select id, engine_name from p where created_at >= timestamptz '{NOW}+00' - interval 90 days",
    "lease_examples": "select id, document_type, user_label from document_examples where document_type = 'lease' or user_label = 'lease'",
    "accuracy_outcomes": f"{_ONCE} select document_type, count(*) as usage_count, round(avg(cast(accuracy_score >= 0.8 as int)), 6) as success_rate from p where accuracy_score is not null group by document_type",
    "correction_types": f"""with once as (select * from engine_results qualify row_number() over (partition by result_id order by read_at) = 1),
 v as (select r.doc_id, r.engine_name, coalesce(r.text, '') as e, coalesce(k.consensus_text, '') as c from once r join consensus k using (doc_id) where coalesce(len(r.errors), 0) = 0 and r.text <> '' and r.confidence > 0.1),
 t as (select doc_id, engine_name, case when e = '' and c <> '' then 'missing_extraction' when e <> '' and c = '' then 'false_positive' when e = '' and c = '' then 'both_empty' when length(e) <> length(c) then 'length_mismatch'
 when {_SWAPS} then 'character_substitution' when translate(e, ' ,.', '') = translate(c, ' ,.', '') then 'formatting_error' else 'content_difference' end as error_type from v)
 select *, case when error_type in ('missing_extraction', 'false_positive') then 'high' when error_type in ('character_substitution', 'formatting_error') then 'medium' else 'low' end as impact from t""",
    "run_summary": "select status, method, count(*) as documents from consensus group by status, method",
}
