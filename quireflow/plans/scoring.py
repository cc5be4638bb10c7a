"""Queries and SQL of the scoring and typing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.operators import scoring as s
from quireflow.operators.consensus import delivered_once
from quireflow.session import load

#: Which validator a found pattern is checked with.
KINDS = {"email": "email", "phone_us": "phone", "date_mdy": "date", "currency": "currency", "zip_us": "zip"}


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def text_scores(spark, sf_dir):
    return _r6(s.text_scores(load(spark, sf_dir, "documents"), "text", "doc_id"), "distribution_score", "readability_score", "consistency_score")


def formatting_scores(spark, sf_dir):
    return _r6(s.formatting_scores(load(spark, sf_dir, "documents"), "text", "doc_id"), "line_consistency")


def word_scores(spark, sf_dir):
    r = delivered_once(load(spark, sf_dir, "engine_results").select("result_id", "words", "read_at"))
    return _r6(s.word_scores(r), "mean_confidence", "valid_share", "steadiness")


def malformed_scores(spark, sf_dir):
    return load(spark, sf_dir, "consensus").filter("consensus_text is not null").select("doc_id", s.malformed_score(F.col("consensus_text")).alias("score"))


def field_validation(spark, sf_dir):
    m = load(spark, sf_dir, "pattern_matches").dropDuplicates(["match_id"])
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), "pattern")
    return m.select("match_id", s.validate(F.col("value"), F.coalesce(kind, F.lit("unknown"))).alias("score"))


def overall_confidence(spark, sf_dir):
    c = load(spark, sf_dir, "consensus")
    score = s.overall({"engine": (F.col("confidence"), 0.3), "text": (s.length_score(F.col("consensus_text")), 0.25), "agreement": (F.col("agreement_score"), 0.1)})
    return c.select("doc_id", F.round(score, 6).alias("overall"))


def keyword_signatures(spark, sf_dir):
    return _r6(s.keyword_signatures(load(spark, sf_dir, "documents"), "text", "doc_id"), "score")


def best_types(spark, sf_dir):
    sig = s.keyword_signatures(load(spark, sf_dir, "documents"), "text", "doc_id").filter("score > 0")
    found = sig.select(F.col("doc_id").alias("doc"), F.col("family").alias("type"), F.round("score", 9).alias("confidence"), F.when(F.col("family").isin("legal", "medical"), "learned").otherwise("discovered").alias("source"))
    return s.best_guess(found)


def learned_similarity(spark, sf_dir):
    return _r6(s.learned_similarity(load(spark, sf_dir, "embeddings")), "similarity")


def completeness(spark, sf_dir):
    kinds = {"numbers": ["integer", "decimal", "currency"], "dates": ["date_mdy", "date_dmy", "date_ymd", "date_text"], "addresses": ["us_address", "po_box"], "references": ["reference", "form_number", "account"]}
    m = load(spark, sf_dir, "pattern_matches")
    has = [F.max(F.col("pattern").isin(v).cast("int")) for v in kinds.values()]
    return m.groupBy("doc_id").agg((sum(has[1:], has[0]) / 4).alias("completeness"))


QUERIES = {f.__name__: f for f in (text_scores, formatting_scores, word_scores, malformed_scores, field_validation, overall_confidence, keyword_signatures, best_types, learned_similarity, completeness)}

_COMMON = "[" + ", ".join(f"'{w}'" for w in s.COMMON) + "]"
_DIST = " + ".join(f"greatest(0.0, 1 - 10 * abs((length(low) - length(replace(low, '{c}', ''))) / n - {f}))" for c, f in sorted(s.LETTERS.items()))
_TOK = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"


def _signature(key: str, family: str, ks: str) -> str:
    kws = ks.split()
    inlist = "[" + ", ".join(f"'{k}'" for k in kws) + "]"
    partial = " + ".join(f"len(list_filter(ws, lambda w: contains(w, '{k}') and w <> '{k}'))" for k in kws)
    return f"select {key}, '{family}' as family, case when len(ws) > 0 then least(1.0, (len(list_filter(ws, lambda w: list_contains({inlist}, w))) + 0.5 * ({partial})) / (sqrt(len(ws)) * sqrt({len(kws)}.0))) else 0.0 end as score from tk"


def signature_sql(table: str, key: str, text: str) -> str:
    """CTEs ending in sig (key, family, score)."""
    return f"tk as (select {key}, {_TOK.format(f'lower({text})')} as ws from {table} where {text} is not null), sig as (" + " union all ".join(_signature(key, f, k) for f, k in s.FAMILIES.items()) + ")"


_SIGS = "with " + signature_sql("documents", "doc_id", "text")

SQL = {
    "text_scores": f"""with t as (select doc_id, text, lower(text) as low, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as n, {_TOK.format('text')} as ws,
 length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / length(text) as p, length(regexp_replace(text, '[a-zA-Z0-9\\s.,;:!?\\-()]', '', 'g')) / length(text) as sp from documents where text is not null),
 k as (select *, len(list_filter(ws, lambda w: list_contains({_COMMON}, regexp_replace(lower(w), '[^a-z]', '', 'g')))) / len(ws) as known, list_sum(list_transform(ws, lambda w: length(w))) / len(ws) as mean from t)
 select doc_id, case when length(trim(text, ' ')) = 0 then 0.0 when length(trim(text, ' ')) < 10 then 0.3 when length(trim(text, ' ')) < 50 then 0.6 when length(trim(text, ' ')) < 200 then 0.8 else 0.9 end as length_score,
 round(case when n = 0 then 0.5 else ({_DIST}) / 26 end, 6) as distribution_score,
 round(case when len(ws) = 0 then 0.0 else (known + case when mean between 2 and 8 then 1.0 else 0.5 end + case when lower(text) <> text and upper(text) <> text then 1.0 else 0.7 end) / 3 end, 6) as readability_score,
 round(case when length(text) = 0 then 0.0 else (case when p <= 0.3 then 1.0 else 0.5 end + case when sp < 0.1 then 1.0 else greatest(0.0, 1 - 5 * sp) end) / 2 end, 6) as consistency_score from k""",
    "formatting_scores": """with l as (select doc_id, text, length(trim(unnest(string_split(text, chr(10))), ' ')) as n from documents where text is not null)
 select doc_id, round(greatest(0.0, 1 - stddev_pop(n) / avg(n)), 6) as line_consistency, case when (length(any_value(text)) - length(replace(any_value(text), ' ', ''))) / length(any_value(text)) between 0.1 and 0.3 then 1.0 else 0.7 end as spacing
 from l where n > 0 group by doc_id""",
    "word_scores": f"""with once as (select * from engine_results qualify row_number() over (partition by result_id order by read_at) = 1), w as (select result_id, unnest(words) as t from once),
 v as (select result_id, t.confidence as c, t.text as w, regexp_replace(lower(t.text), '[^a-z]', '', 'g') as p from w)
 select result_id, count(*) as words, round(avg(c), 6) as mean_confidence, round(avg(cast(list_contains({_COMMON}, p) or length(p) >= 2 or regexp_matches(regexp_replace(w, '[,.$]', '', 'g'), '^\\d+$') as int)), 6) as valid_share,
 round(1 - stddev_pop(c), 6) as steadiness from v group by result_id""",
    "malformed_scores": "select doc_id, case when " + " or ".join(f"regexp_matches(consensus_text, '{p}')" for p in s.MALFORMED) + " then 0.4 else 0.7 end as score from consensus where consensus_text is not null",
    "field_validation": "select distinct on (match_id) match_id, case pattern " + " ".join(f"when '{p}' then case when regexp_matches(trim(value, ' '), '{s.VALIDATORS[k]}') then 0.95 else 0.1 end" for p, k in KINDS.items()) + " else 0.0 end as score from pattern_matches",
    "overall_confidence": """with t as (select *, length(trim(consensus_text, ' ')) as n from consensus), k as (select *, case when n = 0 then 0.0 when n < 10 then 0.3 when n < 50 then 0.6 when n < 200 then 0.8 else 0.9 end as ls from t)
 select doc_id, round((coalesce(confidence * 0.3, 0.0) + ls * 0.25 + coalesce(agreement_score * 0.1, 0.0)) / (case when confidence is null then 0.0 else 0.3 end + 0.25 + case when agreement_score is null then 0.0 else 0.1 end), 6) as overall from k""",
    "keyword_signatures": f"{_SIGS} select doc_id, family, round(score, 6) as score from sig",
    "best_types": f"""{_SIGS}, c as (select doc_id as doc, family as type, round(score, 9) as confidence, family in ('legal', 'medical') as learned from sig where score > 0),
 r as (select *, row_number() over (partition by doc order by confidence desc, type) as r, max(confidence) over (partition by doc) as top from c)
 select doc, coalesce(arg_min(type, r) filter (learned and confidence > 0.9 * top), arg_min(type, r)) as best_type from r group by doc""",
    "learned_similarity": """with first as (select label as learned, arg_min(embedding, vec_id) as example from embeddings group by label)
 select vec_id, learned, round(list_dot_product(cast(embedding as double[]), cast(example as double[])) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(cast(example as double[]), cast(example as double[])))), 6) as similarity from embeddings, first""",
    "completeness": """select doc_id, (max(cast(pattern in ('integer', 'decimal', 'currency') as int)) + max(cast(pattern in ('date_mdy', 'date_dmy', 'date_ymd', 'date_text') as int)) + max(cast(pattern in ('us_address', 'po_box') as int)) + max(cast(pattern in ('reference', 'form_number', 'account') as int))) / 4 as completeness
 from pattern_matches group by doc_id""",
}
