"""Queries and SQL of engine output, fused documents, boxes across engines, corrections and scores of readings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.operators import boxes, consensus as c, engine_output as eo, feedback, layout, learning, scoring, structures as st
from quireflow.plans.documents import SQL as _DOC_SQL
from quireflow.plans.fusion import _VALID
from quireflow.plans.learning import SINCE
from quireflow.plans.texts import SQL as _TEXT_SQL
from quireflow.session import load

EXPECTED = ["date", "total", "name"]


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _once(spark, sf_dir, *columns):
    return c.delivered_once(load(spark, sf_dir, "engine_results").select("result_id", "read_at", *columns)).drop("read_at")


def _readings(spark, sf_dir):
    return c.delivered_once(load(spark, sf_dir, "engine_results"))


def _weights(spark, sf_dir):
    return load(spark, sf_dir, "engine_weights")


# fused documents


def consensus_documents(spark, sf_dir):
    return _r6(c.consensus_documents(load(spark, sf_dir, "documents"), _readings(spark, sf_dir), _weights(spark, sf_dir)), "confidence", "agreement_score", "mean_time")


def consensus_documents_plain(spark, sf_dir):
    return _r6(c.consensus_documents(load(spark, sf_dir, "documents"), _readings(spark, sf_dir)), "confidence", "agreement_score", "mean_time")


def hybrid_confidence(spark, sf_dir):
    return _r6(c.hybrid_confidence(_readings(spark, sf_dir), _weights(spark, sf_dir)), "word_share", "char_share", "confidence")


def best_readings(spark, sf_dir):
    return c.best_readings(_readings(spark, sf_dir), _weights(spark, sf_dir))


def length_differences(spark, sf_dir):
    return c.length_differences(_readings(spark, sf_dir), load(spark, sf_dir, "consensus"))


def merged_lines(spark, sf_dir):
    return _r6(c.merge_lines(_readings(spark, sf_dir), _weights(spark, sf_dir)), "share", "x", "y", "w", "h")


def collected_boxes(spark, sf_dir):
    return c.collected_boxes(_readings(spark, sf_dir))


# engine output


def line_words(spark, sf_dir):
    """Words of the lines of every reading with boxes of equal width."""
    lines = _once(spark, sf_dir, "lines").select("result_id", F.posexplode(eo.read_lines(F.col("lines"))).alias("line_no", "t"))
    words = lines.select("result_id", "line_no", F.posexplode(eo.split_line(F.col("t.text"), F.col("t.confidence"), F.col("t.bbox"))).alias("word_no", "w"))
    return _r6(words.select("result_id", "line_no", "word_no", F.col("w.text").alias("word"), "w.confidence", F.col("w.bbox.x").alias("x"), F.col("w.bbox.w").alias("w")), "x", "w", "confidence")


def word_lines(spark, sf_dir):
    """Lines grouped from the words of every reading."""
    r = _once(spark, sf_dir, "words").select("result_id", F.posexplode(eo.group_lines(F.col("words"))).alias("line_no", "t"))
    return _r6(r.select("result_id", "line_no", "t.text", "t.words", "t.x", "t.y", "t.w", "t.h"), "x", "y", "w", "h")


def parsed_rows(spark, sf_dir):
    """Words and lines as rows of one table of engine output, parsed again by level."""
    row = lambda level: lambda t: F.struct(F.lit(level).alias("level"), t["text"].alias("text"), (F.coalesce(t["confidence"], F.lit(-0.01)) * 100).alias("conf"), t["bbox"]["x"].alias("left"), t["bbox"]["y"].alias("top"), t["bbox"]["w"].alias("width"), t["bbox"]["h"].alias("height"))
    r = _once(spark, sf_dir, "words", "lines")
    empty = F.array().cast("array<struct<level:int,text:string,conf:double,left:double,top:double,width:double,height:double>>")
    rows = F.concat(F.coalesce(F.transform("words", row(5)), empty), F.coalesce(F.transform("lines", row(4)), empty))
    r = r.select("result_id", rows.alias("rows"))
    out = None
    for level, kind in ((5, "word"), (4, "line")):
        p = r.select("result_id", F.lit(kind).alias("kind"), F.posexplode(eo.parse_rows(level, F.col("rows"))).alias("no", "t")).select("result_id", "kind", "no", "t.text", F.round("t.confidence", 6).alias("confidence"))
        out = p if out is None else out.unionByName(p)
    return out


def corner_boxes(spark, sf_dir):
    """Boxes of words given by their corners, in whole pixels."""
    w = boxes.flat(_once(spark, sf_dir, "words"), "words", "result_id")
    x, y, r, d = F.col("b.x"), F.col("b.y"), F.col("b.x") + F.col("b.w"), F.col("b.y") + F.col("b.h")
    corners = F.array(F.array(x, y), F.array(r, y), F.array(r, d), F.array(x, d))
    return w.select("result_id", "no", eo.polygon_box(corners).alias("p")).select("result_id", "no", "p.*")


def reading_confidences(spark, sf_dir):
    """Confidence of a reading by its words, by its lines, with a default, and by the length of its text alone."""
    r = _once(spark, sf_dir, "words", "lines", "text")
    return r.select(
        "result_id", F.round(eo.mean_confidence(F.col("words")) + 1e-9, 6).alias("by_words"), F.round(eo.mean_confidence(F.col("lines")) + 1e-9, 6).alias("by_lines"), F.round(eo.mean_confidence(F.col("words"), eo.DETECTION_DEFAULT) + 1e-9, 6).alias("by_detections"),
        F.round(eo.reading_confidence(F.col("words"), F.col("text")) + 1e-9, 6).alias("with_fallback"), eo.length_confidence(F.col("text")).alias("by_length"),
    )


def plain_texts(spark, sf_dir):
    """Texts of documents without tags and runs of white space."""
    return load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", eo.strip_tags(F.col("text")).alias("plain"))


# boxes


def line_match_shares(spark, sf_dir):
    return _r6(boxes.line_match_shares(_once(spark, sf_dir, "doc_id", "engine_ordinal", "lines")), "share")


def word_consistency(spark, sf_dir):
    return _r6(boxes.word_consistency(_once(spark, sf_dir, "doc_id", "engine_ordinal", "words")), "consistency")


def merged_regions(spark, sf_dir):
    w = boxes.flat(_once(spark, sf_dir, "words"), "words", "result_id").select("result_id", "b.*")
    return boxes.merge_regions(w, "result_id")


def columns_order(spark, sf_dir):
    r = _once(spark, sf_dir, "lines")
    return boxes.order_by_columns(boxes.flat(r, "lines", "result_id"), layout.column_clusters(r))


def table_agreement(spark, sf_dir):
    """Tables of a document's first engine, surer where another engine has one at the place."""
    r = _once(spark, sf_dir, "doc_id", "engine_ordinal", "lines")
    t = st.table_structures(r).join(r.select("result_id", "doc_id", "engine_ordinal"), "result_id")
    t = t.select("doc_id", "engine_ordinal", (F.col("result_id") * 1000 + F.col("group_no")).alias("no"), "confidence", F.struct("x", "y", "w", "h").alias("b"))
    first = t.groupBy("doc_id").agg(F.min("engine_ordinal").alias("first"))
    t = t.join(first, "doc_id").withColumn("own", F.col("engine_ordinal") == F.col("first")).drop("first", "engine_ordinal")
    return _r6(boxes.boosted(t.filter("own").drop("own"), t.filter("not own").drop("own", "confidence"), "doc_id"), "confidence")


def layout_types(spark, sf_dir):
    r = _once(spark, sf_dir, "lines")
    n = r.select("result_id", F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).alias("regions"))
    tables = st.table_structures(r).groupBy("result_id").agg(F.count("*").alias("tables"), F.avg("confidence").alias("table_mean"))
    columns = layout.column_clusters(r).groupBy("result_id").agg(F.count("*").alias("columns"))
    j = n.join(tables, "result_id", "left").join(columns, "result_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    kind = boxes.layout_type(zero("tables"), zero("columns"), F.lit(0), F.col("regions"))
    return j.select("result_id", kind.alias("layout_type"), F.round(boxes.layout_confidence(F.col("regions"), F.col("table_mean"), F.lit(None).cast("double")), 6).alias("confidence"))


def _performance(spark, sf_dir):
    return learning.once(load(spark, sf_dir, "engine_performance"))


def engine_recommendations(spark, sf_dir):
    scores = _performance(spark, sf_dir).groupBy("engine_name").agg(F.round(F.avg("accuracy_score"), 9).alias("f1"), F.round(F.avg("confidence_score"), 9).alias("quality"))
    return boxes.recommendations(scores)


def visual_confidence(spark, sf_dir):
    k = load(spark, sf_dir, "consensus")
    visual = boxes.visual_confidence(F.col("confidence"), F.col("agreement_score"), F.col("agreement_score"))
    return k.select("doc_id", F.round(visual, 6).alias("visual_confidence"), F.round(boxes.with_vision(F.col("confidence"), visual), 6).alias("confidence"), F.round(boxes.line_weight(F.col("agreement_score")), 6).alias("weight"))


def image_advice(spark, sf_dir):
    """Advice from metrics of readings in place of those of images."""
    p = _performance(spark, sf_dir).select("id", "accuracy_score", "confidence_score", "processing_time")
    a, q = F.col("accuracy_score"), F.col("confidence_score")
    dpi = F.floor(F.col("processing_time") * 100).cast("double")
    advice = scoring.image_advice(a < 0.5, q < 0.6, q < 0.7, dpi, F.floor((a - 0.5) * 10).cast("double"), a, (a + q) / 2)
    out = p.select("id", advice.alias("x"))
    return out.select("id", F.array_join("x.recommendations", "|").alias("recommendations"), F.array_join("x.steps", ",").alias("steps"), F.array_join("x.settings", ",").alias("settings"), "x.engines")


# scores


def line_scores(spark, sf_dir):
    return scoring.line_scores(_once(spark, sf_dir, "lines")).withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in ("line_confidence", "line_consistency")})


def pattern_scores(spark, sf_dir):
    m = load(spark, sf_dir, "pattern_matches").select("match_id", "value").dropDuplicates(["match_id"])
    return m.filter("value is not null").select("match_id", scoring.pattern_score(F.col("value")).alias("score"))


def structure_scores(spark, sf_dir):
    return _r6(scoring.structure_scores(_once(spark, sf_dir, "words", "text")), "word_count_consistency", "bbox_consistency")


def context_scores(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    kind = F.col("document_type")
    return d.select("doc_id", F.round(scoring.type_consistency(F.col("text"), kind), 6).alias("type_consistency"), F.round(scoring.field_consistency(F.col("text"), EXPECTED), 6).alias("field_consistency"))


def reading_scores(spark, sf_dir):
    """All scores of a reading in one: engine, length of text, words, patterns, structure."""
    r = _once(spark, sf_dir, "confidence", "text", "words").filter("text is not null")
    s = scoring.structure_scores(r).join(r.select("result_id", "confidence", "text", eo.mean_confidence(F.col("words")).alias("w"), F.size("words").alias("n")), "result_id")
    whole = scoring.comprehensive({
        "engine_confidence": F.col("confidence"), "text_quality": scoring.length_score(F.col("text")), "word_level_confidence": F.when(F.col("n") > 0, F.col("w")), "pattern_validation_score": scoring.pattern_score(F.col("text")),
        "word_count_consistency": F.col("word_count_consistency"), "bbox_consistency": F.col("bbox_consistency"),
    })
    return s.select("result_id", F.round(whole, 6).alias("overall"))


def pattern_confidences(spark, sf_dir):
    m = load(spark, sf_dir, "pattern_matches")
    return _r6(m.groupBy("doc_id", "pattern").agg(F.avg(F.coalesce("confidence", F.lit(0.5))).alias("confidence")), "confidence")


# corrections and learning


def _corrections(spark, sf_dir):
    """Every value of a document with the next value of the same pattern as its correction."""
    m = load(spark, sf_dir, "pattern_matches").select("match_id", "doc_id", "pattern", "value", "start_pos", "confidence", "detected_at").groupBy("match_id").agg(
        *[F.min_by(x, "detected_at").alias(x) for x in ("doc_id", "pattern", "value", "start_pos", "confidence")], F.min("detected_at").alias("created_at"))
    order = Window.partitionBy("doc_id", "pattern").orderBy("start_pos", "match_id")
    return m.select(
        F.col("match_id").alias("id"), F.col("doc_id").alias("document_id"), F.col("pattern").alias("field_name"), F.col("value").alias("extracted_value"), F.lead("value").over(order).alias("correct_value"),
        F.col("confidence").alias("original_confidence"), "created_at",
    )


def correction_analysis(spark, sf_dir):
    a = feedback.analyse_corrections(_corrections(spark, sf_dir))
    return a.select("id", "error_type", "severity", "affected_documents", "issues", "field_kind", "checks", "confidence_impact", "details", F.size(feedback.recommendations(F.col("issues"), F.col("checks"))).alias("recommendations"))


def value_expressions(spark, sf_dir):
    """A regular expression for values like each one."""
    m = load(spark, sf_dir, "pattern_matches").select("match_id", "value").dropDuplicates(["match_id"]).filter("value is not null")

    @F.pandas_udf("string")
    def expression(values):
        return values.map(feedback.generalised)

    return m.select("match_id", expression("value").alias("expression"))


def recent_corrections(spark, sf_dir):
    return learning.corrections_since(_corrections(spark, sf_dir), SINCE, field="currency").select("id", "document_id", "extracted_value", "correct_value")


def performance_summary(spark, sf_dir):
    return _r6(learning.performance_summary(_performance(spark, sf_dir)), "mean_score", "recent_score")


def _outcomes(spark, sf_dir):
    return load(spark, sf_dir, "pattern_matches").select("match_id", "pattern", (F.col("confidence") > 0.8).alias("ok")).dropDuplicates(["match_id"])


def pattern_outcomes(spark, sf_dir):
    m = load(spark, sf_dir, "pattern_matches").groupBy("match_id").agg(F.min_by("pattern", "detected_at").alias("pattern"), F.min_by("confidence", "detected_at").alias("confidence"))
    return _r6(learning.pattern_outcomes(m.withColumn("ok", F.col("confidence") > 0.8), "pattern", "ok"), "confidence_score")


def learning_progress(spark, sf_dir):
    made = load(spark, sf_dir, "document_examples").select("id", "created_at")
    return _r6(learning.learning_progress(_corrections(spark, sf_dir).select("id", "created_at"), made, _performance(spark, sf_dir), SINCE), "value")


QUERIES = {
    q.__name__: q
    for q in (
        consensus_documents, consensus_documents_plain, hybrid_confidence, best_readings, length_differences, merged_lines, collected_boxes, line_words, word_lines, parsed_rows, corner_boxes, reading_confidences, plain_texts,
        line_match_shares, word_consistency, merged_regions, columns_order, table_agreement, layout_types, engine_recommendations, visual_confidence, image_advice, line_scores, pattern_scores, structure_scores, context_scores,
        reading_scores, pattern_confidences, correction_analysis, value_expressions, recent_corrections, performance_summary, pattern_outcomes, learning_progress,
    )
}

_ONCE = "once as (select * from engine_results qualify row_number() over (partition by result_id order by read_at) = 1)"
_P = "p as (select * from engine_performance qualify row_number() over (partition by id order by received_at) = 1)"
_TOK = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_MEAN = "case when len(list_filter(list_transform({0}, lambda t: {1}), lambda v: v is not null)) > 0 then list_avg(list_transform({0}, lambda t: {1})) else 0.0 end"
_OVER = "case when least({0}.x + {0}.w, {1}.x + {1}.w) > greatest({0}.x, {1}.x) and least({0}.y + {0}.h, {1}.y + {1}.h) > greatest({0}.y, {1}.y) then (least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x)) * (least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y)) else 0.0 end"


def _iou(a: str, b: str) -> str:
    i = "(" + _OVER.format(a, b) + ")"
    return f"{i} / nullif({a}.w * {a}.h + {b}.w * {b}.h - {i}, 0)"


_WHOLE = "(" + " or ".join(f"regexp_matches(§, '{p}')" for p in scoring.VALIDATORS.values()) + ")"
_BAD = "(" + " or ".join(f"regexp_matches(§, '{p}')" for p in scoring.MALFORMED) + ")"
_CORR = """m as (select match_id, min_by(doc_id, detected_at) as doc_id, min_by(pattern, detected_at) as pattern, arg_min_null(value, detected_at) as value, min_by(start_pos, detected_at) as start_pos, arg_min_null(confidence, detected_at) as conf, min(detected_at) as created_at from pattern_matches group by match_id),
 c as (select *, coalesce(value, '') as e, coalesce(lead(value) over (partition by doc_id, pattern order by start_pos, match_id), '') as c, lead(value) over (partition by doc_id, pattern order by start_pos, match_id) as raw from m)"""
_SWAPS = " or ".join(f"(contains(e, '{a}') and contains(c, '{b}')) or (contains(e, '{b}') and contains(c, '{a}'))" for a, b in learning.SUBSTITUTIONS)
_LIST = "array_to_string(list_filter([{}], lambda x: x is not null), ',')"
_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
_KIND = "case " + " ".join("when " + " or ".join(f"contains(lower(pattern), '{w}')" for w in ws.split()) + f" then '{k}'" for k, ws in feedback.NAME_KINDS) + " " + " ".join(f"when regexp_matches(c, '{p}') then '{k}'" for k, p in feedback.VALUE_KINDS) + " else 'text' end"
_TYPE_SHARES = " ".join(
    f"when lower(document_type) = '{k}' then (" + " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in ws.split()) + f") / {len(ws.split())}" for k, ws in scoring.TYPE_WORDS.items()
)

SQL = {
    "hybrid_confidence": f"""{_VALID}, tok as (select doc_id, engine_ordinal, confidence * weight as wt, {_TOK.format('text')} as l from valid), pieces as (select doc_id, engine_ordinal, wt, unnest(l) as item, unnest(range(len(l))) as pos from tok),
 votes as (select doc_id, pos, item, sum(wt) as w, min(engine_ordinal) as f from pieces group by all), won as (select doc_id, pos, item, w / sum(w) over (partition by doc_id, pos) as share, row_number() over (partition by doc_id, pos order by round(w, 9) desc, f) as r from votes),
 words as (select doc_id, string_agg(item, ' ' order by pos) as consensus_text, avg(share) as ws, min(share) as ls from won where r = 1 group by doc_id),
 based as (select *, first_value(length(text)) over (partition by doc_id order by confidence desc, engine_ordinal) as n from valid), cp as (select doc_id, engine_ordinal, confidence * weight as wt, unnest(range(least(n, length(text)))) as pos, text from based),
 cv as (select doc_id, pos, substring(text, pos + 1, 1) as item, sum(wt) as w, min(engine_ordinal) as f from cp group by all), cw as (select doc_id, pos, w / sum(w) over (partition by doc_id, pos) as share, row_number() over (partition by doc_id, pos order by round(w, 9) desc, f) as r from cv),
 chars as (select doc_id, avg(share) as cs from cw where r = 1 group by doc_id)
 select doc_id, consensus_text, round(ws, 6) as word_share, round(cs, 6) as char_share, round(case when ls < 0.6 and cs > ws then greatest(ws, 0.8 * cs) else ws end, 6) as confidence from words left join chars using (doc_id)""",
    "best_readings": f"{_VALID} select doc_id, engine_name, text, confidence from valid qualify row_number() over (partition by doc_id order by round(confidence * weight, 9) desc, engine_ordinal) = 1",
    "length_differences": f"{_VALID} select v.doc_id, engine_name, length(v.text) - length(k.consensus_text) as length_difference from valid v join consensus k on k.doc_id = v.doc_id where consensus_text is not null",
    "merged_lines": f"""{_VALID}, l as (select doc_id, engine_ordinal, weight, unnest(lines) as t, unnest(range(len(lines))) as line_no from valid),
 s as (select *, case when t.bbox.y - lag(t.bbox.y) over (partition by doc_id order by t.bbox.y, engine_ordinal, line_no) > 15 then 1 else 0 end as new from l where t.bbox is not null and t.text is not null),
 g as (select *, t.text as item, coalesce(t.confidence, 0.5) * weight as wt, sum(new) over (partition by doc_id order by t.bbox.y, engine_ordinal, line_no rows unbounded preceding) as group_no from s),
 votes as (select doc_id, group_no, item, sum(wt) as v, min(engine_ordinal) as f from g group by all), won as (select *, v / sum(v) over (partition by doc_id, group_no) as share, row_number() over (partition by doc_id, group_no order by round(v, 9) desc, f, item) as r from votes),
 b as (select doc_id, group_no, count(*) as candidates, min(t.bbox.x) as x, min(t.bbox.y) as y, max(t.bbox.x + t.bbox.w) - min(t.bbox.x) as w, max(t.bbox.y + t.bbox.h) - min(t.bbox.y) as h from g group by all)
 select doc_id, cast(group_no as bigint) as group_no, item as line, round(share, 6) as share, candidates, round(x, 6) as x, round(y, 6) as y, round(w, 6) as w, round(h, 6) as h from won join b using (doc_id, group_no) where r = 1""",
    "collected_boxes": f"{_VALID}, a as (select doc_id, engine_name, 'words' as kind, unnest(words).bbox as b, unnest(range(len(words))) as no from valid union all select doc_id, engine_name, 'lines', unnest(lines).bbox, unnest(range(len(lines))) from valid) select doc_id, engine_name, kind, no, b.x as x, b.y as y, b.w as w, b.h as h from a where b is not null",
    "line_words": f"""with {_ONCE}, l as (select result_id, unnest(lines) as t, unnest(range(len(lines))) as i from once), d as (select result_id, i, t.text as text, coalesce(t.confidence, 0.95) as c, coalesce(t.bbox.x, 0.0) as x, coalesce(t.bbox.w, 100.0) as w from l),
 k as (select result_id, row_number() over (partition by result_id order by i) - 1 as line_no, c, x, w, {_TOK.format('text')} as ws from d where c >= 0.5), u as (select *, unnest(ws) as word, unnest(range(len(ws))) as word_no from k)
 select result_id, line_no, word_no, word, round(c, 6) as confidence, round(x + word_no * (w / len(ws)), 6) as x, round(w / len(ws), 6) as w from u""",
    "parsed_rows": f"""with {_ONCE}, a as (select result_id, 'word' as kind, unnest(words) as t, unnest(range(len(words))) as i from once union all select result_id, 'line', unnest(lines), unnest(range(len(lines))) from once)
 select result_id, kind, row_number() over (partition by result_id, kind order by i) - 1 as no, t.text as text, round(t.confidence, 6) as confidence from a where trim(t.text, ' ') <> '' and t.confidence is not null""",
    "corner_boxes": f"with {_ONCE}, w as (select result_id, unnest(words).bbox as b, unnest(range(len(words))) as no from once) select result_id, no, floor(b.x) as x, floor(b.y) as y, floor(b.x + b.w - b.x) as w, floor(b.y + b.h - b.y) as h from w where b is not null",
    "reading_confidences": f"""with {_ONCE}, rd as (select *, len({_TOK.format('text')}) as n from once) select result_id, round({_MEAN.format('words', 't.confidence')} + 1e-9, 6) as by_words, round({_MEAN.format('lines', 't.confidence')} + 1e-9, 6) as by_lines,
 round({_MEAN.format('words', 'coalesce(t.confidence, 0.8)')} + 1e-9, 6) as by_detections, round(case when len(list_filter(words, lambda t: t.confidence > 0)) > 0 then list_avg(list_transform(list_filter(words, lambda t: t.confidence > 0), lambda t: t.confidence))
 when coalesce(text, '') = '' then 0.0 when n > 50 then 0.8 when n > 10 then 0.6 else 0.4 end + 1e-9, 6) as with_fallback, cast(case when coalesce(text, '') = '' then 0.0 when n < 5 then 0.3 when n < 50 then 0.6 else 0.8 end as double) as by_length from rd""",
    "plain_texts": "select doc_id, trim(regexp_replace(regexp_replace(text, '<[^\\n]*?>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as plain from documents where text is not null",
    "line_match_shares": f"""with {_ONCE}, l as (select doc_id, engine_ordinal, unnest(lines).bbox as b, unnest(range(len(lines))) as no from once), k as (select * from l where b is not null), n as (select doc_id, engine_ordinal, count(*) as lines from k group by all),
 h as (select p.doc_id, p.engine_ordinal as ord_a, q.engine_ordinal as ord_b, p.no from k p join k q on p.doc_id = q.doc_id and p.engine_ordinal < q.engine_ordinal where {_iou('p.b', 'q.b')} > 0.5 group by all), g as (select doc_id, ord_a, ord_b, count(*) as hits from h group by all)
 select a.doc_id, a.engine_ordinal as ord_a, b.engine_ordinal as ord_b, a.lines, round(coalesce(hits, 0) / a.lines, 6) as share from n a join n b on a.doc_id = b.doc_id and a.engine_ordinal < b.engine_ordinal left join g on g.doc_id = a.doc_id and g.ord_a = a.engine_ordinal and g.ord_b = b.engine_ordinal""",
    "columns_order": f"""with cl as ({_TEXT_SQL['column_clusters'].replace('round(x, 6) as x, round(r, 6) as right', 'x, r as right')}), {_ONCE}, l as (select result_id, unnest(lines).bbox as b, unnest(range(len(lines))) as line_no from once),
 p as (select l.result_id, line_no, column_no, b.y as y from l join cl on cl.result_id = l.result_id and b.x >= cl.x and b.x + b.w <= cl.right where b is not null union all select result_id, line_no, 0, b.y from l where b is not null and result_id not in (select result_id from cl))
 select result_id, line_no, cast(column_no as int) as column_no, row_number() over (partition by result_id order by column_no, y, line_no) as reading_no from p""",
    "table_agreement": f"""with tb as ({_DOC_SQL['table_structures']}), {_ONCE}, t as (select o.doc_id, o.engine_ordinal, tb.result_id * 1000 + group_no as no, tb.confidence as confidence, {{'x': x, 'y': y, 'w': w, 'h': h}} as b, min(o.engine_ordinal) over (partition by o.doc_id) as f from tb join once o using (result_id))
 select p.doc_id, p.no, round(case when bool_or(coalesce({_iou('p.b', 'q.b')}, 0) > 0.5) then least(1.0, any_value(p.confidence) + 0.3) else any_value(p.confidence) end, 6) as confidence from t p left join t q on p.doc_id = q.doc_id and q.engine_ordinal > q.f where p.engine_ordinal = p.f group by p.doc_id, p.no""",
    "layout_types": f"""with tb as (select result_id, count(*) as tables, avg(confidence) as tm from ({_DOC_SQL['table_structures']}) group by all), cl as (select result_id, count(*) as columns from ({_TEXT_SQL['column_clusters']}) group by all), {_ONCE},
 n as (select result_id, coalesce(len(lines), 0) as regions from once) select result_id, case when coalesce(tables, 0) > 2 then 'form_or_invoice' when coalesce(columns, 0) > 1 then 'multi_column_document' when regions > 10 then 'text_document' else 'simple_document' end as layout_type,
 round(coalesce(list_avg(list_filter([case when regions > 0 then 0.8 end, tm], lambda x: x is not null)), 0.5), 6) as confidence from n left join tb using (result_id) left join cl using (result_id)""",
    "engine_recommendations": f"""with {_P}, s as (select engine_name, round(avg(accuracy_score), 9) as f1, round(avg(confidence_score), 9) as q from p group by all)
 select engine_name, row_number() over (order by f1 desc, engine_name) as rank, cast(case when f1 > 0.8 then 1.2 when f1 < 0.4 then 0.8 else 1.0 end as double) as adjustment, case when q < 0.5 then engine_name || ': Low bbox quality (score: ' || printf('%.2f', q) || ')' end as warning from s""",
    "visual_confidence": """with v as (select *, coalesce(confidence, 0.0) * 0.3 + coalesce(agreement_score, 0.0) * 0.7 as vc from consensus)
 select doc_id, round(vc, 6) as visual_confidence, round(0.7 * coalesce(confidence, 0.0) + 0.3 * vc, 6) as confidence, round(1 + 0.15 * coalesce(agreement_score, 0.0), 6) as weight from v""",
    "image_advice": f"""with {_P}, k as (select id, accuracy_score as a, confidence_score as q, floor(processing_time * 100) as dpi, floor((accuracy_score - 0.5) * 10) as sk from p)
 select id, array_to_string(list_filter([case when a < 0.5 then 'Image appears blurry. Consider rescanning at higher quality.' end, case when q < 0.6 then 'High noise detected. Apply noise reduction preprocessing.' end,
 case when q < 0.7 then 'Low contrast detected. Consider histogram equalization or gamma correction.' end, case when dpi < 150 then 'Resolution too low for optimal OCR. Current: ~' || printf('%.0f', dpi) || ' DPI, Recommended: ≥150 DPI' end,
 case when abs(sk) > 2 then 'Document skew detected (' || printf('%.1f', sk) || '°). Consider deskewing preprocessing.' end, case when a < 0.5 then 'Poor text quality detected. Check for proper binarization and text clarity.' end], lambda x: x is not null), '|') as recommendations,
 {_LIST.format("case when q < 0.6 then 'noise_reduction' end, case when q < 0.7 then 'contrast_enhancement' end, case when abs(sk) > 2 then 'deskewing' end")} as steps,
 {_LIST.format("case when a < 0.5 then 'enable_image_sharpening' end, case when dpi < 150 then 'use_conservative_settings' end, case when dpi >= 300 then 'use_aggressive_settings' end")} as settings,
 case when (a + q) / 2 > 0.8 then 'tesseract,surya,trocr,easyocr' when (a + q) / 2 > 0.6 then 'trocr,surya,tesseract,easyocr' else 'trocr,easyocr,surya,tesseract' end as engines from k""",
    "line_scores": f"with {_ONCE}, l as (select result_id, unnest(lines).confidence as c from once) select result_id, round(avg(c) + 1e-9, 6) as line_confidence, round(1 - stddev_pop(c) + 1e-9, 6) as line_consistency from l where c is not null group by all",
    "pattern_scores": f"select match_id, cast(case when {_WHOLE.replace('§', 'value')} then 0.9 when {_BAD.replace('§', 'value')} then 0.4 else 0.7 end as double) as score from (select distinct on (match_id) match_id, value from pattern_matches) where value is not null",
    "structure_scores": f"""with {_ONCE}, t as (select *, len({_TOK.format("coalesce(text, '')")}) as n, coalesce(len(words), 0) as k from once)
 select result_id, round(case when n > 0 then greatest(0.0, 1 - abs(k - n) / n) else 0.0 end, 6) as word_count_consistency, round(case when k > 0 then len(list_filter(words, lambda t: t.bbox is not null)) / k end, 6) as bbox_consistency from t""",
    "context_scores": f"""select doc_id, round(case when coalesce(text, '') = '' then 0.5 {_TYPE_SHARES} else 0.7 end, 6) as type_consistency,
 round(case when coalesce(text, '') = '' then 0.0 else ({' + '.join(f"cast(contains(lower(text), '{w}') as int)" for w in EXPECTED)}) / {len(EXPECTED)} end, 6) as field_consistency from documents""",
    "reading_scores": f"""with {_ONCE}, st as (select result_id, word_count_consistency as a, bbox_consistency as b from (@structure)),
 t as (select o.result_id, o.confidence as c, length(trim(text, ' ')) as n, case when len(words) > 0 then {_MEAN.format('words', 't.confidence')} end as w, cast(case when {_WHOLE.replace('§', 'text')} then 0.9 when {_BAD.replace('§', 'text')} then 0.4 else 0.7 end as double) as p, a, b from once o join st using (result_id) where text is not null),
 k as (select *, case when n = 0 then 0.0 when n < 10 then 0.3 when n < 50 then 0.6 when n < 200 then 0.8 else 0.9 end as ls, cast(a is not null as int) + cast(b is not null as int) as m from t)
 select result_id, round((coalesce(c * 0.3, 0) + ls * 0.25 + coalesce(w * 0.2, 0) + p * 0.15 + coalesce(a * (0.1 / m), 0) + coalesce(b * (0.1 / m), 0)) / (case when c is null then 0 else 0.3 end + 0.25 + case when w is null then 0 else 0.2 end + 0.15 + case when a is null then 0 else 0.1 / m end + case when b is null then 0 else 0.1 / m end), 6) as overall from k""",
    "pattern_confidences": "select doc_id, pattern, round(avg(coalesce(confidence, 0.5)), 6) as confidence from pattern_matches group by all",
    "correction_analysis": f"""with {_CORR}, t as (select *, case when e = '' and c <> '' then 'missing_extraction' when e <> '' and c = '' then 'false_positive' when e = '' and c = '' then 'both_empty' when length(e) <> length(c) then 'length_mismatch' when {_SWAPS} then 'character_substitution'
 when translate(e, ' ,.', '') = translate(c, ' ,.', '') then 'formatting_error' else 'content_difference' end as error_type, {_KIND} as field_kind,
 {_LIST.format(f"case when (contains(e, '$') or contains(c, '$')) and contains(e, '.') and contains(c, ',') then 'currency_separator' end, case when (regexp_matches(e, '{feedback.SLASHED[0]}') or regexp_matches(e, '{feedback.SLASHED[1]}')) and (replace(e, '/', '-') = c or replace(e, '-', '/') = c) then 'date_separator' end, case when (regexp_matches(e, '\\d{{3}}.\\d{{3}}.\\d{{4}}') or regexp_matches(c, '\\d{{3}}.\\d{{3}}.\\d{{4}}')) and {_DIGITS.format('e')} = {_DIGITS.format('c')} then 'phone_formatting' end")} as issues,
 case when contains(lower(pattern), 'amount') or contains(lower(pattern), 'total') then '' when contains(lower(pattern), 'date') then {_LIST.format("case when replace(e, '/', '-') = c or replace(e, '-', '/') = c then 'separator_issue' end, case when len(string_split(e, '/')) <> len(string_split(c, '/')) then 'format_issue' end")}
 when contains(lower(pattern), 'phone') then {_LIST.format(f"case when {_DIGITS.format('e')} = {_DIGITS.format('c')} then 'digits_match' end, case when {_DIGITS.format('e')} = {_DIGITS.format('c')} and e <> c then 'formatting_only' end, case when substring({_DIGITS.format('e')}, 1, 3) <> substring({_DIGITS.format('c')}, 1, 3) then 'area_code_issue' end")} else '' end as details from c),
 v as (select *, case when error_type in ('missing_extraction', 'false_positive') then 'high' when error_type in ('character_substitution', 'formatting_error') then 'medium' else 'low' end as severity, case field_kind {' '.join(f"when '{k}' then '{x}'" for k, x in feedback.CHECKS.items())} else '' end as checks from t)
 select match_id as id, error_type, severity, case severity when 'high' then 10 when 'medium' then 5 else 0 end as affected_documents, issues, field_kind, checks, cast(case when coalesce(conf, 0.5) > 0.8 then 0.2 when coalesce(conf, 0.5) > 0.5 then 0.1 else 0.05 end as double) as confidence_impact, details,
 len(list_filter(string_split(issues, ','), lambda x: x <> '')) + case when checks <> '' then 1 else 0 end as recommendations from v""",
    "recent_corrections": f"with {_CORR} select match_id as id, doc_id as document_id, value as extracted_value, raw as correct_value from c where created_at > timestamptz '{SINCE}+00' and pattern = 'currency'",
    "performance_summary": f"""with {_P}, r as (select engine_name, accuracy_score as a, row_number() over (partition by engine_name order by created_at desc, id desc) as k from p where accuracy_score is not null)
 select engine_name, count(*) as samples, round(avg(a), 6) as mean_score, round(avg(a) filter (k <= 10), 6) as recent_score from r group by engine_name""",
    "pattern_outcomes": f"with {_CORR}, o as (select pattern, coalesce(cast(conf > 0.8 as int), 0) as ok from m) select pattern, cast(sum(ok) as bigint) as success_count, cast(sum(1 - ok) as bigint) as failure_count, round(avg(ok), 6) as confidence_score from o group by pattern",
    "learning_progress": f"""with {_CORR}, {_P} select 'corrections' as metric, strftime(created_at at time zone 'UTC', '%Y-%m-%d') as name, cast(count(*) as double) as value from m where created_at > timestamptz '{SINCE}+00' group by all
 union all select 'new_patterns', 'all', cast(count(*) as double) from document_examples where created_at > timestamptz '{SINCE}+00' union all select 'accuracy', engine_name, round(avg(accuracy_score), 6) from p where created_at > timestamptz '{SINCE}+00' group by engine_name""",
}
SQL["reading_scores"] = SQL["reading_scores"].replace("@structure", SQL["structure_scores"])
