"""Queries and SQL of what documents consist of and what follows from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.operators import feedback, layout, patterns, scoring, structures as st
from quireflow.operators.consensus import delivered_once
from quireflow.plans.scoring import signature_sql
from quireflow.session import load

COUNTS = ("key_values", "totals", "lists", "sections", "forms", "checkbox_forms", "signature_forms", "empty_forms", "addresses", "dates", "currencies", "numbers", "tables")
#: The kinds of structure in the order in which ties are named.
KINDS = ("key_values", "tables", "lists", "sections", "forms", "dates", "addresses")
FAMILY_NAMES = {"government": "government forms", "financial": "financial documents", "legal": "legal documents", "medical": "medical documents", "correspondence": "correspondence"}


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _examples(spark, sf_dir):
    return load(spark, sf_dir, "document_examples").select("id", "text_content")


def _texts(spark, sf_dir):
    return load(spark, sf_dir, "consensus").select("doc_id", F.col("consensus_text").alias("text"))


def _matches(spark, sf_dir):
    return load(spark, sf_dir, "pattern_matches").select("match_id", "doc_id", "pattern", "value", "start_pos").dropDuplicates(["match_id"])


def _counts(spark, sf_dir):
    tables = load(spark, sf_dir, "table_cells").groupBy("doc_id").agg(F.countDistinct("table_idx").alias("tables"))
    return st.structure_counts(_texts(spark, sf_dir), "text", "doc_id", tables, _matches(spark, sf_dir))


def key_values(spark, sf_dir):
    return st.key_values(_examples(spark, sf_dir), "text_content", ["id"])


def addresses(spark, sf_dir):
    return st.addresses(_examples(spark, sf_dir), "text_content", ["id"])


def form_fields(spark, sf_dir):
    e = _examples(spark, sf_dir)
    return st.form_fields(key_values(spark, sf_dir), patterns.checkboxes(e, "text_content", ["id"]), ["id"])


def date_patterns(spark, sf_dir):
    """The dates of a document by format, in order of format and place."""
    m = _matches(spark, sf_dir).filter(F.col("pattern").isin(*st.DATE_PATTERNS))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in zip(st.DATE_PATTERNS, range(4)) for x in kv]), F.col("pattern"))
    order = feedback.Window.partitionBy("doc_id").orderBy(rank, "start_pos", "match_id")
    return m.select("doc_id", "match_id", F.col("pattern").alias("format"), F.row_number().over(order).alias("date_no"))


def numeric_values(spark, sf_dir):
    """Amounts of the currencies and percentages of fused texts with their places."""
    m = patterns.pattern_matches(_texts(spark, sf_dir), "text", ["doc_id"], ["currency", "percentage"])
    amount = F.when(F.col("pattern") == "currency", patterns.parse_currency(F.col("value"))).otherwise(F.translate("value", "%", "").cast("double"))
    return m.select("doc_id", "pattern", "start_pos", "end_pos", F.round(amount, 6).alias("amount"))


def structure_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


def _n(names=COUNTS):
    return {c: F.col(c) for c in names}


def layout_signatures(spark, sf_dir):
    sig = {k: F.round(v, 6).alias(k) for k, v in st.layout_signature(_n()).items()}
    return _counts(spark, sf_dir).select("doc_id", *sig.values())


def form_signatures(spark, sf_dir):
    sig = st.form_signature(_n())
    return _counts(spark, sf_dir).select("doc_id", *[(F.round(v, 6) if k == "empty_fields_ratio" else v).alias(k) for k, v in sig.items()])


def _signatures(spark, sf_dir):
    return scoring.keyword_signatures(_texts(spark, sf_dir), "text", "doc_id")


def _discovered(spark, sf_dir, counts):
    sig = _signatures(spark, sf_dir).withColumnRenamed("doc_id", "doc")
    return feedback.discovered_types(sig, counts.withColumnRenamed("doc_id", "doc"))


def discovered_types(spark, sf_dir):
    found = _discovered(spark, sf_dir, _counts(spark, sf_dir))
    return found.select(F.col("doc").alias("doc_id"), "type", F.round("confidence", 6).alias("confidence"))


#: The order in which types are discovered.
TYPES = ("government_form", "financial_document", "tabular_document", "form_document", "legal_document", "medical_document", "invoice_receipt", "report_letter")


def document_types(spark, sf_dir):
    """The best type of every fused document, how many were discovered and the first of them."""
    counts = _counts(spark, sf_dir)
    found = _discovered(spark, sf_dir, counts)
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    best = found.groupBy("doc").agg(F.count("*").alias("types"), F.min_by("type", rank).alias("first_type"), F.max_by("type", F.struct(F.round("confidence", 9), -rank)).alias("best_type"))
    every = counts.select(F.col("doc_id").alias("doc")).join(best, "doc", "left")
    return every.select(F.col("doc").alias("doc_id"), F.coalesce("types", F.lit(0)).alias("types"), "first_type", F.coalesce("best_type", F.lit("unknown_document")).alias("best_type"))


def classification_reasons(spark, sf_dir):
    sig = _signatures(spark, sf_dir).groupBy("doc_id").agg(*[F.max(F.when(F.col("family") == f, F.round("score", 9))).alias(f"s_{f}") for f in FAMILY_NAMES])
    both = _counts(spark, sf_dir).join(sig, "doc_id")
    why = st.reasons(_n(), list(KINDS), {name: F.col(f"s_{f}") for f, name in FAMILY_NAMES.items()})
    return both.select("doc_id", F.array_join(why, "; ").alias("reasons"))


def pattern_metadata(spark, sf_dir):
    top = st.dominant(_counts(spark, sf_dir), "doc_id", list(KINDS))
    return _r6(top.join(st.text_characteristics(_texts(spark, sf_dir), "text", "doc_id"), "doc_id"), "avg_word_length", "numeric_ratio")


def signature_similarities(spark, sf_dir):
    """Similarity of every example to the first example of its type by keywords, layout and counts, their mean, and why."""
    texts = load(spark, sf_dir, "document_examples").select("id", "text_content")
    none = spark.createDataFrame([], "id string, tables bigint")
    counts = st.structure_counts(texts, "text_content", "id", none, spark.createDataFrame([], "id string, pattern string"))
    first = load(spark, sf_dir, "document_examples").filter("document_type is not null").groupBy("document_type").agg(F.min("id").alias("first_id"))
    typed = load(spark, sf_dir, "document_examples").select("id", "document_type").join(first, "document_type")
    names = [c for c in counts.columns if c != "id"]
    b = counts.select(F.col("id").alias("first_id"), *[F.col(c).alias(f"b_{c}") for c in names])
    both = typed.join(counts, "id").join(b, "first_id")
    mine, theirs = _n(names), {c: F.col(f"b_{c}") for c in names}
    few = ("tables", "lists", "forms", "sections")
    alike = st.signature_similarity(st.layout_signature(mine), st.layout_signature(theirs))
    cosine = st.count_similarity({k: mine[k] for k in few}, {k: theirs[k] for k in few})
    sig = scoring.keyword_signatures(texts, "text_content", "id").groupBy("id").agg(*[F.max(F.when(F.col("family") == f, F.col("score"))).alias(f"s_{f}") for f in FAMILY_NAMES])
    other = sig.select(F.col("id").alias("first_id"), *[F.col(f"s_{f}").alias(f"t_{f}") for f in FAMILY_NAMES])
    words = st.signature_similarity({f: F.col(f"s_{f}") for f in FAMILY_NAMES}, {f: F.col(f"t_{f}") for f in FAMILY_NAMES})
    out = both.join(sig, "id").join(other, "first_id").select("id", "document_type", words.alias("k"), alike.alias("l"), cosine.alias("c"))
    why = F.array_join(st.similarity_reasons(F.col("k"), F.col("l")), "; ")
    return out.select(
        "id", "document_type", F.round("k", 6).alias("keyword_similarity"), F.round("l", 6).alias("layout_similarity"), F.round("c", 6).alias("count_similarity"),
        F.round((F.col("k") + F.col("l") + F.col("c")) / 3, 6).alias("similarity"), why.alias("reasons"),
    )


def structured_fields(spark, sf_dir):
    return st.structured_fields(key_values(spark, sf_dir), "id")


def review_prompts(spark, sf_dir):
    return st.review_prompts(key_values(spark, sf_dir), F.lit(0.8)).select("id", "pair_no", "confirm_amount", "verify", "critical")


def learning_opportunities(spark, sf_dir):
    total = sum((F.col(k) for k in KINDS), F.lit(0))
    c = _counts(spark, sf_dir).select("doc_id", total.alias("n")).join(document_types(spark, sf_dir), "doc_id").join(load(spark, sf_dir, "consensus").select("doc_id", "agreement_score"), "doc_id")
    found = st.learning_opportunities(F.col("first_type"), F.lit(0), F.col("n"), F.col("agreement_score"))
    return c.select("doc_id", F.array_join(found, "; ").alias("opportunities"), (F.col("types") > 1).alias("confirm_type"), st.specific_fields(F.col("best_type")).alias("specific_fields"))


def table_columns(spark, sf_dir):
    return st.table_columns(load(spark, sf_dir, "table_cells"))


def labelled_cells(spark, sf_dir):
    cells = load(spark, sf_dir, "table_cells").filter("text is not null")
    return cells.select("cell_id", st.cell_label(F.col("text"), F.col("col_idx")).alias("l")).select("cell_id", "l.label", "l.confidence")


def table_types(spark, sf_dir):
    cells = load(spark, sf_dir, "table_cells").groupBy("doc_id", "table_idx").agg(F.max(F.lower("text").contains("amount")).alias("amount"))
    kinds = load(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("document_type", F.lit(""))).alias("t"))
    return cells.join(kinds, "doc_id").select("doc_id", "table_idx", st.table_type(F.col("t"), F.coalesce("amount", F.lit(False))).alias("table_type"))


def table_structures(spark, sf_dir):
    boxes = F.transform("lines", lambda t: F.struct(t["text"].alias("text"), t["bbox"].alias("bbox"))).alias("lines")
    r = delivered_once(load(spark, sf_dir, "engine_results").select("result_id", "read_at", boxes))
    return _r6(st.table_structures(r), "x", "y", "w", "h")


QUERIES = {
    q.__name__: q
    for q in (
        key_values, addresses, form_fields, date_patterns, numeric_values, structure_counts, layout_signatures, form_signatures, discovered_types, document_types, classification_reasons, pattern_metadata,
        signature_similarities, structured_fields, review_prompts, learning_opportunities, table_columns, labelled_cells, table_types, table_structures,
    )
}


def _spans(table: str, key: str, text: str, p: str) -> str:
    """Matches m with groups a and b and their start s, numbered i, of a pattern with two groups or none."""
    groups = ", ".join(f"regexp_extract_all({text}, '{p}', {i}) as {c}" for i, c in ((1, "a"), (2, "b"))) if "])" in p or "})" in p else "[]::varchar[] as a, []::varchar[] as b"
    return f"""select k, i, m[i] as m, a[i] as a, b[i] as b, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s
 from (select *, unnest(range(1, len(m) + 1)) as i from (select {key} as k, regexp_extract_all({text}, '{p}') as m, {groups}, regexp_split_to_array({text}, '{p}') as g from {table} where {text} is not null))"""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _kv(table: str, key: str, text: str) -> str:
    """Recursive CTEs ending in kv (k, pair_no, key, value, separator, s, e)."""
    raw = " union all ".join(f"select k, {o} as o, '{sep}' as separator, {_strip('a')} as key, {_strip('b')} as value, s, s + length(m) as e from ({_spans(table, key, text, p)})" for o, (sep, p) in enumerate(st.KEY_VALUE_FORMS.items()))
    return f"""raw as ({raw}), c as (select *, row_number() over (partition by k order by s, o) as rn from raw where length(key) between 3 and 50 and value <> '' and length(key) - length(replace(key, ' ', '')) <= 5),
 nx as (select c.k, c.rn, min(d.rn) as nrn from c left join c d on c.k = d.k and d.s >= c.e group by all),
 kept as (select k, rn, nrn from nx where rn = 1 union all select nx.k, nx.rn, nx.nrn from kept join nx on nx.k = kept.k and nx.rn = kept.nrn),
 kv as (select c.*, row_number() over (partition by k order by rn) - 1 as pair_no from c join kept using (k, rn))"""


def _has(name: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({name}), '{w}')" for w in words) + ")"


_FAMILIES = " ".join("when " + _has("key", words.split()) + f" then '{kind}'" for kind, words in layout.FIELD_FAMILIES)
_BLANK = "(regexp_matches(value, '^[_\\-.]+$') or length(value) < 3)"


def _boxes(table: str, key: str, text: str) -> str:
    marks = "|".join(f"(?:{x})" for x in patterns.CHECKBOX)
    return f"select k, m[i] as mark, regexp_matches(m[i], '[xX✓☑■▣]') as checked from (select k, m, unnest(range(1, len(m) + 1)) as i from (select {key} as k, regexp_extract_all({text}, '{marks}') as m from {table} where {text} is not null))"


def _fields(table: str, key: str, text: str) -> str:
    return f"""frm as (select k, key as field_name, case {_FAMILIES} else 'text' end as field_type, case when {_BLANK} then '' else value end as field_value, not {_BLANK} as has_value, case when {_has('key', st.FIELD_INDICATORS)} then 0.8 else 0.6 end as confidence
 from kv where {_has('key', st.FIELD_INDICATORS)} or {_BLANK} union all select k, 'checkbox', 'checkbox', case when checked then 'checked' else 'unchecked' end, null, 0.7 from ({_boxes(table, key, text)}))"""


def _adr(table: str, key: str, text: str) -> str:
    return " union all ".join(f"select k, '{n}' as address_type, {_strip('m')} as value, s, s + length(m) as e, {c} as confidence from ({_spans(table, key, text, '(?i)' + p)})" for n, (p, c) in st.ADDRESSES.items())


def _lines(table: str, key: str, text: str) -> str:
    return f"select k, unnest(l) as line, unnest(range(len(l))) as line_no, len(l) - 1 as last_line from (select {key} as k, string_split({text}, chr(10)) as l from {table} where {text} is not null)"


def _counted(table: str, key: str, text: str, matches: str, tables: str) -> str:
    """CTEs ending in n, one row a text with COUNTS."""
    ln = _lines(table, key, text)
    runs = " union all ".join(
        f"select k from (select *, sum(case when hit then 0 else 1 end) over (partition by k order by line_no rows unbounded preceding) as run from (select *, regexp_matches(line, '{p}') as hit from ({ln}))) where hit group by k, run having count(*) >= 2 and max(line_no) < max(last_line)"
        for p in (patterns.NUMBERED, patterns.BULLETED)
    )
    heads = f"select k from ({ln}) where trim(line) <> '' and (" + " or ".join(f"regexp_matches(trim(line), '{p}')" for _, p in patterns.SECTIONS) + ")"
    one = lambda name, sql: f"select k, '{name}' as what from ({sql})"
    parts = [
        one("key_values", "select k from kv"), one("totals", "select k from kv where contains(lower(key), 'total')"), one("lists", runs), one("sections", heads), one("forms", "select k from frm"),
        one("checkbox_forms", "select k from frm where field_type = 'checkbox'"), one("signature_forms", "select k from frm where field_type = 'signature'"), one("empty_forms", "select k from frm where not has_value"),
        one("addresses", f"select k from ({_adr(table, key, text)})"), one("dates", f"select k from ({matches}) where pattern in {st.DATE_PATTERNS}"), one("currencies", f"select k from ({matches}) where pattern = 'currency'"),
        one("numbers", f"select k from ({matches}) where pattern in {tuple(patterns.NUMBER_CATEGORY)}"),
    ]
    names = [c for c in COUNTS if c != "tables"]
    sums = ", ".join(f"count(*) filter (what = '{c}') as {c}" for c in names)
    return f"""{_kv(table, key, text)}, {_fields(table, key, text)}, lo as ({' union all '.join(parts)}), g as (select k, {sums} from lo group by k),
 n as (select t.{key} as {key}, {', '.join(f'coalesce({c}, 0) as {c}' for c in names)}, coalesce(tb.tables, 0) as tables from {table} t left join g on g.k = t.{key} left join ({tables}) tb on tb.k = t.{key} where t.{text} is not null)"""


_EX = ("document_examples", "id", "text_content")
_DOC = "with recursive " + _counted("consensus", "doc_id", "consensus_text", "select distinct on (match_id) match_id, doc_id as k, pattern from pattern_matches", "select doc_id as k, count(distinct table_idx) as tables from table_cells group by doc_id")
_LAYOUT = {
    "table_density": "{p}tables / greatest({p}sections + {p}lists + {p}key_values, 1)", "form_field_ratio": "{p}forms / greatest({p}key_values, 1)", "list_dominance": "{p}lists / greatest({p}sections, 1)", "numeric_density": "{p}numbers / greatest({p}key_values, 1)",
    "structure_complexity": "(" + " + ".join(f"cast({{p}}{k} > 0 as int)" for k in KINDS) + ") / 10.0",
}


def _layout(p: str = "") -> dict[str, str]:
    return {k: "(" + v.replace("{p}", p) + ")" for k, v in _LAYOUT.items()}


_TYPED = f"""{_DOC}, {signature_sql('consensus', 'doc_id', 'consensus_text')}, found as (
 select doc_id, case family """ + " ".join(f"when '{f}' then '{t}'" for f, (t, _) in feedback.DISCOVERY.items()) + " end as type, score as confidence from sig where " + " or ".join(f"(family = '{f}' and score > {b})" for f, (_, b) in feedback.DISCOVERY.items()) + f"""
 union all select doc_id, 'tabular_document', {_layout()['table_density']} from n where {_layout()['table_density']} > 0.8
 union all select doc_id, 'form_document', least(forms / 20, 1.0) from n where forms > 10
 union all select doc_id, 'invoice_receipt', 0.8 from n where tables > 0 and (totals > 0 or currencies > 2)
 union all select doc_id, 'report_letter', 0.7 from n where sections > 2 and {_layout()['structure_complexity']} > 0.3 and {_layout()['form_field_ratio']} < 0.3),
 ranked as (select *, list_position({list(TYPES)}, type) as r from found),
 ty as (select n.doc_id, coalesce(count(type), 0) as types, arg_min(type, r) as first_type, coalesce(first(type order by round(confidence, 9) desc, r), 'unknown_document') as best_type from n left join ranked on ranked.doc_id = n.doc_id group by n.doc_id)"""


def _top(names, score, k: int) -> str:
    """The k highest of (score, name), ties in order, as a list of structs."""
    return "list_sort([" + ", ".join(f"{{'s': -({score(x)}), 'i': {i}, 'name': '{x}'}}" for i, x in enumerate(names)) + f"])[1:{k}]"


_WORDS = "list_filter(regexp_split_to_array(consensus_text, '\\s+'), lambda x: x <> '')"
_TOTAL = " + ".join(KINDS)

SQL = {
    "key_values": f"with recursive {_kv(*_EX)} select k as id, cast(pair_no as int) as pair_no, key, value, separator, cast(s as int) as start_pos, cast(e as int) as end_pos from kv",
    "addresses": f"select k as id, address_type, value, cast(s as int) as start_pos, cast(e as int) as end_pos, cast(confidence as double) as confidence from ({_adr(*_EX)})",
    "form_fields": f"with recursive {_kv(*_EX)}, {_fields(*_EX)} select k as id, field_name, field_type, field_value, has_value, cast(confidence as double) as confidence from frm",
    "date_patterns": f"""select doc_id, match_id, pattern as format, row_number() over (partition by doc_id order by list_position({list(st.DATE_PATTERNS)}, pattern), start_pos, match_id) as date_no
 from (select distinct on (match_id) match_id, doc_id, pattern, start_pos from pattern_matches where pattern in {st.DATE_PATTERNS})""",
    "numeric_values": " union all ".join(
        f"select k as doc_id, '{n}' as pattern, cast(s as int) as start_pos, cast(s + length(m) as int) as end_pos, round({v}, 6) as amount from ({_spans('consensus', 'doc_id', 'consensus_text', patterns.PATTERNS[n])})"
        for n, v in (("currency", "coalesce(try_cast(regexp_replace(m, '[$,]', '', 'g') as double), 0.0)"), ("percentage", "cast(replace(m, '%', '') as double)"))
    ),
    "structure_counts": f"{_DOC} select * from n",
    "layout_signatures": f"{_DOC} select doc_id, {', '.join(f'round({v}, 6) as {k}' for k, v in _layout().items())} from n",
    "form_signatures": f"{_DOC} select doc_id, forms as field_count, checkbox_forms > 0 as has_checkboxes, signature_forms > 0 as has_signatures, sections > 3 or tables > 0 as structured_layout, round(case when forms > 0 then empty_forms / forms else 0.0 end, 6) as empty_fields_ratio from n",
    "discovered_types": f"{_TYPED} select doc_id, type, round(confidence, 6) as confidence from found",
    "document_types": f"{_TYPED} select doc_id, types, first_type, best_type from ty",
    "classification_reasons": f"""{_TYPED}, sg as (select doc_id, {', '.join(f"round(max(score) filter (family = '{f}'), 9) as s_{f}" for f in FAMILY_NAMES)} from sig group by doc_id),
 b as (select n.*, sg.* exclude doc_id, {_top(KINDS, lambda x: x, 3)} as st, {_top(FAMILY_NAMES, lambda f: f's_{f}', 2)} as fs from n join sg using (doc_id))
 select doc_id, array_to_string(list_concat(list_transform(list_filter(st, lambda x: x.s < 0), lambda x: 'Contains ' || cast(-x.s as varchar) || ' ' || x.name), list_concat(
 list_transform(list_filter(fs, lambda x: x.s < -0.3), lambda x: 'High ' || case x.name {' '.join(f"when '{f}' then '{t}'" for f, t in FAMILY_NAMES.items())} end || ' keyword density'),
 list_filter([case when tables > 2 then 'Multiple tables suggest structured data document' end, case when forms > 5 then 'Multiple form fields suggest fillable form' end], lambda x: x is not null))), '; ') as reasons from b""",
    "pattern_metadata": f"""{_DOC}, w as (select doc_id, {_WORDS} as ws, len(string_split(consensus_text, chr(10))) as total_lines from consensus where consensus_text is not null)
 select doc_id, {_TOTAL} as total_patterns, array_to_string(list_transform({_top(KINDS, lambda x: x, 3)}, lambda x: x.name), ',') as dominant_patterns, len(ws) as total_words, total_lines,
 round(case when len(ws) > 0 then list_sum(list_transform(ws, lambda x: length(x))) / len(ws) else 0.0 end, 6) as avg_word_length, round(case when len(ws) > 0 then len(list_filter(ws, lambda x: regexp_matches(x, '\\d'))) / len(ws) else 0.0 end, 6) as numeric_ratio from n join w using (doc_id)""",
    "signature_similarities": "with recursive " + _counted(*_EX, "select null::varchar as k, null::varchar as pattern where false", "select null::varchar as k, 0 as tables where false") + f""",
 f as (select document_type, min(id) as first_id from document_examples where document_type is not null group by all), t as (select e.id, e.document_type, f.first_id from document_examples e join f using (document_type)),
 j as (select t.id, t.document_type, {', '.join(f'a.{c} as a_{c}, b.{c} as b_{c}' for c in COUNTS)} from t join n a on a.id = t.id join n b on b.id = t.first_id),
 cs as (select *, {' + '.join(f'a_{c} * b_{c}' for c in ('tables', 'lists', 'forms', 'sections'))} as dot, {' + '.join(f'a_{c} * a_{c}' for c in ('tables', 'lists', 'forms', 'sections'))} as aa, {' + '.join(f'b_{c} * b_{c}' for c in ('tables', 'lists', 'forms', 'sections'))} as bb from j),
 {signature_sql('document_examples', 'id', 'text_content')}, ks as (select id, {', '.join(f"max(score) filter (family = '{f}') as s_{f}" for f in FAMILY_NAMES)} from sig group by id),
 r as (select cs.id, cs.document_type, ({' + '.join(f'1 - abs(a.s_{f} - b.s_{f}) / greatest(a.s_{f}, b.s_{f}, 0.1)' for f in FAMILY_NAMES)}) / 5 as k, ({' + '.join(f'1 - abs({x} - {y}) / greatest({x}, {y}, 0.1)' for x, y in zip(_layout('a_').values(), _layout('b_').values()))}) / 5 as l,
 case when aa = 0 or bb = 0 then 0.0 else dot / (sqrt(aa) * sqrt(bb)) end as c from cs join t on t.id = cs.id join ks a on a.id = cs.id join ks b on b.id = t.first_id)
 select id, document_type, round(k, 6) as keyword_similarity, round(l, 6) as layout_similarity, round(c, 6) as count_similarity, round((k + l + c) / 3, 6) as similarity,
 array_to_string(list_filter([case when k > 0.7 then 'keyword_similarity: ' || printf('%.2f', k + 1e-9) end, case when l > 0.7 then 'layout_similarity: ' || printf('%.2f', l + 1e-9) end], lambda x: x is not null), '; ') as reasons from r""",
    "structured_fields": f"""with recursive {_kv(*_EX)}, l as (select k as id, key as field, arg_max(value, s) as value from kv group by k, key),
 t as (select *, case {' '.join('when ' + _has('field', w.split()) + f" then '{k}'" for k, w in st.CHECKED_KINDS)} else 'text' end as field_kind from l)
 select *, cast(case when case field_kind {' '.join(f"when '{k}' then regexp_matches(trim(value, ' '), '{p}')" for k, p in scoring.VALIDATORS.items())} else false end then 0.95 else 0.3 end as double) as confidence from t""",
    "review_prompts": f"with recursive {_kv(*_EX)} select k as id, cast(pair_no as int) as pair_no, true as confirm_amount, false as verify, false as critical from kv where contains(value, '$') or contains(lower(key), 'amount')",
    "learning_opportunities": f"""{_TYPED} select n.doc_id, array_to_string(list_filter(['new_document_type_discovered: ' || first_type, case when {_TOTAL} < 5 then 'sparse_pattern_detection' end, case when coalesce(agreement_score, 1.0) < 0.5 then 'high_engine_disagreement' end], lambda x: x is not null), '; ') as opportunities,
 types > 1 as confirm_type, case when contains(best_type, 'tax') or contains(best_type, 'form') then 'tax_fields' when contains(best_type, 'invoice') then 'invoice_fields' when contains(best_type, 'financial') then 'financial_fields' end as specific_fields
 from n join ty using (doc_id) join consensus using (doc_id)""",
    "table_columns": "select doc_id, table_idx, col_idx, string_agg(coalesce(text, ''), '|' order by row_idx, coalesce(text, '')) as values, count(*) as rows from table_cells group by all",
    "labelled_cells": "select cell_id, case when col_idx = 0 then 'description' when contains(text, '$') or regexp_matches(text, '\\d') then 'amount' else 'text' end as label, cast(case when col_idx = 0 then 0.8 when contains(text, '$') or regexp_matches(text, '\\d') then 0.9 else 0.5 end as double) as confidence from table_cells where text is not null",
    "table_types": """select c.doc_id, table_idx, case when contains(lower(coalesce(any_value(d.document_type), '')), 'financial') then 'financial_table' when bool_or(contains(lower(c.text), 'amount')) then 'amount_table' else 'general_table' end as table_type
 from table_cells c join documents d on d.doc_id = c.doc_id group by c.doc_id, table_idx""",
    "table_structures": """with once as (select * from engine_results qualify row_number() over (partition by result_id order by read_at) = 1), l as (select result_id, unnest(lines).bbox as b, unnest(lines).text as t, unnest(range(len(lines))) as line_no from once),
 s as (select *, len(case when contains(t, chr(9)) then string_split(t, chr(9)) when contains(t, '  ') then string_split(t, '  ') when contains(t, '|') then string_split(t, '|') when contains(t, ',') then string_split(t, ',') else [t] end) as cells,
 case when b.y - lag(b.y + b.h) over (partition by result_id order by b.y, line_no) > 20 then 1 else 0 end as new from l where b is not null),
 g as (select *, sum(new) over (partition by result_id order by b.y, line_no rows unbounded preceding) as group_no from s),
 e as (select result_id, group_no, floor(b.x / 10) as edge, count(*) as k, max(cells) as c, min(b.x) as x, min(b.y) as y, max(b.x + b.w) as r, max(b.y + b.h) as d from g group by all)
 select result_id, cast(group_no as bigint) as group_no, cast(sum(k) as bigint) as rows, max(c) as columns, cast(0.6 as double) as confidence, round(min(x), 6) as x, round(min(y), 6) as y, round(max(r) - min(x), 6) as w, round(max(d) - min(y), 6) as h
 from e group by result_id, group_no having sum(k) > 2 and max(k) >= 0.5 * sum(k)""",
}
