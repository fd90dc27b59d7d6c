"""Queries over the tool catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolweave.functions import text as tx
from toolweave.operators import conversations as cv
from toolweave.operators import tool_lists, tools as to
from toolweave.plans.base import LIST_SQL, MSG_SQL, TOOL_SQL, messages, records, tools

SPECIAL = ["hybrid_public_mix", "acebench_test"]
_S = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"


def _strip(x):
    return f"regexp_replace({x}, {_S}, '', 'g')"


def _keys(s, d):
    t = tools(s, d)
    name, text = F.col("name"), F.col("description")
    return t.select(
        "tool_id", F.md5(tx.text_key(name, text)).alias("text_key"), tx.signature(name).alias("name_signature"), F.md5(tx.collapsed(text)).alias("collapsed"),
        F.length(tx.without_space(text)).alias("n_marks"), tx.slug(F.col("server")).alias("slug"), tx.tool_signature(F.col("domain"), F.col("category"), name).alias("signature"), tx.report_text(text).alias("report"),
    )


def _calls(s, d):
    msg = messages(s, d).where("role = 'function_call'")
    return msg.select("conv_id", "pos", cv.call_name(F.col("value")).alias("name")).where("name IS NOT NULL")


def _listed(s, d):
    return tool_lists.listed_tools(records(s, d))


def _listed_counts(s, d):
    rows = tool_lists.elements(records(s, d), "tools", ["conv_id"])
    return rows.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("n_records"))


def _extracted(s, d):
    """D3: one tool per whitespace-free (name, description), the first by record and place."""
    rows = _listed(s, d).where("name IS NOT NULL").withColumn("k_name", tx.signature(F.col("name"))).withColumn("k_text", tx.signature(F.col("description")))
    first = rows.groupBy("k_name", "k_text").agg(F.min(F.struct("conv_id", "tool_pos")).alias("_m"))
    return first.select("k_name", "k_text", "_m.conv_id", "_m.tool_pos")


_CALL_SQL = MSG_SQL + """, called AS (SELECT conv_id, pos, CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN nullif(trim(json_extract_string(value, '$.name')), '') END AS name FROM msg WHERE role = 'function_call'),
calls AS (SELECT * FROM called WHERE name IS NOT NULL)"""
_NAMED = f"coalesce({_strip('name')}, '') <> ''"
_SIG = "translate(coalesce({0}, ''), ' ' || chr(9) || chr(10) || chr(13), '')"
_PAIR = f"{_SIG.format('name')}, {_SIG.format('description')}"
_ALLOWED = TOOL_SQL + ", " + LIST_SQL + ", ok AS (SELECT * FROM tool WHERE tool_id % 20 <> 0)"
_DSTRIP = _strip("coalesce(description, '')")
_LABELS = TOOL_SQL + f""", lab AS (SELECT tool_id, regexp_replace(regexp_replace(coalesce(name, ''), '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') AS kn, regexp_replace(regexp_replace(coalesce(description, ''), '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') AS kd,
nullif({_strip('category')}, '') AS category, nullif({_strip('domain')}, '') AS domain FROM tool),
ref AS (SELECT kn, kd, coalesce(arg_max({{'c': category, 'd': domain}}, tool_id) FILTER (category IS NOT NULL AND domain IS NOT NULL), arg_min({{'c': category, 'd': domain}}, tool_id)) AS l
FROM lab WHERE tool_id % 3 = 0 AND (category IS NOT NULL OR domain IS NOT NULL) GROUP BY ALL),
enr AS (SELECT a.tool_id, coalesce(a.category, l.c) AS category, coalesce(a.domain, l.d) AS domain, l IS NOT NULL AS matched FROM lab a LEFT JOIN ref r ON a.kn = r.kn AND a.kd = r.kd)"""
_ACROSS = TOOL_SQL + f""", x AS (SELECT *, row_number() OVER (PARTITION BY source_file, name, description ORDER BY tool_id) AS n, min(source_file) OVER (PARTITION BY name, description) AS lo, max(source_file) OVER (PARTITION BY name, description) AS hi FROM tool),
kept AS (SELECT * FROM x WHERE source_file IN ({", ".join(f"'{x}'" for x in SPECIAL)}) OR NOT ({_NAMED}) OR n = 1 AND lo = hi)"""


def _ref(s, d):
    return tools(s, d).where("tool_id % 3 = 0")


def _usage(s, d):
    return to.usage(_calls(s, d))


def _allow(s, d):
    return tools(s, d).where("tool_id % 20 <> 0")


QUERIES = {
    "tool_key_normalise": (_keys, f"""WITH {TOOL_SQL} SELECT tool_id,
md5({_strip("regexp_replace(" + _strip("coalesce(name, '')") + " || chr(10) || " + _strip("coalesce(description, '')") + ", '\\n+', chr(10), 'g')")}) AS text_key,
translate(coalesce(name, ''), ' ' || chr(9) || chr(10) || chr(13), '') AS name_signature,
md5(regexp_replace(regexp_replace(description, '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')) AS collapsed, length(regexp_replace(description, '[\\s\\p{{Z}}]', '', 'g'))::INT AS n_marks,
regexp_replace(regexp_replace(regexp_replace(lower(server), '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
coalesce(domain, 'NA') || '::' || coalesce(category, 'NA') || '::' || coalesce(name, 'NA') AS signature, left(description, 100) AS report FROM tool"""),
    "tool_dedup_first": (lambda s, d: to.dedup_first(tools(s, d)).select("tool_id"), f"""WITH {TOOL_SQL}, k AS (SELECT tool_id, row_number() OVER (PARTITION BY {_strip("coalesce(name, '')")}, {_strip("coalesce(description, '')")} ORDER BY source_file, tool_id) AS n, {_NAMED} AS named FROM tool)
SELECT tool_id FROM k WHERE NOT named OR n = 1"""),
    "tool_dedup_crossfile": (lambda s, d: to.dedup_across_files(tools(s, d), SPECIAL).select("tool_id"), f"WITH {_ACROSS} SELECT tool_id FROM kept"),
    "tool_dedup_keep_first": (lambda s, d: to.dedup_across_files(tools(s, d), SPECIAL, "keep_first").select("tool_id"), f"""WITH {_ACROSS} SELECT tool_id FROM x WHERE source_file IN ({", ".join(f"'{x}'" for x in SPECIAL)}) OR NOT ({_NAMED}) OR n = 1 AND source_file = lo"""),
    "tool_dedup_report": (lambda s, d: to.file_report(tools(s, d), to.dedup_across_files(tools(s, d), SPECIAL)), f"""WITH {_ACROSS}, f AS (SELECT t.source_file, k.tool_id IS NOT NULL AS k FROM tool t LEFT JOIN kept k USING (tool_id))
SELECT source_file, count(*) AS total, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS removed, round(100.0 * count(*) FILTER (NOT k) / count(*), 2) AS pct FROM f GROUP BY ROLLUP (source_file)"""),
    "tool_extract": (_extracted, f"WITH {LIST_SQL}, k AS (SELECT {_SIG.format('name')} AS k_name, {_SIG.format('description')} AS k_text, conv_id, tool_pos, row_number() OVER (PARTITION BY {_PAIR} ORDER BY conv_id, tool_pos) AS n FROM lst WHERE name IS NOT NULL) SELECT k_name, k_text, conv_id, tool_pos FROM k WHERE n = 1"),
    "tool_containers": (_listed_counts, f"WITH {LIST_SQL} SELECT container_kind, count(*) AS n, count(DISTINCT conv_id) AS n_records FROM els GROUP BY 1"),
    "listed_tools": (lambda s, d: _listed(s, d).select("conv_id", "tool_pos", "name", "category", "domain"), f"WITH {LIST_SQL} SELECT conv_id, tool_pos, name, category, domain FROM lst"),
    "time_tool_filter": (lambda s, d: to.time_tools(tools(s, d)).select("tool_id"), f"""WITH {TOOL_SQL}, j AS (SELECT tool_id, description, CASE WHEN json_valid(input_schema) AND json_type(input_schema) = 'OBJECT' THEN input_schema::JSON END AS x FROM tool),
n AS (SELECT tool_id, description, CASE WHEN json_type(x, '$.properties') = 'OBJECT' THEN json_keys(x, '$.properties') ELSE [] END AS p, json_extract(x, '$.properties') AS o, CASE WHEN json_type(x, '$.required') = 'ARRAY' THEN json_extract_string(x, '$.required[*]') ELSE [] END AS r FROM j),
e AS (SELECT tool_id, list_concat([description], p, list_transform(p, lambda k: json_extract_string(json_extract(o, '$."' || k || '"'), '$.description')), r) AS t FROM n)
SELECT tool_id FROM e WHERE len(list_filter(t, lambda y: regexp_matches(lower(y), '{tx.TIME_LOWER}') OR regexp_matches(y, '{tx.TIME_CAMEL}'))) > 0"""),
    "empty_schema_filter": (lambda s, d: to.without_empty_schema(tools(s, d)).select("tool_id"), f"""WITH {TOOL_SQL}, j AS (SELECT tool_id, CASE WHEN json_valid(input_schema) AND json_type(input_schema) = 'OBJECT' THEN input_schema END AS x FROM tool),
k AS (SELECT tool_id, x, json_type(x, '$.properties') AS t, CASE WHEN json_type(x, '$.properties') = 'OBJECT' THEN json_keys(x, '$.properties') ELSE [] END AS p FROM j)
SELECT tool_id FROM k WHERE x IS NULL OR coalesce(t, 'NULL') NOT IN ('NULL', 'OBJECT') OR t = 'OBJECT' AND len(list_filter(p, lambda y: y NOT IN ({", ".join(f"'{m}'" for m in to.META_NAMES)}))) > 0"""),
    "cjk_tools": (lambda s, d: to.cjk_tools(tools(s, d)).select("tool_id"), f"WITH {TOOL_SQL} SELECT tool_id FROM tool WHERE regexp_matches(concat_ws(' ', name, description, category, domain, input_schema), '{tx.CJK_TOOL}')"),
    "rejected_tools": (lambda s, d: to.rejected(tools(s, d)), f"""WITH {TOOL_SQL}, r AS (SELECT tool_id, CASE WHEN NOT ({_NAMED}) THEN 'no_name' WHEN coalesce({_strip('description')}, '') = '' AND coalesce({_strip("json_extract_string(CASE WHEN json_valid(input_schema) THEN input_schema END, '$.description')")}, '') = '' THEN 'no_description' END AS reason FROM tool)
SELECT * FROM r WHERE reason IS NOT NULL"""),
    "label_status": (lambda s, d: to.label_status(tools(s, d)), f"""WITH {TOOL_SQL}, l AS (SELECT CASE WHEN category IS NULL THEN 'null' WHEN {_strip('category')} = '' THEN 'empty_string' WHEN {_strip('category')} IN ('[]', '{{}}') THEN 'empty_list' ELSE 'valid' END AS category_state,
CASE WHEN domain IS NULL THEN 'null' WHEN {_strip('domain')} = '' THEN 'empty_string' WHEN {_strip('domain')} IN ('[]', '{{}}') THEN 'empty_list' ELSE 'valid' END AS domain_state FROM tool) SELECT *, count(*) AS n FROM l GROUP BY ALL"""),
    "label_enrichment": (lambda s, d: to.enrich_labels(tools(s, d), _ref(s, d)), f"WITH {_LABELS} SELECT * FROM enr"),
    "label_unmatched": (lambda s, d: to.enrich_labels(tools(s, d), _ref(s, d)).where("NOT matched AND (category IS NULL OR domain IS NULL)").select("tool_id"), f"WITH {_LABELS} SELECT tool_id FROM enr WHERE NOT matched AND (category IS NULL OR domain IS NULL)"),
    "used_tools_semi": (lambda s, d: to.used_tools(tools(s, d), _listed(s, d)).select("tool_id"), f"WITH {TOOL_SQL}, {LIST_SQL} SELECT tool_id FROM tool WHERE ({_PAIR}) IN (SELECT ({_PAIR}) FROM lst)"),
    "unused_tools_anti": (lambda s, d: to.used_tools(tools(s, d), _listed(s, d), keep=False).select("tool_id"), f"WITH {TOOL_SQL}, {LIST_SQL} SELECT tool_id FROM tool WHERE ({_PAIR}) NOT IN (SELECT ({_PAIR}) FROM lst)"),
    "used_by_name": (lambda s, d: to.used_by_name(tools(s, d), _calls(s, d)).select("tool_id"), f"""WITH {TOOL_SQL}, {_CALL_SQL} SELECT tool_id FROM tool WHERE translate(coalesce(name, ''), ' ' || chr(9) || chr(10) || chr(13), '') IN (SELECT translate(name, ' ' || chr(9) || chr(10) || chr(13), '') FROM calls)"""),
    "removed_by_name": (lambda s, d: to.used_by_name(tools(s, d), _calls(s, d), keep=False).select("tool_id"), f"""WITH {TOOL_SQL}, {_CALL_SQL} SELECT tool_id FROM tool WHERE translate(coalesce(name, ''), ' ' || chr(9) || chr(10) || chr(13), '') NOT IN (SELECT translate(name, ' ' || chr(9) || chr(10) || chr(13), '') FROM calls)"""),
    "tool_lookup": (lambda s, d: to.lookup(_calls(s, d), tools(s, d)).select("conv_id", "pos", "tool_id"), f"""WITH {TOOL_SQL}, {_CALL_SQL}, a AS (SELECT name, max(tool_id) AS i FROM tool WHERE name IS NOT NULL GROUP BY 1), b AS (SELECT lower(name) AS name, max(tool_id) AS i FROM tool WHERE name IS NOT NULL GROUP BY 1)
SELECT conv_id, pos, coalesce(a.i, b.i) AS tool_id FROM calls c LEFT JOIN a ON a.name = c.name LEFT JOIN b ON b.name = lower(c.name)"""),
    "first_of_name": (lambda s, d: to.first_of_name(tools(s, d)), f"WITH {TOOL_SQL}, r AS (SELECT name, tool_id, row_number() OVER (PARTITION BY name ORDER BY source_file, tool_id) AS n FROM tool WHERE name IS NOT NULL) SELECT name, tool_id FROM r WHERE n = 1"),
    "allowlist_by_name": (lambda s, d: to.allowed_by_listed(_listed(s, d), _allow(s, d), ["name"]), f"WITH {_ALLOWED} SELECT DISTINCT conv_id FROM lst WHERE {_NAMED} AND {_strip('name')} NOT IN (SELECT {_strip('name')} FROM ok WHERE name IS NOT NULL)"),
    "allowlist_by_pair": (lambda s, d: to.allowed_by_listed(_listed(s, d), _allow(s, d), ["name", "description"]), f"WITH {_ALLOWED} SELECT DISTINCT conv_id FROM lst WHERE {_NAMED} AND ({_strip('name')}, {_DSTRIP}) NOT IN (SELECT ({_strip('name')}, {_DSTRIP}) FROM ok WHERE name IS NOT NULL)"),
    "allowlist_called": (lambda s, d: to.allowed_by_called(_calls(s, d), _listed(s, d), _allow(s, d)), f"WITH {_ALLOWED}, {_CALL_SQL}, own AS (SELECT conv_id, name, arg_max(description, tool_pos) AS description FROM lst WHERE name IS NOT NULL GROUP BY ALL), p AS (SELECT DISTINCT c.conv_id, c.name, o.description FROM calls c LEFT JOIN own o ON o.conv_id = c.conv_id AND o.name = c.name) SELECT DISTINCT conv_id FROM p WHERE ({_strip('name')}, {_DSTRIP}) NOT IN (SELECT ({_strip('name')}, {_DSTRIP}) FROM ok WHERE name IS NOT NULL)"),
    "name_overlap": (lambda s, d: to.name_overlap(tools(s, d)), f"WITH {TOOL_SQL}, n AS (SELECT DISTINCT source_file, name FROM tool WHERE name IS NOT NULL) SELECT a.source_file AS file_a, b.source_file AS file_b, count(*) AS common FROM n a JOIN n b ON a.name = b.name AND a.source_file < b.source_file GROUP BY ALL"),
    "name_intersection": (lambda s, d: tools(s, d).where("name IS NOT NULL").select("name").intersect(_calls(s, d).select("name")), f"WITH {TOOL_SQL}, {_CALL_SQL} SELECT name FROM tool INTERSECT SELECT name FROM calls"),
    "name_difference": (lambda s, d: tools(s, d).where("name IS NOT NULL").select("name").subtract(_calls(s, d).select("name")), f"WITH {TOOL_SQL}, {_CALL_SQL} SELECT name FROM tool WHERE name IS NOT NULL EXCEPT SELECT name FROM calls"),
    "inverse_frequency_weights": (lambda s, d: to.inverse_frequency(tools(s, d), "category", to.CATEGORIES), f"""WITH {TOOL_SQL}, l AS (SELECT unnest([{", ".join(f"'{c}'" for c in to.CATEGORIES)}]) AS category), c AS (SELECT lower({_strip('category')}) AS category, count(*) AS n FROM tool GROUP BY 1),
w AS (SELECT l.category, coalesce(n, 0) AS n, 1.0::DOUBLE / (coalesce(n, 0) + 1) AS w FROM l LEFT JOIN c ON c.category = l.category) SELECT category, n, round(w / sum(w) OVER (), 9) AS weight FROM w"""),
    "tool_usage": (_usage, f"WITH {_CALL_SQL} SELECT name, count(*) AS n FROM calls GROUP BY 1"),
    "usage_top_bottom": (lambda s, d: to.top_bottom(_usage(s, d)), f"""WITH {_CALL_SQL}, u AS (SELECT name, count(*) AS n FROM calls GROUP BY 1), r AS (SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS a, row_number() OVER (ORDER BY n, name) AS b FROM u)
SELECT 'top' AS side, a::INT AS rank, name, n FROM r WHERE a <= 5 UNION ALL SELECT 'bottom', b::INT, name, n FROM r WHERE b <= 5"""),
    "next_tool_id": (lambda s, d: to.next_id(tools(s, d), "tool_id"), f"WITH {TOOL_SQL} SELECT max(tool_id) + 1 AS next_id FROM tool"),
    "pool_merge_last": (lambda s, d: to.last_by(tools(s, d).where("name IS NOT NULL"), ["name"], ["source_file", "tool_id"]).select("name", "tool_id"), f"WITH {TOOL_SQL}, r AS (SELECT name, tool_id, row_number() OVER (PARTITION BY name ORDER BY source_file DESC, tool_id DESC) AS n FROM tool WHERE name IS NOT NULL) SELECT name, tool_id FROM r WHERE n = 1"),
    "suffix_lookup": (lambda s, d: to.suffix_lookup(_calls(s, d), tools(s, d)).select("conv_id", "pos", "matched"), f"""WITH {TOOL_SQL}, {_CALL_SQL}, n AS (SELECT DISTINCT name FROM tool) SELECT conv_id, pos, coalesce(a.name, b.name) AS matched FROM calls c LEFT JOIN n a ON a.name = c.name LEFT JOIN n b ON b.name = regexp_replace(c.name, '_[0-9]+$', '')"""),
    "distinct_counts": (lambda s, d: tools(s, d).agg(F.countDistinct("name").alias("names"), F.countDistinct("name", "description").alias("pairs"), F.countDistinct("server").alias("servers")), f"WITH {TOOL_SQL} SELECT count(DISTINCT name) AS names, count(DISTINCT CASE WHEN name IS NOT NULL AND description IS NOT NULL THEN name || chr(1) || description END) AS pairs, count(DISTINCT server) AS servers FROM tool"),
    "domain_pool": (lambda s, d: to.domain_pool(tools(s, d), "Finance").select("tool_id"), f"WITH {TOOL_SQL} SELECT tool_id FROM tool WHERE lower({_strip('domain')}) = 'finance'"),
    "file_properties": (lambda s, d: messages(s, d).select("source_file").distinct().select("source_file", tx.file_properties(F.col("source_file"))["hop"].alias("hop"), tx.file_properties(F.col("source_file"))["strategy"].alias("strategy")),
        f"WITH {MSG_SQL} SELECT DISTINCT source_file, CASE WHEN contains(lower(source_file), 'multi-hop') AND NOT contains(lower(source_file), 'single-hop') THEN 'multi-hop' ELSE 'single-hop' END AS hop, CASE WHEN contains(lower(source_file), 'parallel') THEN 'Parallel' WHEN contains(lower(source_file), 'serial') THEN 'Serial' ELSE '' END AS strategy FROM msg"),
    "file_match": (lambda s, d: to.file_match(messages(s, d).select(F.concat(F.lit("pred_"), "source_file").alias("file")).distinct(), tools(s, d).select("source_file").union(messages(s, d).select("source_file")).distinct().withColumnRenamed("source_file", "file")), None),
}
