"""Queries over messages and conversation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolweave.functions import text as tx
from toolweave.operators import conversations as cv
from toolweave.plans.base import LIST_SQL, MSG_SQL, REC_SQL, TURN_SQL, messages, records


def _hop_turn_stats(s, d):
    return cv.hop_turn_stats(messages(s, d))


def _turn_distribution(s, d):
    return cv.turn_distribution(messages(s, d))


def _turn_hops(s, d):
    return cv.turn_hops(messages(s, d))


def _direct(s, d):
    return cv.direct_answers(messages(s, d))


def _direct_filter(s, d):
    return cv.without_direct_answers(messages(s, d)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def _direct_by_file(s, d):
    msg = messages(s, d)
    files = msg.groupBy("conv_id").agg(F.min("source_file").alias("source_file"))
    by = cv.direct_answers(msg).join(files, "conv_id").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if("direct").alias("n_direct"), F.min(F.when(F.col("direct"), F.col("conv_id"))).alias("example"))
    return by.select("source_file", "n", "n_direct", F.round(100 * F.col("n_direct") / F.col("n"), 2).alias("pct"), "example")


def _flow(s, d):
    return cv.flow_issues(messages(s, d))


def _flow_counts(s, d):
    return cv.issue_counts(cv.flow_issues(messages(s, d)))


def _empty_calls(s, d):
    return cv.empty_calls(messages(s, d))


def _empty_arguments(s, d):
    return cv.empty_arguments(messages(s, d))


def _empty_argument_tools(s, d):
    return cv.empty_arguments(messages(s, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _empty_tool_lists(s, d):
    rec = records(s, d)
    stripped = tx.strip(F.col("tools"))
    empty = stripped.isin("", "[]") | (F.json_array_length("tools") == 0)
    return rec.where(F.coalesce(empty, F.lit(False))).select("conv_id")


def _answer_tags(s, d):
    out = cv.answer_tags(messages(s, d))
    return out.select("conv_id", "pos", "role", F.md5(F.coalesce("value", F.lit("-"))).alias("h"))


def _mask(s, d):
    out = cv.training_mask(messages(s, d))
    return out.select("conv_id", "pos", "role", F.md5(F.coalesce("value", F.lit("-"))).alias("h"))


def _answer_content(s, d):
    tagged = cv.answer_tags(messages(s, d)).where("role = 'gpt'")
    return tagged.select("conv_id", "pos", F.length(cv.tag_content(F.col("value"), "answer")).alias("n"))


def _history(s, d):
    h = cv.history(messages(s, d), 2)
    return h.select("conv_id", "pos", "n_before", F.md5("history").alias("h"))


def _ordinals(s, d):
    return cv.ordinals(messages(s, d)).select("conv_id", "pos", "n_call", "n_answer", "last_observation")


def _used(s, d):
    return cv.used_tools(messages(s, d))


def _first_call(s, d):
    return cv.first_call(messages(s, d))


def _audit(s, d):
    return cv.answer_audit(messages(s, d))


def _cjk(pattern):
    def run(s, d):
        rows = messages(s, d).withColumn("key", F.col("conv_id") * 100000 + F.col("pos"))
        return cv.cjk_by_file(rows, "source_file", "key", "value", pattern)

    return run


def _offending(s, d):
    rows = messages(s, d).where(F.col("value").rlike(tx.NON_ENGLISH))
    return rows.select("conv_id", "pos", F.array_join(tx.offending(F.col("value")), "").alias("characters"))


def _metadata(s, d):
    return cv.metadata_turns(records(s, d))


def _property_counts(s, d):
    entries = records(s, d).select(F.explode("properties").alias("property", "value"))
    return entries.groupBy("property", "value").agg(F.count(F.lit(1)).alias("n"))


def _blocks(s, d):
    return cv.observation_blocks(messages(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_items").cast("bigint").alias("n_items"))


def _results(s, d):
    return cv.paired_results(messages(s, d))


def _unlisted(s, d):
    from toolweave.operators import tool_lists

    listed = tool_lists.listed_tools(records(s, d))
    calls = cv.used_tools(messages(s, d)).select("conv_id", "name")
    return calls.join(listed.select("conv_id", "name").distinct(), ["conv_id", "name"], "left_anti")


def _item_ids(s, d):
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("\x01", "role", F.coalesce("value", F.lit("\x02"))).alias("line"))))
    return messages(s, d).groupBy("conv_id").agg(F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), "\x03")).alias("item_id"))


_CALL = "CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN nullif(trim(json_extract_string(value, '$.name'), chr(32)||chr(9)||chr(10)||chr(13)), '') END"
_HIT = "(regexp_matches(value, '{0}'))"


def _cjk_sql(pattern):
    return f"""WITH {MSG_SQL}, h AS (SELECT source_file, conv_id * 100000 + pos AS key, coalesce(regexp_matches(value, '{pattern}'), false) AS hit FROM msg)
SELECT source_file, count(*) AS n, count(*) FILTER (hit) AS n_cjk, round(100.0 * count(*) FILTER (hit) / count(*), 2) AS pct, min(key) FILTER (hit) AS example FROM h GROUP BY source_file"""


_BAD_CALL = """(json_type(value) <> 'OBJECT' OR json_type(value, '$.name') IS NULL OR json_type(value, '$.arguments') = 'VARCHAR' AND NOT json_valid(json_extract_string(value, '$.arguments')))"""

QUERIES = {
    "hop_turn_stats": (_hop_turn_stats, f"""WITH {TURN_SQL},
conv AS (SELECT conv_id, count(*) FILTER (role = 'human') AS n FROM msg GROUP BY 1),
k AS (SELECT 'conversation' AS kind, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'single-turn' ELSE 'multi-turn' END AS label FROM conv
      UNION ALL SELECT 'turn', CASE WHEN n_calls >= 2 THEN 'multi-hop' ELSE 'single-hop' END FROM hop),
c AS (SELECT kind, label, count(*) AS n FROM k GROUP BY ALL)
SELECT kind, label, n, round(n / sum(n) OVER (PARTITION BY kind), 6)::DOUBLE AS share FROM c"""),
    "turn_distribution": (_turn_distribution, f"WITH {MSG_SQL}, c AS (SELECT conv_id, count(*) FILTER (role = 'human') AS n_turns FROM msg GROUP BY 1) SELECT n_turns, count(*) AS n FROM c GROUP BY 1"),
    "turn_hops": (_turn_hops, f"WITH {TURN_SQL} SELECT conv_id, turn, n_calls, CASE WHEN n_calls >= 2 THEN 'multi-hop' ELSE 'single-hop' END AS hop FROM hop"),
    "direct_answers": (_direct, f"WITH {TURN_SQL} SELECT conv_id, coalesce(bool_or(role = 'human' AND nxt IN ('gpt', 'assistant')), false) AS direct FROM turned GROUP BY 1"),
    "direct_answer_filter": (_direct_filter, f"WITH {TURN_SQL} SELECT conv_id, count(*) AS n FROM msg WHERE conv_id NOT IN (SELECT conv_id FROM turned WHERE role = 'human' AND nxt IN ('gpt', 'assistant')) GROUP BY 1"),
    "direct_answer_by_file": (_direct_by_file, f"""WITH {TURN_SQL}, c AS (SELECT conv_id, min(source_file) AS source_file, coalesce(bool_or(role = 'human' AND nxt IN ('gpt', 'assistant')), false) AS x FROM turned GROUP BY 1)
SELECT source_file, count(*) AS n, count(*) FILTER (x) AS n_direct, round(100.0 * count(*) FILTER (x) / count(*), 2) AS pct, min(conv_id) FILTER (x) AS example FROM c GROUP BY 1"""),
    "flow_issues": (_flow, f"""WITH {TURN_SQL}, f AS (SELECT conv_id, CASE WHEN role = 'function_call' AND nxt IS NULL THEN 'incomplete_flow' END AS a,
CASE WHEN role = 'function_call' AND nxt <> 'observation' OR role = 'observation' AND nxt NOT IN ('gpt', 'function_call') THEN 'invalid_flow' END AS b,
CASE WHEN role = 'function_call' AND NOT coalesce(json_valid(value), false) THEN 'invalid_json' WHEN role = 'function_call' AND {_BAD_CALL} THEN 'invalid_function_call_json' END AS c FROM turned)
SELECT DISTINCT conv_id, issue FROM (SELECT conv_id, unnest([a, b, c]) AS issue FROM f) WHERE issue IS NOT NULL"""),
    "flow_issue_counts": (_flow_counts, f"""WITH {TURN_SQL}, f AS (SELECT conv_id, CASE WHEN role = 'function_call' AND nxt IS NULL THEN 'incomplete_flow' END AS a,
CASE WHEN role = 'function_call' AND nxt <> 'observation' OR role = 'observation' AND nxt NOT IN ('gpt', 'function_call') THEN 'invalid_flow' END AS b,
CASE WHEN role = 'function_call' AND NOT coalesce(json_valid(value), false) THEN 'invalid_json' WHEN role = 'function_call' AND {_BAD_CALL} THEN 'invalid_function_call_json' END AS c FROM turned)
SELECT issue, count(DISTINCT conv_id) AS n FROM (SELECT conv_id, unnest([a, b, c]) AS issue FROM f) WHERE issue IS NOT NULL GROUP BY 1"""),
    "empty_call_filter": (_empty_calls, f"WITH {MSG_SQL} SELECT DISTINCT conv_id FROM msg WHERE role = 'function_call' AND ({_CALL}) IS NULL"),
    "empty_args_filter": (_empty_arguments, f"""WITH {MSG_SQL}, c AS (SELECT conv_id, pos, {_CALL} AS name, json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.arguments') AS a FROM msg WHERE role = 'function_call')
SELECT conv_id, pos, name FROM c WHERE name IS NOT NULL AND coalesce(regexp_replace(a, '\\s+', '', 'g'), '{{}}') = '{{}}'"""),
    "empty_args_tools": (_empty_argument_tools, f"""WITH {MSG_SQL}, c AS (SELECT {_CALL} AS name, json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.arguments') AS a FROM msg WHERE role = 'function_call')
SELECT name, count(*) AS n FROM c WHERE name IS NOT NULL AND coalesce(regexp_replace(a, '\\s+', '', 'g'), '{{}}') = '{{}}' GROUP BY 1"""),
    "empty_tool_lists": (_empty_tool_lists, f"WITH {REC_SQL} SELECT conv_id FROM rec WHERE trim(tools, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) IN ('', '[]') OR CASE WHEN json_valid(tools) AND json_type(tools) = 'ARRAY' THEN json_array_length(tools) = 0 ELSE false END"),
    "answer_tag": (_answer_tags, f"""WITH {MSG_SQL} SELECT conv_id, pos, role, md5(coalesce(CASE WHEN role = 'gpt' THEN CASE WHEN coalesce(regexp_replace(value, '[\\s\\p{{Z}}]', '', 'g'), '') = '' THEN '<answer></answer>' ELSE '<answer>' || value || '</answer>' END ELSE value END, '-')) AS h FROM msg"""),
    "train_mask": (_mask, f"WITH {MSG_SQL} SELECT conv_id, pos, role, md5(coalesce(CASE role WHEN 'observation' THEN '' WHEN 'gpt' THEN '<answer></answer>' ELSE value END, '-')) AS h FROM msg"),
    "answer_content": (_answer_content, f"""WITH {MSG_SQL} SELECT conv_id, pos, length(nullif(regexp_replace(coalesce(value, ''), '^\\s+|\\s+$', '', 'g'), ''))::INT AS n FROM msg WHERE role = 'gpt'"""),
    "chat_history_prefix": (_history, f"""WITH {MSG_SQL}, m AS (SELECT *, count(*) FILTER (role = 'function_call') OVER w AS n, count(*) FILTER (value IS NULL) OVER w AS stop FROM msg WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT conv_id, pos AS at FROM m WHERE role = 'function_call' AND n = 2)
SELECT c.conv_id, c.at AS pos, count(m.pos) AS n_before, md5(coalesce(string_agg(m.role || ': ' || m.value, chr(10) ORDER BY m.pos), '')) AS h
FROM cut c LEFT JOIN m ON m.conv_id = c.conv_id AND m.pos < c.at AND m.stop = 0 GROUP BY ALL"""),
    "message_ordinals": (_ordinals, f"""WITH {MSG_SQL} SELECT conv_id, pos, count(*) FILTER (role = 'function_call') OVER w AS n_call, count(*) FILTER (role IN ('gpt', 'assistant')) OVER w AS n_answer,
max(pos) FILTER (role = 'observation') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_observation FROM msg WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"""),
    "used_tools": (_used, f"""WITH {MSG_SQL}, f AS (SELECT conv_id, {_CALL} AS name, min(pos) AS first_pos FROM msg WHERE role = 'function_call' GROUP BY ALL)
SELECT conv_id, name, first_pos, (row_number() OVER (PARTITION BY conv_id ORDER BY first_pos))::INT AS rank FROM f WHERE name IS NOT NULL"""),
    "first_call": (_first_call, f"WITH {MSG_SQL} SELECT conv_id, min(pos) AS pos, arg_min_null(value, pos) AS value FROM msg WHERE role = 'function_call' GROUP BY 1"),
    "last_answer_audit": (_audit, f"""WITH {MSG_SQL}, a AS (SELECT conv_id, list(value ORDER BY pos) AS v FROM msg WHERE role IN ('gpt', 'assistant') GROUP BY 1)
SELECT count(*) AS conversations, sum(len(v))::BIGINT AS answers, count(*) FILTER (coalesce(regexp_replace(v[-1], '[\\s\\p{{Z}}]', '', 'g'), '') = '') AS blank_last,
count(*) FILTER (len(v) > 1 AND v[-1] = v[-2]) AS same_last, count(*) FILTER (len(v) = 1) AS single_answer FROM a"""),
    "cjk_scan_a": (_cjk(tx.CJK_TOOL), _cjk_sql(tx.CJK_TOOL)),
    "cjk_scan_b": (_cjk(tx.CJK_STATISTICS), _cjk_sql(tx.CJK_STATISTICS)),
    "cjk_scan_c": (_cjk(tx.NON_ENGLISH), _cjk_sql(tx.NON_ENGLISH)),
    "cjk_scan_d": (_cjk(tx.CJK_GUARD), _cjk_sql(tx.CJK_GUARD)),
    "offending_characters": (_offending, None),
    "metadata_turns": (_metadata, f"WITH {REC_SQL}, e AS (SELECT conv_id, unnest(map_entries(properties)) AS e FROM rec) SELECT conv_id, e.key AS turn_key, e.value AS hop FROM e WHERE regexp_matches(e.key, '^turn_[0-9]+$')"),
    "property_counts": (_property_counts, f"WITH {REC_SQL}, e AS (SELECT unnest(map_entries(properties)) AS e FROM rec) SELECT e.key AS property, e.value AS value, count(*) AS n FROM e GROUP BY ALL"),
    "observation_blocks": (_blocks, f"""WITH {MSG_SQL}, o AS (SELECT unnest(json_extract(value, '$[*]')) AS x FROM msg WHERE role = 'observation' AND regexp_matches(value, '^\\s*\\[') AND json_valid(value))
SELECT json_extract_string(x, '$.type') AS type, count(*) AS n, sum(coalesce(json_array_length(json_extract(x, '$.items')), 0))::BIGINT AS n_items FROM o GROUP BY 1"""),
    "paired_results": (_results, f"""WITH {TURN_SQL}, o AS (SELECT conv_id, turn, role, pos, (row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY pos))::INT AS ordinal FROM turned WHERE turn > 0 AND role IN ('function_call', 'observation'))
SELECT a.conv_id, a.turn, a.ordinal, a.pos AS call_pos, b.pos AS result_pos FROM o a LEFT JOIN o b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.ordinal = b.ordinal AND b.role = 'observation' WHERE a.role = 'function_call'"""),
    "unlisted_calls": (_unlisted, f"WITH {MSG_SQL}, {LIST_SQL} SELECT conv_id, {_CALL} AS name FROM msg WHERE role = 'function_call' AND ({_CALL}) IS NOT NULL EXCEPT SELECT conv_id, name FROM lst"),
    "item_ids": (_item_ids, f"WITH {MSG_SQL} SELECT conv_id, md5(string_agg(role || chr(1) || coalesce(value, chr(2)), chr(3) ORDER BY pos)) AS item_id FROM msg GROUP BY 1"),
}
