"""Queries over JSON and XML work, converters, stub models and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from toolweave.functions import jsonx as jx
from toolweave.functions import text as tx
from toolweave.operators import conversations as cv, converters as co, generation as ge, scoring as sc, similarity as sim, tool_lists, tools as to
from toolweave.plans.base import LIST_SQL, MSG_SQL, REC_SQL, TOOL_SQL, messages, records, tools
from toolweave.plans.settle import shared_dir
from toolweave.sources.tables import table
from toolweave.streaming import live


def _raw_tools(s, d):
    return tool_lists.elements(records(s, d), "tools", ["conv_id"])


def _schemas(s, d):
    return tools(s, d).where("input_schema IS NOT NULL").select("tool_id", "input_schema")


def _clean(s, d):
    return _schemas(s, d).select("tool_id", jx.on_json(jx.without_hollow, F.col("input_schema")).alias("clean"))


def _no_nulls(s, d):
    return _raw_tools(s, d).select("conv_id", "tool_pos", jx.on_json(jx.without_nulls, F.col("raw")).alias("clean")).where("clean IS NOT NULL")


def _null_count(s, d):
    return _raw_tools(s, d).select(F.coalesce(jx.on_json(jx.count_nulls, F.col("raw")).cast("int"), F.lit(0)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("elements"))


def _canonical(s, d):
    made = jx.on_json(lambda t: jx.standard_tool(t) if isinstance(t, dict) else None, F.col("raw"))
    return _raw_tools(s, d).select("conv_id", "tool_pos", made.alias("tool")).where("tool IS NOT NULL")


def _mcp(s, d):
    made = jx.on_json(lambda v: jx.schema_of_mcp(v) if isinstance(v, list) else None, F.col("input_schema"))
    return _schemas(s, d).select("tool_id", made.alias("schema")).where("schema IS NOT NULL")


def _summaries(s, d):
    made = jx.text_of(lambda v: jx.parameter_summary(v) if isinstance(v, dict) else None, F.col("input_schema"))
    return _schemas(s, d).select("tool_id", made.alias("summary")).where("summary IS NOT NULL")


def _repair(s, d):
    calls = messages(s, d).where("role = 'function_call' AND value IS NOT NULL")
    bad = calls.where(F.try_parse_json("value").isNull()).select("conv_id", "pos", jx.on_text(jx.repaired, F.col("value")).alias("mended"))
    return bad.select("conv_id", "pos", "mended", F.try_parse_json("mended").isNotNull().alias("readable"))


def _object_in(s, d):
    made = jx.on_text(lambda t: None if (x := jx.object_in(t)) is None else jx.dump(x), F.col("value"))
    return messages(s, d).where("value LIKE '%{%'").select("conv_id", "pos", made.alias("found")).where("found IS NOT NULL")


def _leaves(s, d):
    made = jx.on_json(lambda v: jx.leaves(v.get("arguments")) if isinstance(v, dict) else None, F.col("value"))
    calls = messages(s, d).where("role = 'function_call'").select("conv_id", "pos", F.from_json(made, "array<string>").alias("leaves"))
    return calls.where("leaves IS NOT NULL").select("conv_id", "pos", F.explode("leaves").alias("leaf"))


def _ungrounded(s, d):
    asked = cv.with_turns(messages(s, d)).where("role = 'human'").select("conv_id", "turn", F.col("value").alias("text"))
    turns = cv.with_turns(messages(s, d)).select("conv_id", "pos", "turn")
    values = _leaves(s, d).groupBy("conv_id", "pos").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    rows = values.join(turns, ["conv_id", "pos"]).join(asked, ["conv_id", "turn"])
    return rows.select("conv_id", "pos", F.size(sc.ungrounded(F.col("leaves"), F.col("text"))).alias("n_missing"))


def _trajectories(s, d):
    docs = table(s, d, "documents").where(F.col("text").contains("<query_trajectory") | F.col("text").rlike(r"(?m)^## (QUERY|TRAJECTORY)"))
    made = jx.on_text(lambda t: None if (x := jx.trajectory(t)) is None else jx.dump(x), F.col("text"))
    return docs.select("doc_id", made.alias("document")).where("document IS NOT NULL")


def _trajectory_calls(s, d):
    calls = _trajectories(s, d).select("doc_id", F.explode(F.from_json(F.get_json_object("document", "$.calls"), "array<struct<index:int,tool:string,result:string>>")).alias("c"))
    return calls.select("doc_id", F.col("c.index").alias("call_no"), F.col("c.tool").alias("tool"), F.length("c.result").alias("n_chars"))


def _xml_fix(s, d):
    docs = table(s, d, "documents").where(F.col("text").contains("<query_trajectory"))
    made = docs.select("doc_id", jx.on_text(lambda t: jx.dump(jx.fix_xml(t)), F.col("text")).alias("_x"))
    return made.select("doc_id", (F.get_json_object("_x", "$.ok") == "true").alias("ok"), F.json_array_length(F.get_json_object("_x", "$.errors")).alias("n_errors"))


def _trajectory_records(s, d):
    return co.convert(_trajectories(s, d), "document", co.trajectory_record, ["doc_id"]).select("doc_id", F.size("conversations").alias("n_messages"), "tools")


def _alpaca(s, d):
    """Catalogue entries as ToolAlpaca documents: one instance, one step."""
    t = tools(s, d).where("name IS NOT NULL AND description IS NOT NULL")
    raw = F.to_json(F.struct(
        F.create_map("name", F.concat(F.col("description"), F.lit('\nParameters: {"size": "Integer. number of items", "kind": "optional text"}'))).alias("Function_Description"),
        F.array(F.struct(F.col("description").alias("input"), F.array(F.array(F.to_json(F.array(F.col("name"), F.lit('{"size": 3}'))), F.lit("done"))).alias("steps"), F.lit("ok").alias("output"))).alias("Instances"),
    ))

    def work(v):
        v["Instances"] = [{"input": i["input"], "output": i["output"], "intermediate_steps": [[json.loads(x[0]), x[1]] for x in i["steps"]]} for i in v["Instances"]]
        return co.alpaca_records(v)

    return co.convert(t.select("tool_id", raw.alias("raw")), "raw", work, ["tool_id"]).select("tool_id", F.size("conversations").alias("n_messages"), "tools")


def _ace(s, d):
    """Questions with their conversation's calls as true answers."""
    msg = cv.with_turns(messages(s, d)).where("turn = 1")
    q = msg.where("role = 'human' AND value IS NOT NULL").select("conv_id", F.col("value").alias("question"))
    calls = msg.where("role = 'function_call'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("calls"))
    listed = tool_lists.elements(records(s, d), "tools", ["conv_id"]).where(F.col("raw").rlike(r"^\s*\{")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tool_pos", "raw"))), lambda x: x["raw"]).alias("functions"))
    rows = q.join(calls, "conv_id").join(listed, "conv_id").select("conv_id", F.to_json(F.struct("question", "functions", "calls")).alias("raw"))
    made = co.convert(rows, "raw", lambda v: co.acebench_record(v["question"], [jx.load(f) for f in v["functions"]], v.get("calls") or []), ["conv_id"])
    return made.select("conv_id", F.size("conversations").alias("n_messages"), F.col("properties")["hop"].alias("hop"))


def _corpus(s, d):
    rows = _raw_tools(s, d).withColumn("ord", F.struct("conv_id", "tool_pos"))
    return co.corpus(rows, "raw", "ord").select("name", F.length("description").alias("n_chars"), "schema")


def _servers(s, d):
    entry = F.to_json(F.struct("name", "description", F.from_json("input_schema", "array<struct<name:string,param_type:string,description:string,required:boolean>>").alias("parameters")))
    rows = tools(s, d).where(F.col("input_schema").rlike(r"^\s*\[") & F.col("name").isNotNull())
    by = rows.groupBy("server").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool_id", entry.alias("e")))), lambda x: x["e"]), ","), F.lit("]")).alias("tools"), F.min("tool_id").alias("ord"))
    return co.server_pool(by, "server", "tools", "ord").select("slug", "tool_pos", "name", "schema")


def _export(masked):
    def run(s, d):
        out = co.training_export(co.grouped_records(messages(s, d), records(s, d)), masked)
        return out.select("conv_id", F.size("conversations").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("conversations", lambda m: F.concat_ws("\x01", m["from"], F.coalesce(m["value"], F.lit("-")))), "\x02")).alias("h"))

    return run


def _inference(s, d):
    return ge.infer(ge.assembled(messages(s, d), records(s, d), 1), "conv_id", "prompt").select("conv_id", F.length("answer").alias("n"))


def _prompts(s, d):
    return ge.assembled(messages(s, d), records(s, d), 2).select("conv_id", F.size("prompt").cast("bigint").alias("n"))


def _classify(s, d):
    return ge.classify(tools(s, d).where(tx.blank(F.col("category"))), "tool_id", "description", to.CATEGORIES, to.DOMAINS)


def _judge(s, d):
    return sc.quality_gate(sc.scored(ge.judge(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", sc.METRICS))).select("doc_id", "average", "min_score", "passed")


def _generate(s, d):
    def client(messages_):
        return "```json\n" + json.dumps({"human_value": messages_[0]["content"], "function_call_value": "{}", "observation_value": "", "gpt_value": "ok"}) + "\n```"

    rows = tools(s, d).where("name IS NOT NULL")
    return ge.generate(rows, ["tool_id"], ["name"], "Use {{name}}, try {{try}}.", client, jx.four_fields)


def _stepwise(s, d):
    def planner(m):
        state = json.loads(m[0]["content"])
        return json.dumps({"done": len(state["calls"]) >= 2, "tool_name": state["tools"], "arguments": {"n": len(state["calls"])}})

    return ge.stepwise(tools(s, d).where("name IS NOT NULL").withColumn("q", F.lit("?")), "tool_id", "q", "name", planner, lambda m: "result of " + m[0]["content"])


def _episodes(s, d):
    return ge.episodes(s.range(50).withColumnRenamed("id", "episode_no"), "episode_no", 7, lambda seed: 2 + seed % 3, lambda st: {"turn": st["turn"], "seed": st["seed"]})


def _embedded(s, d):
    t = tools(s, d).where("description IS NOT NULL").withColumn("text", tx.text_key(F.col("name"), F.col("description")))
    v = ge.embed(t, "tool_id", "text")
    return sim.top_k(v.where("tool_id % 100 = 0"), v, "tool_id", "embedding", 3)


def _cache(s, d):
    t = tools(s, d).where("name IS NOT NULL AND description IS NOT NULL").select("tool_id", tx.text_key(F.col("name"), F.col("description")).alias("text"))
    cache = t.where("tool_id % 2 = 0").select(F.concat(F.lit(" "), F.col("text")).alias("text"), F.array(F.lit(1.0)).alias("embedding"))
    return sim.cached_vectors(t, cache).select("tool_id", F.col("embedding").isNotNull().alias("hit"))


def _observations(s, d):
    """The catalogue's descriptions as results, its labels as arguments."""
    t = tools(s, d).where("description IS NOT NULL")
    arguments = F.map_filter(F.create_map(F.lit("category"), "category", F.lit("domain"), "domain"), lambda k, v: v.isNotNull())
    return t.select("tool_id", tx.observation(F.concat(F.lit("- "), "description"), arguments).alias("value"))


def _block_counts(s, d):
    return _observations(s, d).select("tool_id", F.json_array_length("value").cast("bigint").alias("blocks"))


def _hints(s, d):
    t = tools(s, d).where("description IS NOT NULL")
    return t.select("tool_id", F.md5(tx.with_values(F.col("description"), F.array_compact(F.array("category", "domain", "category")))).alias("h"))


def _anchors(s, d):
    t = tools(s, d).where("description IS NOT NULL AND name IS NOT NULL")
    return t.select("tool_id", sc.anchored(F.col("description"), F.array("name", "domain", F.lit(None).cast("string"))).alias("anchored"))


def _place(s):
    return f"{shared_dir(s)}/streams/{uuid.uuid4().hex}"


def _stream(s, d):
    events = live.parquet_stream(s, d, table(s, d, "events").schema, "events.parquet")
    counts = live.windowed_counts(events, "ts", ["event_type"], "1 hour")
    out = live.drain(counts, "complete", _place(s))
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "event_type", "n")


def _stream_usage(s, d):
    events = live.parquet_stream(s, d, table(s, d, "events").schema, "events.parquet")
    out = live.drain(live.running_usage(events, "event_type"), "update", _place(s))
    return out.groupBy("name").agg(F.max("n").alias("n"))


def _sessions(s, d):
    events = live.parquet_stream(s, d, table(s, d, "events").schema, "events.parquet")
    out = live.drain(live.sessions(events, "ts", "user_id", "30 minutes"), "complete", _place(s))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


def _batches(s, d):
    ordered = F.row_number().over(cv.Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = table(s, d, "documents").withColumn("batch", F.floor(ordered / 64))
    return rows.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"))


def _union(s, d):
    a = tools(s, d).select(F.lit("catalogue").alias("origin"), "name")
    b = tool_lists.listed_tools(records(s, d)).select(F.lit("records").alias("origin"), "name")
    return a.unionByName(b).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


_VALUE = "CASE WHEN role = 'gpt' THEN {g} {o} ELSE value END"
_TAGGED = "CASE WHEN coalesce(regexp_replace(value, '[\\s\\p{Z}]', '', 'g'), '') = '' THEN '<answer></answer>' ELSE '<answer>' || value || '</answer>' END"


def _export_sql(g, o):
    v = _VALUE.format(g=g, o=o)
    return f"WITH {MSG_SQL}, {REC_SQL} SELECT conv_id, count(*) AS n, md5(string_agg(role || chr(1) || coalesce({v}, '-'), chr(2) ORDER BY pos)) AS h FROM msg WHERE conv_id IN (SELECT conv_id FROM rec) GROUP BY 1"


QUERIES = {
    "schema_clean": (_clean, None), "null_removal": (_no_nulls, None), "null_count": (_null_count, None), "parameters_to_schema": (_canonical, None), "mcp_schema": (_mcp, None),
    "parameter_summary": (_summaries, None), "json_repair": (_repair, None), "object_extraction": (_object_in, None), "argument_leaves": (_leaves, None), "ungrounded_arguments": (_ungrounded, None),
    "trajectory_parse": (_trajectory_calls, None), "xml_fix": (_xml_fix, None), "trajectory_records": (_trajectory_records, None), "alpaca_records": (_alpaca, None), "acebench_records": (_ace, None),
    "tool_corpus": (_corpus, None), "server_pool": (_servers, None),
    "training_export": (_export(False), _export_sql(_TAGGED, "")),
    "masked_export": (_export(True), _export_sql("'<answer></answer>'", "WHEN role = 'observation' THEN ''")),
    "stub_inference": (_inference, None),
    "prompt_sizes": (_prompts, f"""WITH {MSG_SQL}, {REC_SQL}, m AS (SELECT *, count(*) FILTER (role = 'function_call') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM msg), c AS (SELECT conv_id, pos FROM m WHERE role = 'function_call' AND k = 2)
SELECT c.conv_id, 1 + count(m.pos) AS n FROM c JOIN rec USING (conv_id) LEFT JOIN m ON m.conv_id = c.conv_id AND m.pos < c.pos GROUP BY 1"""),
    "stub_classify": (_classify, None), "stub_judge": (_judge, None), "stub_generate": (_generate, None), "stub_stepwise": (_stepwise, None), "stub_episodes": (_episodes, None), "stub_embedding_topk": (_embedded, None),
    "embedding_cache": (_cache, f"WITH {TOOL_SQL} SELECT tool_id, t.k IN (SELECT k FROM (SELECT regexp_replace(regexp_replace(regexp_replace(name, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') || chr(10) || regexp_replace(description, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS k, tool_id FROM tool WHERE name IS NOT NULL AND description IS NOT NULL) WHERE tool_id % 2 = 0) AS hit FROM (SELECT tool_id, regexp_replace(regexp_replace(regexp_replace(name, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') || chr(10) || regexp_replace(description, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS k FROM tool WHERE name IS NOT NULL AND description IS NOT NULL) t"),
    "stream_windows": (_stream, "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_usage": (_stream_usage, "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1"),
    "stream_sessions": (_sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k.k"""),
    "observation_build": (_block_counts, f"WITH {TOOL_SQL} SELECT tool_id, 1 + 1 + CASE WHEN category IS NOT NULL OR domain IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS blocks FROM tool WHERE description IS NOT NULL"),
    "value_hints": (_hints, f"""WITH {TOOL_SQL}, v AS (SELECT tool_id, description, list_filter([category, CASE WHEN domain IS DISTINCT FROM category THEN domain END], lambda x: x IS NOT NULL) AS v FROM tool WHERE description IS NOT NULL)
SELECT tool_id, md5(CASE WHEN len(v) > 0 THEN regexp_replace(description, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') || ' Specifically: ' || array_to_string(v, ', ') || '.' ELSE description END) AS h FROM v"""),
    "anchor_check": (_anchors, f"WITH {TOOL_SQL} SELECT tool_id, contains(lower(description), lower(name)) OR coalesce(contains(lower(description), lower(domain)), false) AS anchored FROM tool WHERE description IS NOT NULL AND name IS NOT NULL"),
    "batches": (_batches, "WITH r AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64 AS batch FROM documents) SELECT source, batch, count(*) AS n FROM r GROUP BY ALL"),
    "occurrence_union": (_union, f"WITH {TOOL_SQL}, {LIST_SQL} SELECT 'catalogue' AS origin, count(*) AS n, count(DISTINCT name) AS names FROM tool UNION ALL SELECT 'records', count(*), count(DISTINCT name) FROM lst"),
}
