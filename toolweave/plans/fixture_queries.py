"""Work on JSON, XML and texts whose rules SQL can't say, on small dirty inputs: each case's result
against the one written down here. Those of P12, P13 and of the tables below come from the rules by hand; the others were
recorded from the code and read against the rules, so they guard against change more than they prove.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from toolweave.functions import jsonx as jx
from toolweave.functions import text as tx
from toolweave.operators import converters as co, sampling as sa, scoring as sc

#: Query: what it does to a text, and (text, result as JSON or null) of each case.
WORK = {
    # P10
    "json_hollow_removed": (lambda t: jx.without_hollow(jx.load(t)), [
        ('{"a": null, "b": {"c": "", "d": []}, "e": ["", null, 1], "f": "null", "g": 0}', '{"e": ["", 1], "g": 0}'),
        ('{"a": {"b": {"c": null}}}', '{}'),
        ('{"x": [{"y": ""}], "z": false}', '{"z": false}'),
    ]),
    # P11
    "json_nulls_removed": (lambda t: jx.without_nulls(jx.load(t)), [
        ('{"a": null, "b": {"c": null, "d": 1}, "e": [null, {"f": null}]}', '{"b": {"d": 1}, "e": [null, {}]}'),
        ('[null, 1]', '[null, 1]'),
    ]),
    # A17
    "json_nulls_counted": (lambda t: jx.count_nulls(jx.load(t)), [
        ('{"a": null, "b": {"c": null, "d": 1}, "e": [null, {"f": null}]}', '3'),
        ('{}', '0'),
    ]),
    # P38
    "json_leaves": (lambda t: jx.leaves(jx.load(t)), [
        ('{"a": 1, "b": [true, "x", {"c": 2.5, "d": null}], "e": ""}', '["1", "true", "x", "2.5", ""]'),
        ('"alone"', '["alone"]'),
        ('[]', '[]'),
    ]),
    # P21
    "answer_object": (jx.object_in, [
        ('Here it is:\n```json\n{"a": 1}\n```\nDone.', '{"a": 1}'),
        ('so {"a": {"b": 2}} and more', '{"a": {"b": 2}}'),
        ('{"a": 1}', '{"a": 1}'),
        ('nothing here', None),
        ('first {"x": 1} then {"y": {"z": 2}}', '{"y": {"z": 2}}'),
    ]),
    # P22
    "answer_repaired": (jx.repaired, [
        ('```json\n{"a": 1,}\n```', '"{\\"a\\": 1}"'),
        ('{“a”: “b”}', '"{\\"a\\": \\"b\\"}"'),
        ('{"a": [1, 2', '"{\\"a\\": [1, 2]}"'),
        ('{"a": "open', '"{\\"a\\": \\"open\\"}"'),
    ]),
    # P23
    "answer_fields": (jx.four_fields, [
        ('{"human_value": "h", "function_call_value": "c", "observation_value": "o", "gpt_value": "g"}', '{"human_value": "h", "function_call_value": "c", "observation_value": "o", "gpt_value": "g"}'),
        ('{"human_value": "h"}', None),
        ('no object', None),
    ]),
    # P7
    "schema_from_map": (lambda t: jx.schema_of_map(jx.load(t)), [
        ('{"size": "Integer. number of items", "kind": "optional text", "on": "boolean"}', '{"type": "object", "properties": {"size": {"type": "string"}, "kind": {"type": "string"}, "on": {"type": "boolean"}}, "required": ["size", "on"]}'),
        ('{"a": {"type": "array", "description": "", "default": []}, "b": {"type": "STRING", "enum": ["x"]}}', '{"type": "object", "properties": {"a": {"type": "array"}, "b": {"type": "string", "enum": ["x"]}}, "required": ["b"]}'),
        ('{}', '{"type": "object", "properties": {}, "required": []}'),
    ]),
    # P8
    "schema_from_lists": (lambda t: jx.schema_of_lists(*jx.load(t)), [
        ('[[{"name": "a", "type": "NUMBER", "description": "d"}], [{"name": "b", "type": "ENUM", "description": "", "default": "x"}]]', '{"type": "object", "properties": {"a": {"type": "number", "description": "d"}, "b": {"type": "string", "default": "x"}}, "required": ["a"]}'),
        ('[[], [{"type": "STRING"}]]', '{"type": "object", "properties": {}, "required": []}'),
    ]),
    # P14
    "schema_from_mcp": (lambda t: jx.schema_of_mcp(jx.load(t)), [
        ('[{"name": "n", "param_type": "Integer", "description": "how many", "required": true, "min_value": 1, "max_value": 9}, {"name": "k", "param_type": "other", "default": null, "enum": ["a", "b"]}]', '{"type": "object", "properties": {"n": {"type": "integer", "description": "how many", "minimum": 1, "maximum": 9}, "k": {"type": "string", "description": "", "default": null, "enum": ["a", "b"]}}, "required": ["n"]}'),
        ('[{"param_type": "string"}]', '{"type": "object", "properties": {}, "required": []}'),
        ('[]', '{"type": "object", "properties": {}, "required": []}'),
    ]),
    # P12, P13
    "schema_of_tool": (lambda t: jx.standard_tool(jx.load(t)), [
        ('{"name": "t", "parameters": {"type": "object", "properties": {"a": {"type": "string"}}}}', '{"name": "t", "inputSchema": {"type": "object", "properties": {"a": {"type": "string"}}}}'),
        ('{"parameters": {"q": {"type": "string"}, "n": "how many"}, "required": ["q"]}', '{"required": ["q"], "inputSchema": {"type": "object", "properties": {"q": {"type": "string"}, "n": {"type": "str", "description": "how many"}}, "required": ["q"]}}'),
        ('{"name": "t", "parameters": null}', '{"name": "t", "inputSchema": {"type": "object", "properties": {}, "required": []}}'),
        ('{"name": "t"}', '{"name": "t"}'),
        ('{"inputSchema": {"type": "object", "required": ["a"], "a": {"type": "number"}, "b": 3}}', '{"inputSchema": {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "str", "description": "3"}}, "required": ["a"]}}'),
        ('{"inputSchema": {"type": "object"}}', '{"inputSchema": {"type": "object"}}'),
    ]),
    # P9
    "schema_attributes_cleaned": (lambda t: jx.clean_schema(jx.load(t)), [
        ('{"type": "object", "properties": {"a": {"description": "", "enum": []}, "b": {"type": "number", "default": null}}, "required": ["a"]}', '{"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "number"}}, "required": ["a"]}'),
        ('{"type": "object"}', '{"type": "object"}'),
    ]),
    # P15
    "function_described": (jx.described_function, [
        ('Finds a place.\nParameters: {"city": "Required. String. the city", "n": "Optional. number of places"}\nOutput: text', '{"description": "Finds a place.", "inputSchema": {"type": "object", "properties": {"city": {"type": "string", "description": "Required. String. the city"}, "n": {"type": "integer", "description": "Optional. number of places"}}, "required": ["city"]}}'),
        ('No parameters', '{"description": "No parameters", "inputSchema": {"type": "object", "properties": {}, "required": []}}'),
    ]),
    # P29
    "parameters_summarised": (lambda t: [jx.parameter_summary(jx.load(t))], [
        ('{"properties": {"a": {"type": "string", "enum": ["x", "y"]}, "b": {"type": "number"}}, "required": ["a"]}', '["a:string(required) enum=2, b:number"]'),
        ('{}', '[""]'),
    ]),
    # P40
    "true_calls": (lambda t: jx.truth_call(jx.load(t)), [
        ('{"find": {"a": 1}}', '{"name": "find", "arguments": {"a": 1}}'),
        ('{"name": "find", "arguments": {"a": 1}}', '{"name": "find", "arguments": {"a": 1}}'),
        ('"{\\"find\\": {\\"a\\": 1}}"', '{"name": "find", "arguments": {"a": 1}}'),
        ('[1]', None),
    ]),
    # P25, F18
    "xml_mended": (jx.fix_xml, [
        ('<query_trajectory><query>a & b</query></query_trajectory>', '{"ok": true, "xml": "<query_trajectory><query>a &amp; b</query></query_trajectory>", "errors": []}'),
        ('<query_trajectory><query>a<b></query>', '{"ok": true, "xml": "<query_trajectory><query>a</query></query_trajectory>", "errors": ["illegal tag b", "missing </query_trajectory>"]}'),
        ('plain', '{"ok": false, "xml": "plain", "errors": []}'),
    ]),
    # P24
    "xml_cleaned": (lambda t: None if (x := jx.clean_xml(t)) is None else [x], [
        ('```xml\n<?xml version="1.0"?>\n<query_trajectory><query>a & b</query></query_trajectory>\n```', '["<query_trajectory><query>a &amp; b</query></query_trajectory>"]'),
        ('<other/>', None),
    ]),
    # S6, P36
    "trajectory_read": (jx.trajectory, [
        ('<query_trajectory><selected_tools><tool>t1</tool></selected_tools><query>find</query><trajectory><call><tool_name>t1</tool_name><arguments><argument name="a">1</argument></arguments><result><summary>done</summary></result></call></trajectory><final_answer>ok</final_answer></query_trajectory>', '{"selected_tools": ["t1"], "query": "find", "calls": [{"index": 1, "tool": "t1", "arguments": {"a": "1"}, "result": "done"}], "final_answer": "ok"}'),
        ('## QUERY\nfind it\n## FINAL ANSWER\nok', '{"selected_tools": [], "query": "find it", "calls": [], "final_answer": "ok"}'),
        ('nothing', None),
    ]),
    # P35
    "trajectory_written": (lambda t: [jx.trajectory_xml(jx.load(t))], [
        ('{"selected_tools": ["t1"], "query": "a < b", "calls": [{"index": 1, "tool": "t1", "arguments": {"a": 1}, "result": "done"}], "final_answer": "ok"}', '["<query_trajectory><selected_tools><tool>t1</tool></selected_tools><query>a &lt; b</query><trajectory><call><tool_name>t1</tool_name><arguments><argument name=\\"a\\">1</argument></arguments><result><summary>done</summary></result></call></trajectory><final_answer>ok</final_answer></query_trajectory>"]'),
    ]),
    # P41
    "prefixed_turns": (co.spoken_turns, [
        ('user: hi\nsystem: yes\nuser: more', '[["human", "hi"], ["gpt", "yes"], ["human", "more"]]'),
        ('only this', '[["human", "only this"]]'),
    ]),
    # X3, X4
    "corpus_entries": (co.corpus_tool, [
        ('{"api_name": "n", "api_description": "d", "required_parameters": [{"name": "a", "type": "STRING"}], "optional_parameters": []}', '{"name": "n", "description": "d", "inputSchema": {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}}'),
        ('{"name": "n", "description": "d", "parameters": {"type": "object"}}', '{"name": "n", "description": "d", "inputSchema": {"type": "object", "properties": {}, "required": []}}'),
        ('x', None),
    ]),
    # X1
    "instance_records": (lambda t: co.alpaca_records(jx.load(t)), [
        ('{"Function_Description": {"find": "Finds.\\nParameters: {\\"q\\": \\"string\\"}"}, "Instances": [{"input": "go", "intermediate_steps": [[["find", "{\\"q\\": \\"x\\"}"], "seen"]], "output": "end"}]}', '[{"conversations": [{"from": "human", "value": "go"}, {"from": "function_call", "value": "{\\"name\\": \\"find\\", \\"arguments\\": {\\"q\\": \\"x\\"}}"}, {"from": "observation", "value": "seen"}, {"from": "gpt", "value": "end"}], "system": "", "tools": "[{\\"name\\": \\"find\\", \\"description\\": \\"Finds.\\", \\"inputSchema\\": {\\"type\\": \\"object\\", \\"properties\\": {\\"q\\": {\\"type\\": \\"string\\", \\"description\\": \\"string\\"}}, \\"required\\": [\\"q\\"]}}]", "properties": {"hop": "single-hop", "turn": "single-turn"}}]'),
    ]),
    # X2
    "question_records": (lambda t: co.acebench_record(*jx.load(t)), [
        ('["user: where?", [{"name": "find", "description": "d", "parameters": {}}], [{"find_1": {"a": 1}}]]', '{"conversations": [{"from": "human", "value": "where?"}, {"from": "function_call", "value": "{\\"name\\": \\"find\\", \\"arguments\\": {\\"a\\": 1}}"}, {"from": "observation", "value": ""}, {"from": "gpt", "value": ""}], "system": "", "tools": "[{\\"name\\": \\"find\\", \\"description\\": \\"d\\", \\"inputSchema\\": {\\"type\\": \\"object\\", \\"properties\\": {}, \\"required\\": []}}]", "properties": {"hop": "single-hop", "turn": "single-turn"}}'),
    ]),
    # X7
    "document_records": (lambda t: co.trajectory_record(jx.load(t)), [
        ('{"selected_tools": ["t1"], "query": "q", "calls": [{"index": 1, "tool": "t1", "arguments": {"a": 1}, "result": "done"}], "final_answer": "ok"}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "function_call", "value": "{\\"name\\": \\"t1\\", \\"arguments\\": {\\"a\\": 1}}"}, {"from": "observation", "value": "[{\\"type\\": \\"text\\", \\"text\\": \\"done\\"}]"}, {"from": "gpt", "value": "ok"}], "system": "", "tools": "[{\\"name\\": \\"t1\\"}]", "properties": {"turn_1": "single-hop", "augmented": "false"}}'),
    ]),
    # X8, J16
    "episode_records": (lambda t: co.episode_record(jx.load(t)), [
        ('{"selected_tools": [{"name": "a"}, {"name": "b"}], "conversations": [{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "tool_calls": [{"name": "b", "arguments": {"x": 1}}, {"name": "b", "arguments": "{\\"x\\": 2}"}]}, {"role": "tool", "content": "one"}, {"role": "assistant", "content": "end"}]}]}', '{"conversations": [{"from": "human", "value": "hi"}, {"from": "function_call", "value": "{\\"name\\": \\"b\\", \\"arguments\\": {\\"x\\": 1}}"}, {"from": "observation", "value": "one"}, {"from": "function_call", "value": "{\\"name\\": \\"b\\", \\"arguments\\": {\\"x\\": 2}}"}, {"from": "observation", "value": ""}, {"from": "gpt", "value": "end"}], "system": "", "tools": "[{\\"name\\": \\"b\\"}]", "properties": {"turn_1": "multi-hop", "num_turns": "1"}}'),
    ]),
}


def _texts(name):
    work, cases = WORK[name]

    def run(s, d):
        rows = s.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "number int, text string")
        made = jx.on_text(lambda t: None if (x := work(t)) is None else json.dumps(x, ensure_ascii=False), F.col("text"))
        return rows.select("number", made.alias("result"))

    return run


def _sql(rows: list[tuple], columns: str) -> str:
    """The rows as a SQL table."""
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def _types(s, d):
    given = ["string", "INTEGER", "Boolean", "array", "enum", "", None]
    return s.createDataFrame(list(enumerate(given)), "number int, t string").select("number", tx.schema_type(F.col("t")).alias("result"))


def _cells(s, d):
    return s.createDataFrame([(0, "a|b"), (1, "a\nb"), (2, None), (3, "")], "number int, t string").select("number", tx.markdown_escape(F.col("t")).alias("result"))


def _required(s, d):
    rows = s.createDataFrame([(0, ["a", "b"], ["b"]), (1, ["a"], ["a", "c"]), (2, None, ["a"]), (3, ["a"], None)], "number int, r array<string>, g array<string>")
    return rows.select("number", F.array_join(sc.missing_required(F.col("r"), F.col("g")), ",").alias("result"))


def _user_sourced(s, d):
    plans = [(0, [(("user",),), (("user",),)]), (1, [(("user",),), (("result",),)]), (2, []), (3, None), (4, [((None,),)])]
    rows = s.createDataFrame(plans, "number int, c array<struct<args_source:struct<field:string>>>")
    return rows.select("number", sc.user_sourced(F.col("c")).cast("int").alias("result"))


def _complete(s, d):
    source = s.createDataFrame([(1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 1, 1)], "number int, n_calls int, n_answers int")
    result = s.createDataFrame([(1, 2, 1, 0), (2, 1, 1, 0), (3, 1, 1, 1)], "number int, n_calls int, n_answers int, n_null int")
    return sc.completeness(result, source, "number").withColumnRenamed("state", "result")


def _seeds(s, d):
    return sa.seeded(s.createDataFrame([(0,), (7,)], "number int"), "number", 42).select("number", F.col("seed").alias("result"))


QUERIES = {name: (_texts(name), _sql([(k, r) for k, (_, r) in enumerate(cases)], "number, result")) for name, (_, cases) in WORK.items()} | {
    "schema_types": (_types, _sql([(0, "string"), (1, "integer"), (2, "boolean"), (3, "array"), (4, "string"), (5, "string"), (6, "string")], "number, result")),
    "markdown_cells": (_cells, "SELECT * FROM (VALUES (0, 'a\\|b'), (1, 'a b'), (2, NULL), (3, '')) t(number, result)"),
    "required_arguments": (_required, _sql([(0, "a"), (1, ""), (2, ""), (3, "a")], "number, result")),
    "user_sourced_plans": (_user_sourced, _sql([(0, 1), (1, 0), (2, 1), (3, 1), (4, 0)], "number, result")),
    "conversation_completeness": (_complete, _sql([(1, "complete"), (2, "incomplete"), (3, "has_null"), (4, "incomplete")], "number, result")),
    "worker_seeds": (_seeds, _sql([(0, 42), (7, 49)], "number, result")),
}
