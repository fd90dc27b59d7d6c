import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from toolweave.catalogue import queries
from toolweave.functions import jsonx as jx
from toolweave.functions import text as tx
from toolweave.operators import conversations as cv, converters as co, generation as ge, sampling as sa, scoring as sc, similarity as sim, tool_lists, tools as to
from toolweave.sources import files
from toolweave.streaming import live


def msg(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, pos int, role string, value string")


def test_turns_and_flow(spark):
    m = msg(spark, [(1, 0, "human", "q"), (1, 1, "function_call", '{"name":"a","arguments":{}}'), (1, 2, "observation", ""), (1, 3, "function_call", "{bad"), (1, 4, "gpt", "x"), (2, 0, "gpt", None), (3, 0, "human", "q"), (3, 1, "assistant", "y"), (3, 2, "function_call", '{"arguments":1}')])
    assert {(r.conv_id, r.turn, r.hop) for r in cv.turn_hops(m).collect()} == {(1, 1, "multi-hop"), (3, 1, "single-hop")}
    assert {(r.conv_id, r.issue) for r in cv.flow_issues(m).collect()} == {(1, "invalid_flow"), (1, "invalid_json"), (3, "incomplete_flow"), (3, "invalid_function_call_json")}
    listed = spark.createDataFrame([(1, "b")], "conv_id long, name string")
    assert (1, "tool_not_found") in {(r.conv_id, r.issue) for r in cv.flow_issues(m, listed).collect()}
    assert [r.conv_id for r in cv.direct_answers(m).where("direct").collect()] == [3]
    assert [tuple(r) for r in cv.empty_arguments(m).collect()] == [(1, 1, "a")]
    assert cv.hop_turn_stats(m.limit(0)).count() == 0


def test_tag_content(spark):
    rows = spark.createDataFrame([("<answer> a\nb </answer>",), ("<answer>open",), ("none",), ("<answer></answer>",), (None,)], "v string")
    assert [r[0] for r in rows.select(cv.tag_content(F.col("v"), "answer")).collect()] == ["a\nb", "open", None, None, None]


def test_text_keys(spark):
    df = spark.createDataFrame([("  My\xa0Tool ", "a\n\n\nb "), (None, None)], "n string, d string")
    r = df.select(tx.text_key(F.col("n"), F.col("d")), tx.signature(F.col("n")), tx.slug(F.lit(" A b--C! ")), tx.strip(F.col("n"))).collect()
    assert r[0][0] == "My\xa0Tool\na\nb" and r[0][2] == "a-b-c" and r[0][3] == "My\xa0Tool" and r[1][0] == "" and r[1][1] == ""


@pytest.mark.parametrize(("value", "hit"), [("pick a date", True), ("updateX", True), ("startDate", True), ("validate it", False), ("start_date", True), ("nothing", False), ("Today", False), ("my-date", True)])
def test_time_words(spark, value, hit):
    assert spark.createDataFrame([(value,)], "v string").select(tx.time_bound(F.col("v"))).first()[0] is hit


def test_json_work():
    assert jx.without_hollow({"a": None, "b": {"c": "null"}, "d": [None, "null", {}], "e": 0}) == {"d": ["null"], "e": 0}
    assert jx.without_nulls({"a": None, "b": [None, {"c": None}]}) == {"b": [None, {}]}
    assert jx.count_nulls({"a": None, "b": [{"c": None}, None]}) == 2
    assert jx.leaves({"a": [1, True, {"b": "x"}], "c": None}) == ["1", "true", "x"]
    assert jx.object_in('note {"a": {"b": 1}} and {"c"') == {"a": {"b": 1}} and jx.object_in("none") is None
    assert json.loads(jx.repaired('```json\n{"a": [1, 2,], “b”: "x')) == {"a": [1, 2], "b": "x"}
    assert jx.schema_of_map({"a": "int, optional", "b": {"type": "list", "default": 1}, "c": "str"})["required"] == ["c"]
    assert jx.schema_of_mcp([{"name": "a", "param_type": "INTEGER", "required": True, "min_value": 1}, {"x": 1}]) == {"type": "object", "properties": {"a": {"type": "integer", "description": "", "minimum": 1}}, "required": ["a"]}
    assert jx.schema_of_lists([{"name": "a", "type": "NUMBER"}], [{"name": "b", "default": ""}])["required"] == ["a"]
    made = jx.input_schema_of({"name": "t", "parameters": {"type": "object", "a": {"type": "string"}, "required": ["a"]}})
    assert made["inputSchema"] == {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}
    assert jx.described_function('Does it.\nParameters: {"n": "Integer. count", "k": "optional text"}')["inputSchema"]["required"] == ["n"]
    assert jx.parameter_summary({"properties": {"a": {"type": "x", "enum": [1, 2]}}, "required": ["a"]}) == "a:x(required) enum=2"
    assert jx.truth_call({"f": {"a": 1}}) == {"name": "f", "arguments": {"a": 1}} and jx.truth_call("[1]") is None


def test_xml_work():
    fixed = jx.fix_xml("<query_trajectory><trajectory><call><tool_name>a & b</tool_name><call><tool_name>c</tool_name></trajectory><bad>1 < 2</query_trajectory>")
    assert fixed["ok"] and "missing </call>" in fixed["errors"] and "illegal tag bad" in fixed["errors"]
    doc = {"selected_tools": ["a"], "query": "q & r", "calls": [{"index": 1, "tool": "a", "arguments": {"x": "1"}, "result": "ok"}], "final_answer": "f"}
    assert jx.trajectory(jx.trajectory_xml(doc)) == doc
    md = jx.trajectory("## SELECTED_TOOLS\n- a: text\n## QUERY\nq\n## TRAJECTORY\n1. tool: a\n x: 1\n result: ok\n## FINAL_ANSWER\nf")
    assert md == doc | {"query": "q"}
    assert jx.trajectory("plain") is None and jx.xml_root("<!DOCTYPE a><a/>") is None


def test_containers(spark):
    df = spark.createDataFrame([(1, '[{"name":"a"}, 3, null]'), (2, '{"tools":[{"name":"b"}]}'), (3, '{"x":{"name":"c"},"y":[{"name":"d"}]}'), (4, None), (5, "{bad"), (6, "")], "conv_id long, tools string")
    got = [(r.conv_id, r.tool_pos, r.container_kind, r.container_key) for r in tool_lists.elements(df, "tools", ["conv_id"]).orderBy("conv_id", "tool_pos").collect()]
    assert got == [(1, 0, "list", None), (1, 1, "list", None), (1, 2, "list", None), (2, 0, "lists", "tools"), (3, 0, "tools", "x"), (3, 1, "lists", "y")]
    assert [r.name for r in tool_lists.listed_tools(df).orderBy("conv_id", "tool_pos").collect()] == ["a", "b", "c", "d"]


def test_cross_file_modes(spark):
    rows = [(1, "f1", "n", "d"), (2, "f1", "n", "d"), (3, "f2", "n", "d"), (4, "f2", "m", "d"), (5, "s", "n", "d"), (6, "f2", None, "d"), (7, "f2", None, "d")]
    df = spark.createDataFrame(rows, "tool_id long, source_file string, name string, description string")
    ids = lambda mode: sorted(r.tool_id for r in to.dedup_across_files(df, ["s"], mode).collect())
    assert ids("drop_all") == [4, 5, 6, 7] and ids("keep_first") == [1, 4, 5, 6, 7]
    assert sorted(r.tool_id for r in to.dedup_first(df).collect()) == [1, 4, 6, 7]


def vectors(spark, n, seed):
    import numpy as np

    v = np.random.default_rng(seed).standard_normal((n, 8))
    return v / np.linalg.norm(v, axis=1, keepdims=True), spark.createDataFrame([(i, x.tolist(), i % 5) for i, x in enumerate(v)] + [(9999, None, 1)], "id long, v array<double>, label int")


def test_vectors_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(sim, "BLOCK_ROWS", 50)
    m, df = vectors(spark, 230, 1)
    s = m @ m.T
    got = {(r.a, r.b) for r in sim.close_pairs(df, "id", "v", 0.6).collect()}
    assert got == {(i, j) for i in range(230) for j in range(i + 1, 230) if s[i, j] >= 0.6}
    top = {(r.query, r["rank"]): r.key for r in sim.top_k(df.where("id < 20"), df, "id", "v", 3).collect()}
    np.fill_diagonal(s, -2)
    assert all(top[i, k + 1] == int(np.argsort(-s[i])[k]) for i in range(20) for k in range(3))
    kept = []
    for i in sorted(range(230), key=lambda i: (i % 5 >= 1, i % 5, i)):
        if i % 5 < 1 or all(s[i, j] < 0.6 for j in kept):
            kept.append(i)
    out = sim.greedy_dedup(df, "id", "v", [F.col("label")], F.col("label") < 1, 0.6).where("id < 9999").collect()
    assert sorted(r.id for r in out if r.kept) == sorted(kept)
    assert all((r.representative in kept and abs(s[r.id, r.representative] - r.similarity) < 1e-6) for r in out if not r.kept)


def test_hybrid_lists(spark):
    _, df = vectors(spark, 100, 2)
    pool = df.where("id < 100").select("id", "v")
    need = spark.createDataFrame([(1, 5, 0), (1, 6, 1)] + [(2, i, i) for i in range(20)] + [(3, i, i) for i in range(23)], "conv_id long, id long, first int")
    rows = sim.hybrid_lists(need, pool, "id", "v").collect()
    kinds = lambda c: pd.Series([r.source for r in rows if r.conv_id == c]).value_counts().to_dict()
    assert kinds(1) == {"truth": 2, "similar": 13, "random": 5} and kinds(2) == {"truth": 20} == kinds(3)
    assert all(sorted(r["rank"] for r in rows if r.conv_id == c) == list(range(1, 21)) for c in (1, 2, 3))


def test_token_jaccard(spark):
    rows = [(1, "a b c d"), (2, "A b c e"), (3, "x"), (4, None), (5, ""), (6, "a b c d d")]
    df = spark.createDataFrame(rows, "id long, t string")
    assert {(r.a, r.b) for r in sim.token_jaccard(df, df, "id", "t", 0.59).where("a < b").collect()} == {(1, 2), (1, 6), (2, 6)}


def test_rouge_and_flexible():
    assert sc.rouge_l("a b c", "a c") == pytest.approx(0.8) and sc.rouge_l("", "") == 1 and sc.rouge_l(None, "a") == 0
    assert sc.flexibly_equal('{"a": "x y z w"}', '{"a": "x y z v"}') and not sc.flexibly_equal('{"a": 1}', '{"a": 2}')
    assert sc.flexibly_equal("{}", '{"a": 1}', {"a": 1}) and not sc.flexibly_equal("{}", '{"a": 1}')


def test_match_prefers_equal_calls(spark):
    kind = "conv_id long, turn int, pos int, name string, arguments string"
    p = spark.createDataFrame([(1, 1, 1, "f", "x"), (1, 1, 2, " F", "y"), (1, 1, 3, "g", "")], kind)
    t = spark.createDataFrame([(1, 1, 1, "f", "y"), (1, 1, 2, "f", "z"), (1, 1, 3, "h", "")], kind)
    m = sc.match_calls(p, t)
    assert {(r.p_pos, r.t_pos, r.exact) for r in m.collect()} == {(2, 1, True), (1, 2, False), (3, None, False), (None, 3, False)}
    r = sc.turn_metrics(m).first()
    assert (r.strict_precision, r.flexible_precision, r.strict_accuracy) == (0.0, 0.666667, 0.333333)


def test_ungrounded(spark):
    df = spark.createDataFrame([(["12", "1.5", "true", "Paris", "x"], "Fly 112 to PARIS, yes, for 1.5.")], "v array<string>, t string")
    assert df.select(sc.ungrounded(F.col("v"), F.col("t"))).first()[0] == ["12", "x"]


def test_weighted_sample_follows_weights(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 9.0).otherwise(1.0))
    n = sa.weighted(df, "id", F.col("w"), 300).where("id < 1000").count()
    assert 230 < n < 295
    draws = sa.categorical(spark.createDataFrame([("a", 3.0), ("b", 1.0)], "v string, w double"), "v", "w", spark.range(2000).withColumnRenamed("id", "draw"))
    assert 1400 < draws.where("v = 'a'").count() < 1600


def test_repeats_and_locks(spark):
    ids = spark.range(4).withColumnRenamed("id", "k")
    got = [r.k for r in sa.with_repeats(ids, "k", 10).orderBy("ordinal").collect()]
    assert len(got) == 10 and sorted(got[:4]) == [0, 1, 2, 3] and got[:4] == got[4:8]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "l string, x int")
    assert [r.l for r in sa.lock_value(df, "l", 2).collect()] == ["a"] and sa.lock_value(df, "l", 3).count() == 0
    tools = sa.episode_tools(spark.createDataFrame([(f"t{i}", i) for i in range(30)], "k string, c int"), "k", "c").collect()
    assert len(tools) == 10 and {"t29", "t28", "t27", "t26", "t25"} <= {r.k for r in tools if r.source == "most"}


def test_converters(spark):
    raw = {"Function_Description": {"f": 'Finds it.\nParameters: {"n": "Integer"}', "components": ""}, "Instances": [{"input": "q", "intermediate_steps": [[["f", '{"n": 1}'], "r"], [["f", "bad"], "r2"]], "output": "o"}, {}]}
    df = spark.createDataFrame([(1, json.dumps(raw)), (2, "bad"), (3, None)], "id long, raw string")
    r = co.convert(df, "raw", co.alpaca_records, ["id"]).collect()
    assert len(r) == 1 and [m["from"] for m in r[0].conversations] == ["human", "function_call", "observation", "function_call", "observation", "gpt"] and r[0].properties["hop"] == "multi-hop"
    assert json.loads(r[0].conversations[3]["value"])["arguments"] == {}
    ace = co.acebench_record("user: a\nsystem: b\nuser: c", [{"name": "f", "parameters": {}}], [{"f_1": {"x": 1}}])
    assert [m["from"] for m in ace["conversations"]] == ["human", "gpt", "human", "function_call", "observation", "gpt"] and ace["properties"] == {"hop": "single-hop", "turn": "multi-turn"}
    episode = {"selected_tools": [{"name": "t"}], "conversations": [{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "tool_calls": [{"name": "t", "arguments": "{}"}]}, {"role": "tool", "content": "o"}, {"role": "assistant", "content": "a"}]}]}
    made = co.episode_record(episode)
    assert [m["from"] for m in made["conversations"]] == ["human", "function_call", "observation", "gpt"] and made["properties"] == {"turn_1": "single-hop", "num_turns": "1"}
    assert co.corpus_tool('{"api_name": "a", "api_description": "b", "required_parameters": []}')["inputSchema"]["required"] == [] and co.corpus_tool('{"name": ""}') is None


def test_generation(spark):
    calls = []

    def flaky(*_):
        calls.append(1)
        if len(calls) < 3:
            raise ge.ClientError("busy", after=0.0)
        return "ok"

    assert ge.with_retries(flaky, sleep=lambda _: None)() == "ok"
    with pytest.raises(ge.ClientError):
        ge.with_retries(lambda: (_ for _ in ()).throw(ge.ClientError("no", retry=False)))()
    assert ge.filled("{{a}} {{b}}", {"a": 1}) == "1 {{b}}" and ge.bundle("===== X =====\ny\n===== Z =====\nw") == {"X": "y", "Z": "w"}
    df = spark.createDataFrame([(1, "find flights"), (2, None)], "id long, t string")
    labels = ge.classify(df, "id", "t", to.CATEGORIES, ["travel", "finance"]).collect()
    assert all(r.category in to.CATEGORIES for r in labels)
    assert [r.category for r in ge.classify(df, "id", "t", ["x"], ["y"], lambda _: {"category": "z"}).collect()] == [None, None]
    prompts = df.select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("p"))
    done = spark.createDataFrame([(1, "old"), (2, None)], "id long, answer string")
    assert [(r.id, r.answer) for r in ge.infer(prompts, "id", "p", done=done).collect()] == [(2, "<answer></answer>")]
    m = msg(spark, [(1, 0, "human", "q"), (1, 1, "function_call", "{}"), (1, 2, "observation", " "), (1, 3, "function_call", "{}")])
    made = ge.assembled(m, spark.createDataFrame([(1, None)], "conv_id long, system_prompt string"), 2).first().prompt
    assert [(x.role, x.content) for x in made] == [("system", ""), ("user", "q"), ("assistant", "{}"), ("tool", "{}")]
    assert abs(sum(x * x for x in ge.hash_embedding(["a b"])[0]) - 1) < 1e-9


def test_files(spark, tmp_path):
    rec = {"conversations": [{"from": "human", "value": "q"}], "system": "s", "tools": [{"name": "a"}]}
    (tmp_path / "a.json").write_text(json.dumps([rec, rec], indent=1))
    (tmp_path / "b.json").write_text(json.dumps(rec))
    (tmp_path / "a.json.bak").write_text("[]")
    (tmp_path / "episode_0003.json").write_text("{}")
    got = files.conversations(spark, f"{tmp_path}/[ab].json")
    assert sorted((r.source_file, r.row_idx) for r in got.collect()) == [("a.json", 0), ("a.json", 1), ("b.json", 0)]
    assert json.loads(got.first().tools) == [{"name": "a"}] and files.messages(got).count() == 3
    assert files.listed_files(spark, str(tmp_path), "*").count() == 3
    assert [r.episode for r in files.episodes(spark, str(tmp_path)).collect()] == [3]
    (tmp_path / "l.jsonl").write_text('{"a":1}\nbad\n{"a":2}\n')
    assert files.tolerant_lines(spark, f"{tmp_path}/l.jsonl").count() == 2
    import pyarrow as pa

    table = pa.table({"x": pa.array([1, 2], pa.int64())})
    for name, make in (("s", pa.ipc.new_stream), ("f", pa.ipc.new_file)):
        with pa.OSFile(f"{tmp_path}/{name}.arrow", "wb") as f, make(f, table.schema) as w:
            w.write_table(table)
    assert sorted(r.x for r in files.arrow_files(spark, str(tmp_path), "x bigint").collect()) == [1, 1, 2, 2]
    sample = files.write_training(got, f"{tmp_path}/out", 2)
    assert sample.count() == 2 and spark.read.json(f"{tmp_path}/out").count() == 3
    assert files.markdown_table(spark.createDataFrame([("a|b", 1)], "x string, y int")) == "| x | y |\n| --- | --- |\n| a\\|b | 1 |\n"
    with pytest.raises(ValueError):
        files.markdown_table(spark.range(5), most=3)


def test_streams_resume_and_match_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2025-01-01 00:{i:02d}:00", "ab"[i % 2]) for i in range(40)], "id long, t string, name string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.where("id < 20").coalesce(1).write.parquet(f"{tmp_path}/in/x")
    stream = live.parquet_stream(spark, f"{tmp_path}/in/*", rows.schema)
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    live.append_to(live.once(stream, ["id"], "ts"), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 20
    rows.where("id >= 10").coalesce(1).write.parquet(f"{tmp_path}/in/y")
    live.append_to(live.once(stream, ["id"], "ts"), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 40
    usage = live.drain(live.running_usage(live.parquet_stream(spark, f"{tmp_path}/in/*", rows.schema, files=1), "name"), "update", f"{tmp_path}/c2")
    assert {(r.name, r.n) for r in usage.groupBy("name").agg(F.max("n").alias("n")).collect()} == {("a", 25), ("b", 25)}


def test_registered_functions(spark):
    from toolweave.functions.registry import register

    register(spark)
    r = spark.sql("""SELECT tw_rouge_l('a b c', 'a c') AS a, tw_clean_json('{"x": null, "y": 1}') AS b, tw_repair_json('{"x": [1') AS c""").first()
    assert (round(r.a, 3), r.b, r.c) == (0.8, '{"y": 1}', '{"x": [1]}')
    assert [round(x, 3) for x in spark.sql("SELECT tw_unit_sum(v) AS v FROM VALUES (array(3.0D, 0.0D)), (array(0.0D, 4.0D)) AS t(v)").first().v] == [0.6, 0.8]
    xml = jx.trajectory_xml({"calls": [{"tool": "t", "result": "r"}]})
    assert [tuple(x) for x in spark.sql(f"SELECT * FROM tw_calls('{xml}')").collect()] == [(1, "t", "r")]
    spark.createDataFrame([(1, xml), (2, None)], "id long, x string").createOrReplaceTempView("docs")
    assert [tuple(x) for x in spark.sql("SELECT id, c.tool FROM docs, LATERAL tw_calls(x) AS c").collect()] == [(1, "t")]


def test_text_builders(spark):
    df = spark.createDataFrame([("Summary\n• one\n2. two\n- three", {"k": "v"}, " q ", ["a", "b", "a"]), (None, None, None, None)], "r string, a map<string,string>, m string, v array<string>")
    got = df.select(tx.observation(F.col("r"), F.col("a")), tx.with_values(F.col("m"), F.col("v")), tx.bullets(F.col("r"))).collect()
    blocks = json.loads(got[0][0])
    assert [b["type"] for b in blocks] == ["text", "list", "table"] and blocks[1]["items"] == ["one", "two", "three"] and blocks[2]["rows"] == [{"parameter": "k", "value": "v"}]
    assert got[0][1] == "q Specifically: a, b." and [b["type"] for b in json.loads(got[1][0])] == ["text"] and got[1][1] is None and got[1][2] == []
    name = lambda v: spark.createDataFrame([(v,)], "f string").select(tx.dataset_name(F.col("f"))).first()[0]
    assert name("a/pred_toolace_test.json") == name("toolace_origin.jsonl") == "toolace"


def test_subsets(spark):
    m = spark.createDataFrame([(i, 1, 2, 2, 1.0, 1.0, 0.5) for i in range(12)], "conv_id long, turn int, n_pred int, n_true int, strict_precision double, flexible_precision double, strict_accuracy double")
    s = spark.createDataFrame([(i, 1, "serial" if i < 3 else "parallel", 2) for i in range(12)] + [(99, 1, "parallel", 1)], "conv_id long, turn int, strategy string, n_calls long")
    got = {r.subset: r.n for r in sc.subset_metrics(m, s, 4).where("dimension = 'multi-hop'").collect()}
    assert got == {"all": 12, "serial": 3, "parallel": 9, "1:1": 6, "1:2": 9, "1:3": 12, "1:4": 10}


def test_strategy_rules(spark):
    """Parts of values, values of several words, generic words, values of the query, later results and turns of one call."""
    def turn(conv, result, value, query="", label=None):
        return [(conv, 1, 1, ["x"], result, query, label), (conv, 1, 2, [value], "", query, label)]

    rows = turn(1, "id: post_id_789456", "789456") + turn(2, "Author: Kim Young-ha, Title: x", "kim young-ha") + turn(3, "status: active", "active") + turn(4, "id: 7788", "7788", "take 7788 please")
    rows += turn(5, "<cell>ref-9</cell>", "see ref-9 now") + turn(6, "nothing", "abc-1", label="mixed") + turn(7, "id: 12", "12") + [(8, 1, 1, ["789456"], "789456", "", None), (9, 1, 1, ["a-1234"], "", "", None), (9, 1, 2, ["y"], "a-1234", "", None)]
    calls = spark.createDataFrame(rows, "conv_id long, turn int, pos int, arguments array<string>, result string, query string, label string")
    found = {r.conv_id: r.strategy for r in sc.strategies(calls).collect()}
    assert found == {1: "serial", 2: "serial", 3: "parallel", 4: "parallel", 5: "serial", 6: "parallel", 7: "parallel", 8: "parallel", 9: "parallel"}
    assert {r.conv_id: r.strategy for r in sc.strategies(calls, "label").collect()} == found | {3: "serial", 5: "parallel", 6: "serial"}


def test_flow_rules(spark):
    rows = [
        (1, 0, "function_call", '{"name": "", "arguments": "{broken"}'), (1, 1, "observation", ""), (1, 2, "gpt", "x"),
        (2, 0, "function_call", '{"name": ""}'), (2, 1, "observation", ""), (2, 2, "assistant", "x"),
        (3, 0, "function_call", "[1]"), (3, 1, "gpt", ""), (4, 0, "function_call", None), (5, 0, "function_call", '{"name": "t", "arguments": "{}"}'), (5, 1, "observation", ""),
    ]
    msg = spark.createDataFrame(rows, "conv_id long, pos int, role string, value string")
    assert {tuple(r) for r in cv.flow_issues(msg).collect()} == {(1, "invalid_function_call_json"), (2, "invalid_flow"), (3, "invalid_flow"), (3, "invalid_function_call_json"), (4, "incomplete_flow"), (4, "invalid_json")}


def test_file_pairs_stop_at_the_shorter(spark):
    rows = lambda n: spark.createDataFrame([("f", i, 1, 1, "t", "a") for i in range(n)] + [("g", 9, 1, 1, "t", "b")], "file string, conv long, turn int, pos int, name string, arguments string")
    metrics, counts = sc.file_metrics(rows(3), rows(5), "file", "conv")
    assert {r.file: (r.n_pred, r.n_true, r.n_evaluated) for r in counts.collect()} == {"f": (3, 5, 3), "g": (1, 1, 1)}
    assert {(r.file, r.n, r.strict_precision) for r in metrics.where("dimension = 'single-hop'").collect()} == {("f", 3, 1.0), ("g", 1, 1.0)}


def test_same_name_is_a_near_duplicate(spark):
    rows = spark.createDataFrame([(1, "a", "one two three"), (2, "a", None), (3, "b", "three two one"), (4, None, "other words"), (5, None, "four")], "id long, name string, text string")
    found = lambda *more: {tuple(r) for r in sim.token_jaccard(rows, rows, "id", "text", 0.6, *more).collect()}
    assert found() == {(1, 3, 1.0), (3, 1, 1.0)}
    assert found("name") == {(1, 3, 1.0), (3, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0)}


def test_sequential_ids_over_partitions(spark):
    rows = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)] + [(None, "x"), (5, "x")], "k long, t string").repartition(6)
    got = sa.numbered(rows, ["k"], 0).orderBy("id").collect()
    assert [r.id for r in got] == list(range(103)) and [r.k for r in got] == [None] + sorted([*range(101), 5])
    assert sa.numbered(rows.limit(0), ["k"]).count() == 0


def test_episode_tools_fill_from_outside(spark):
    usage = spark.createDataFrame([(f"t{i:02d}", i, "in" if i < 7 else "out") for i in range(30)], "name string, c long, d string")
    got = {r.name: r.source for r in sa.episode_tools(usage, "name", "c", "d", "in").collect()}
    assert len(got) == 10 and {n for n, s in got.items() if s == "most"} == {f"t{i:02d}" for i in range(1, 7)} and got["t00"] == "least"
    assert sum(s == "outside" for s in got.values()) == 3
    assert sa.episode_tools(usage.limit(0), "name", "c", "d", "in").count() == 0


def _brute_jaccard(rows, threshold):
    """(a, b, similarity) by comparing every tool of an even id with every other: (above the threshold, of one name)."""
    sets = [(k, n, set((t or "").lower().split())) for k, n, t in rows]
    value = lambda x, y: round(len(x & y) / len(x | y), 6) if x | y else 0.0
    both = [(a, b, value(x, y), n is not None and n == m) for a, n, x in sets if a % 2 == 0 for b, m, y in sets if a != b]
    return {p[:3] for p in both if p[2] > threshold}, {p[:3] for p in both if p[3]}


@pytest.mark.parametrize("held", [2_000_000, 400])
def test_word_sets_meet_without_a_shuffle(spark, monkeypatch, held):
    import random

    draw, rows = random.Random(3), []
    for i in range(160):
        words = [f"w{min(draw.randrange(60), draw.randrange(60))}" for _ in range(draw.randrange(3, 30))]
        text = " ".join(words) if i % 5 else rows[draw.randrange(i)][2] if i else "one two"
        rows.append((i, draw.choice(["a", "b", None]), [text, None, "", (text or "").upper() + "  x y"][draw.choice([0, 0, 0, 0, 1, 2, 3])]))
    monkeypatch.setattr(sim, "WORDS_A_PASS", held)
    df = spark.createDataFrame(rows, "id long, name string, text string").coalesce(3)
    near, named = _brute_jaccard(rows, 0.6)
    assert near and named - near
    got = sim.token_jaccard(df.where("id % 2 = 0"), df, "id", "text", 0.6)
    assert sorted(map(tuple, got.collect())) == sorted(near)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rows_of_one_name_meet_without_a_shuffle(spark, monkeypatch):
    import random

    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(12)}"
    rows = [(i, draw.choice(["a", "b", "c", None]), draw.choice([None, "", *[" ".join(word() for _ in range(draw.randrange(1, 9))) for _ in range(6)]])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, name string, text string").coalesce(2)
    near, named = _brute_jaccard(rows, 0.6)
    assert near - named and named - near
    got = sim.token_jaccard(df.where("id % 2 = 0"), df, "id", "text", 0.6, "name")
    assert sorted(map(tuple, got.collect())) == sorted(near | named)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(sim, "WORDS_A_PASS", 100)
    assert sorted(map(tuple, sim.token_jaccard(df.where("id % 2 = 0"), df, "id", "text", 0.6, "name").collect())) == sorted(near | named)


def _shuffled(spark):
    """Bytes that this session's tasks have shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorList(False).head().totalShuffleWrite()


def test_near_dup_or_named_shuffles_only_what_was_delivered_again(spark, tmp_path):
    import datetime
    import random

    draw, day = random.Random(17), lambda n: datetime.datetime(2024, 1, 1 + n)
    word = lambda: f"{draw.getrandbits(64):x}"
    once = [(i, "s", "f", draw.choice(["a", "b", None]), "b", " ".join(word() for _ in range(40)), day(3)) for i in range(600)]
    once[100] = (*once[100][:5], once[7][5], day(3))
    again = [(i, "s", "f", None, "late", "other words", day(4)) for i in range(0, 600, 50)] + [(9, "s", "f", "a", None, once[100][5], day(1)), (9, "s", "f", "a", None, once[200][5], day(1))]
    again += [(None, "s", "f", "a", None, "", day(1))] * 2
    rows = spark.createDataFrame(once + again, "tool_id long, server string, source_file string, name string, tool_name string, description string, loaded_at timestamp")
    rows.withColumns({c: F.lit(None).cast("string") for c in ("category", "domain", "input_schema")}).coalesce(2).write.parquet(str(tmp_path / "toolset.parquet"))
    first = {i: (n or m, text) for i, _, _, n, m, text, _ in once}
    first[9] = ("a", min(once[100][5], once[200][5]))
    brute = [(a, b, 1.0 if set(x.split()) == set(y.split()) else 0.0, n == m) for a, (n, x) in first.items() if a % 100 == 0 for b, (m, y) in first.items() if a != b]
    before = _shuffled(spark)
    got = queries()["near_dup_or_named"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(p[:3] for p in brute if p[2] or p[3]) and {p[2] for p in brute if not p[3]} == {0.0, 1.0}
    assert _shuffled(spark) - before < 100_000 < sum(len(t[5]) for t in once) / 3


@pytest.mark.parametrize("marked", [4_000_000, 3])
def test_first_deliveries_are_those_of_the_grouping(spark, monkeypatch, marked):
    import random

    from toolweave.sources import tables as tb

    draw = random.Random(23)
    rows = [(draw.choice([None, *range(300)]), draw.choice("xy"), draw.randrange(3), draw.choice([None, "p", "q"]), draw.randrange(9)) for _ in range(400)]
    rows += [(i, "x", 1, "p", 2) for i in range(1000, 3000)]
    df = spark.createDataFrame(rows, "k long, j string, loaded_at int, v string, w int")
    told = lambda x: sorted(map(repr, x.collect()))
    monkeypatch.setattr(tb, "MARKED_KEYS", marked)
    assert told(tb.first_deliveries(df, ["k", "j"], ["v", "w"])) == told(tb.delivered_once(df, ["k", "j"], ["v", "w"]))
    for part in (df.where("k >= 1000"), df.limit(0)):
        assert told(tb.first_deliveries(part, ["k", "j"], ["v", "w"])) == told(tb.delivered_once(part, ["k", "j"], ["v", "w"]))


def test_words_of_a_batch_are_those_of_the_split(spark):
    import pyarrow as pa

    from toolweave.operators import word_sets as ws

    texts = ["", "   ", "a b a", " a\tb\x0bc\x1cd  e\n", "x\u00a0y \u2003 \x85z", "\u0130 i\u0307 q\r\fq", "a b a", "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    split = {r.i: sorted(r.w) for r in df.select("i", F.array_distinct(F.filter(F.split("t", r"\s+"), lambda w: w != "")).alias("w")).collect()}
    found = ws.distinct_words(pa.array(texts)).to_pylist()
    assert {i: sorted(w) for i, w in enumerate(found)} == split and ws.distinct_words(pa.array([], pa.string())).to_pylist() == []
    coded = pa.array(texts).dictionary_encode()
    sets = ws.Sets(ws.distinct_words(coded.dictionary), pa.array(["a", "b", "zz"]), coded.indices.to_numpy())
    assert len(coded.dictionary) == 7 and len(sets.set_of) == 8 and sets.set_of[2] == sets.set_of[6] and sets.set_of[0] == sets.set_of[1]
    assert sorted(sets.rows.of(sets.set_of[2:3])[1]) == [2, 6]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_hybrid_lists_shuffle_only_the_needed_tools(spark, monkeypatch, sent):
    import hashlib
    import random

    draw = random.Random(11)
    pool = [(i * 3, [float(draw.randrange(-3, 4)) for _ in range(4)] if i % 9 else None) for i in range(40)]
    pool = [(k, v if v is None or any(v) else [1.0, 0.0, 0.0, 0.0]) for k, v in pool]
    ids = [k for k, _ in pool]
    needs = {c: draw.sample([*ids, 500], n) for c, n in enumerate([1, 2, 3, 5, 6, 7, 8, 9, 12, 1, 2, 4])}
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, v in pool if v}
    value = lambda a, b: round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 9)
    hashed = sorted(ids, key=lambda k: (hashlib.md5(f"{k}7".encode()).hexdigest(), k))
    want = set()
    for c, own in needs.items():
        best = {k: max((value(q, k) for q in own if q in unit), default=None) for k in unit if k not in own}
        best = sorted((k for k, s in best.items() if s is not None), key=lambda k: (-best[k], k))[: max(0, 6 - len(own))]
        rest = [k for k in hashed if k not in own and k not in best]
        made = [*((k, "truth") for k in own), *((k, "similar") for k in best), *((k, "random") for k in rest)][:8]
        want |= {(c, k, source, i + 1) for i, (k, source) in enumerate(made)}
    monkeypatch.setattr(sim, "SENT_TOOLS", sent)
    monkeypatch.setattr(sim, "QUERIES_A_PASS", 7)
    truth = spark.createDataFrame([(c, k, i) for c, own in needs.items() for i, k in enumerate(own)], "conv_id long, tool long, first int")
    got = sim.hybrid_lists(truth, spark.createDataFrame(pool, "tool long, v array<double>"), "tool", "v", similar=6, total=8)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if sent:
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
