import json

from pyspark.sql import functions as F

from toolweave.operators import drift, shred
from toolweave.sources.tables import without_redelivery


def paths(schema):
    return [p[0] for p in shred.parameters(schema)]


def test_parameters_in_all_places():
    schema = {
        "type": "object",
        "properties": {
            "a": {"type": "object", "properties": {"b": {"type": "array", "items": {"properties": {"c": {}}}}, "b2": "string"}},
            "properties": {"properties": {"x": {}}}, "d": {"anyOf": [{"type": "null"}, {"properties": {"e": {}}}, {"items": {"properties": {"f": {}}}}]},
            "g": json.dumps({"properties": {"h": {}}}), "i": None,
        },
    }
    assert sorted(paths(schema)) == sorted(["a", "a/b", "a/b/c", "a/b2", "properties", "properties/x", "d", "d/e", "d/f", "g", "g/h", "i"])
    assert paths([{"name": "p", "param_type": "string"}, {"name": "p"}, {"x": 1}, "y", {"name": None}]) == ["p"]
    assert paths("not json") == paths(None) == paths(7) == paths({}) == []


def table_of(spark, rows, opener):
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string").withColumn("path", F.lit("clash")).withColumn("rec_id", F.lit(1))
    return df, shred.parameter_table(df, "id", "t", opener, ["type", "description"])


def test_parameter_table(spark):
    tool = {"name": "t", "inputSchema": {"properties": {"a": {"type": "string", "description": None}}}}
    rows = [
        json.dumps([tool, None, "x", {**tool, "inputSchema": None, "parameters": [{"name": "b"}]}]), json.dumps({"tools": [3, tool]}), json.dumps({"u": tool, "v": tool}), json.dumps({"s": [tool], "r": [tool]}),
        json.dumps(json.dumps([tool])), "{bad", "", " ", None, "null", "[]", json.dumps([{**tool, "inputSchema": json.dumps(tool["inputSchema"])}]), json.dumps([tool] * 300),
    ]
    df, out = table_of(spark, rows, "tools")
    got = sorted((r.rec_id, r.tool_pos, r.path, r.type) for r in out.where("rec_id < 12").collect())
    assert got == [(0, 0, "a", "string"), (0, 3, "b", None), (1, 1, "a", "string"), (2, 0, "a", "string"), (2, 1, "a", "string"), (3, 0, "a", "string"), (3, 1, "a", "string"), (4, 0, "a", "string"), (11, 0, "a", "string")]
    assert out.where("rec_id = 12").count() == 300
    assert shred.parameter_table(df.limit(0), "id", "t", "tools").count() == 0


def test_schema_opener(spark):
    _, out = table_of(spark, [json.dumps({"properties": {"a": {"type": "x"}}}), json.dumps(json.dumps([{"name": "q"}])), "[]", None], "schema")
    assert sorted((r.rec_id, r.tool_pos, r.path, r.parent_path) for r in out.collect()) == [(0, 0, "a", ""), (1, 0, "q", "")]


def test_adjacency_and_entities(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": {"type": "t", "n": [1, {"type": "u"}]}, "z": None})), (2, "x")], "id long, t string")
    nodes = shred.adjacency(df, "id", "t")
    got = [(r.node, r.parent, r.label, r.ordinal, r.kind, r.scalar) for r in nodes.orderBy("node").collect()]
    assert got == [(0, -1, "", 0, "object", None), (1, 0, "a", 0, "object", None), (2, 1, "type", 0, "string", "t"), (3, 1, "n", 1, "array", None), (4, 3, "", 0, "number", "1"), (5, 3, "", 1, "object", None), (6, 5, "type", 0, "string", "u"), (7, 0, "z", 1, "null", None)]
    flat = {(r.node, r.parent, r.label, r.type) for r in shred.entities(nodes, "id", ["type"]).collect()}
    assert flat == {(0, -1, "", None), (1, 0, "a", "t"), (5, 3, "", "u")}


def test_tool_table(spark):
    df = spark.createDataFrame([(1, json.dumps([{"name": "n", "x": {}, "parameters": [{"name": "p"}]}, 1]))], "id long, t string")
    assert [tuple(r) for r in shred.tool_table(df, "id", "t", ["name", "x"]).collect()] == [(1, 0, "n", None, 1)]


def files(spark, *contents):
    rows = [("f", seq, f"f/{seq}", i, json.dumps(r) if isinstance(r, dict) else r) for seq, rs in enumerate(contents, 1) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "feed string, n int, file string, row int, raw string").withColumn("seq", F.lit("clash"))


def found(df):
    return sorted((r.file_name, r.change, r.old_field, r.new_field) for r in drift.changes(df, "feed", "n", "file", "tool_key", "raw").collect())


def test_changes(spark):
    k = [f"k{i}" for i in range(10)]
    one = [{"tool_key": x, "name": f"n{i}", "v": i, "flag": True, "meta": {"a": i, "b": f"b{i}"}, "gone": 1, "o": {"x": 1}} for i, x in enumerate(k)]
    two = [{"tool_key": x, "title": f"n{i}", "v": f"{i}", "flag": None if i < 5 else True, "meta": {"c": i, "b": f"b{i}"}, "extra": [], "o": "flat"} for i, x in enumerate(k)]
    two[0] = one[0]
    df = files(spark, [*one, "{bad", None, "7"], two)
    assert found(df) == [
        ("f/2", "added", "", "extra"), ("f/2", "removed", "gone", ""), ("f/2", "renamed", "meta.a", "meta.c"), ("f/2", "renamed", "name", "title"), ("f/2", "retyped", "o", "o"), ("f/2", "retyped", "v", "v"),
    ]
    rows = drift.unified(df, "feed", "n", "row", "tool_key", "raw", drift.changes(df, "feed", "n", "file", "tool_key", "raw"))
    cells = {(r.seq, r.key): dict(r.cells) for r in rows.collect()}
    assert len(cells) == 20 and cells[1, "k3"]["name"] == cells[2, "k3"]["name"] == "n3" and cells[2, "k3"]["v"] == "3"


def test_missing_predecessor_and_rare_fields(spark):
    a = [{"tool_key": str(i), "x": i} for i in range(10)]
    b = [{"tool_key": str(i), "x": i} | ({"rare": 1} if i == 0 else {}) for i in range(10)]
    assert found(files(spark, a, b)) == []
    df = files(spark, a, [], [{"tool_key": "1", "y": 1}])
    assert found(df.where("n <> 2")) == []
    assert found(df.limit(0)) == []


def test_matching_is_optimal():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(40):
        w = [[rng.choice([0, 0, rng.random()]) for _ in range(4)] for _ in range(3)]
        got = drift.matching(w)
        assert len({c for c in got if c >= 0}) == sum(c >= 0 for c in got)
        best = max(sum(w[r][c] for r, c in enumerate(p)) for p in itertools.permutations(range(4), 3))
        assert abs(sum(w[r][c] for r, c in enumerate(got) if c >= 0) - best) < 1e-9


def test_without_redelivery(spark):
    rows = [(1, "a", 2, {"k": "v"}), (1, "b", 1, {"k": "w"}), (2, "c", 1, None), (None, "d", 1, None), (None, "d", 1, None), (3, "e", 5, None), (3, "e", 5, None), (4, "f", None, None)]
    df = spark.createDataFrame(rows, "id long, t string, loaded_at int, m map<string,string>")
    got = sorted((r.id or -1, r.t) for r in without_redelivery(df, ["id"]).collect())
    assert got == [(-1, "d"), (-1, "d"), (1, "b"), (2, "c"), (3, "e"), (4, "f")]
    assert without_redelivery(df.limit(0), ["id"]).count() == 0


def test_settled_tables_go_to_the_named_folder(spark):
    from toolweave.plans import settle as st

    st.release(spark)
    assert st.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = st.settle(spark.range(5), "five")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert all(f.removeprefix("file://").startswith(folder) for f in df.inputFiles())
    assert df.count() == 5 and st.release(spark) == 1 and st.release(spark) == 0


def test_parameters_come_from_the_node_table():
    schema = {"properties": {"a": {"type": "string", "default": 3, "enum": ["x"]}, "g": json.dumps({"properties": {"h": {"type": "u"}}})}}
    nodes = shred.Nodes([{"name": "n", "inputSchema": schema}])
    tool = next(nodes.elements())
    got = {p: nodes.pivot(node, ["type", "default", "enum"]) for p, _, _, _, node in nodes.parameters(nodes.tool_schema(tool))}
    assert got == {"a": ["string", "3", None], "g": [None] * 3, "g/h": ["u", None, None]}
    assert nodes.pivot(tool, ["name", "inputSchema"]) == ["n", None]
