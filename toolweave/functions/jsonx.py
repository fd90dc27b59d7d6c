"""JSON and XML work that needs recursion: plain functions over Python values, and one Arrow-batched UDF
that applies any of them to a column of JSON text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def load(raw: str | None) -> object:
    """The value of a JSON text, None where it is null, blank or unreadable; of equal keys the last counts."""
    if raw is None or not raw.strip():
        return None
    try:
        return json.loads(raw)
    except (ValueError, RecursionError):
        return None


def dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def on_json(work: Callable[[object], object], c: Column) -> Column:
    """work(value) as JSON text for each JSON text; null for null, unreadable or where work gives None."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = [None if (v := load(t)) is None else work(v) for t in texts]
        return pd.Series([None if x is None else dump(x) for x in out], dtype=object)

    return run(c)


def text_of(work: Callable[[object], str | None], c: Column) -> Column:
    """work(value) as it is for each JSON text; null for null and unreadable ones."""
    return on_text(lambda t: None if (v := load(t)) is None else work(v), c)


def on_text(work: Callable[[str], str | None], c: Column) -> Column:
    """work(text) for each text that is not null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else work(t) for t in texts], dtype=object)

    return run(c)


def hollow(value: object) -> bool:
    """None, 'null', blank text, [] and {}."""
    if isinstance(value, str):
        return value.strip() in ("", "null")
    return value is None or value == [] or value == {}


def without_hollow(value: object) -> object:
    """P10: hollow members removed at every depth, also those that become so; texts in lists stay as they are."""
    if isinstance(value, dict):
        kept = {k: without_hollow(v) for k, v in value.items()}
        return {k: v for k, v in kept.items() if not hollow(v)}
    if isinstance(value, list):
        kept = [without_hollow(v) for v in value]
        return [v for v in kept if isinstance(v, str) or not hollow(v)]
    return value


def without_nulls(value: object) -> object:
    """Null members of objects removed at every depth; nulls in lists stay."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


def count_nulls(value: object) -> int:
    """Members of objects that are null, at every depth."""
    if isinstance(value, dict):
        return sum(1 if v is None else count_nulls(v) for v in value.values())
    return sum(map(count_nulls, value)) if isinstance(value, list) else 0


def leaves(value: object) -> list[str]:
    """The scalar values below a value as texts, in reading order; nulls are left out."""
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    return [] if value is None else [value if isinstance(value, str) else json.dumps(value)]


def object_in(text: str) -> dict | None:
    """The JSON object in a model's answer: the whole, a fenced block, the outer braces, else the longest
    balanced stretch that can be read."""
    tries = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)]
    if "{" in text and "}" in text:
        tries.append(text[text.index("{") : text.rindex("}") + 1])
    for t in tries:
        value = load(t)
        if isinstance(value, dict):
            return value
    spans, open_, quoted, escaped = [], [], False, False
    for i, c in enumerate(text):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"' and open_:
            quoted = True
        elif c == "{":
            open_.append(i)
        elif c == "}" and open_:
            spans.append((open_.pop(), i + 1))
    for a, b in sorted(spans, key=lambda s: s[0] - s[1]):
        value = load(text[a:b])
        if isinstance(value, dict):
            return value
    return None


def repaired(text: str) -> str:
    """Fences off, typographic quotes straight, trailing commas out, open brackets and strings closed."""
    t = re.sub(r"^\s*```(?:json)?|```\s*$", "", text.strip()).strip()
    if load(t) is not None:
        return t
    t = t.translate(str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"}))
    t = re.sub(r",\s*([}\]])", r"\1", t)
    stack, quoted, escaped = [], False, False
    for c in t:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return re.sub(r",\s*$", "", t + '"' * quoted) + "".join(reversed(stack))


def four_fields(text: str) -> dict | None:
    """The four texts of a single-hop sample, None unless all are there and texts."""
    value = object_in(text)
    names = ("human_value", "function_call_value", "observation_value", "gpt_value")
    return value if value is not None and all(isinstance(value.get(n), str) for n in names) else None


# --- schemas -----------------------------------------------------------------------------------------

# JSON Schema types of common spellings.
TYPES = {"str": "string", "text": "string", "int": "integer", "long": "integer", "float": "number", "double": "number", "bool": "boolean", "list": "array", "tuple": "array", "dict": "object", "map": "object"}


def type_of(raw: object) -> str:
    word = str(raw or "string").split(",")[0].strip().lower()
    word = re.split(r"[\s\[(<]", word)[0]
    return word if word in ("string", "number", "integer", "boolean", "array", "object") else TYPES.get(word, "string")


def schema_of_map(params: dict, required: list | None = None) -> dict:
    """A map of parameters as a schema; a parameter is required if its type does not say optional and it
    has no default, unless a list says so."""
    properties, needed = {}, []
    for name, p in params.items():
        p = p if isinstance(p, dict) else {"type": p}
        own = {"type": type_of(p.get("type"))} | {k: v for k, v in p.items() if k not in ("type", "required", "optional") and not hollow(v)}
        properties[name] = own
        if required is None and "optional" not in str(p.get("type") or "").lower() and "default" not in p:
            needed.append(name)
    return {"type": "object", "properties": properties, "required": needed if required is None else [r for r in required if r in properties]}


def schema_of_lists(required: list, optional: list) -> dict:
    """Lists of required and optional parameters ({name, type, description, default}) as a schema."""
    both = [(p, True) for p in required or []] + [(p, False) for p in optional or []]
    named = [(p, r) for p, r in both if isinstance(p, dict) and p.get("name")]
    properties = {p["name"]: {"type": type_of(p.get("type"))} | {k: v for k, v in p.items() if k not in ("name", "type") and not hollow(v)} for p, _ in named}
    return {"type": "object", "properties": properties, "required": [p["name"] for p, r in named if r]}


def schema_of_mcp(params: list) -> dict:
    """An MCP parameter list as a schema with default, enum, minimum and maximum."""
    properties, needed = {}, []
    bounds = {"min_value": "minimum", "max_value": "maximum"}
    for p in params or []:
        if not isinstance(p, dict) or not p.get("name"):
            continue
        own = {"type": type_of(p.get("param_type") or p.get("type")), "description": p.get("description") or ""}
        properties[p["name"]] = own | {k: p[k] for k in ("default", "enum") if k in p} | {new: p[old] for old, new in bounds.items() if p.get(old) is not None}
        if p.get("required"):
            needed.append(p["name"])
    return {"type": "object", "properties": properties, "required": needed}


def input_schema_of(tool: dict) -> dict:
    """The tool with one readable inputSchema: from parameters, a flat map or a broken schema."""
    raw = next((tool[k] for k in ("inputSchema", "input_schema", "parameters") if tool.get(k) is not None), {})
    raw = load(raw) if isinstance(raw, str) else raw
    if isinstance(raw, list):
        schema = schema_of_mcp(raw)
    elif not isinstance(raw, dict):
        schema = {"type": "object", "properties": {}, "required": []}
    elif isinstance(raw.get("properties"), dict):
        inner = dict(raw["properties"])
        lifted = inner.pop("required", None) if isinstance(inner.get("required"), list) else None
        schema = {**raw, "type": "object", "properties": {k: v if isinstance(v, dict) else {"type": type_of(v)} for k, v in inner.items()}, "required": raw.get("required") or lifted or []}
    else:
        flat = {k: v for k, v in raw.items() if not (k == "type" and v == "object") and k != "required"}
        schema = schema_of_map(flat, raw["required"] if isinstance(raw.get("required"), list) else None)
    rest = {k: v for k, v in tool.items() if k not in ("inputSchema", "input_schema", "parameters")}
    return rest | {"inputSchema": schema}


def _typed(value: object) -> dict:
    return value if isinstance(value, dict) else {"type": "str", "description": str(value)}


def mended_schema(schema: object) -> object:
    """A map of parameters without a wrapper gets one, with its own list of required names; a member
    "type": "object" is no parameter. Whole schemas, and what holds no parameter, stay as they are."""
    if not isinstance(schema, dict) or (schema.get("type") == "object" and "properties" in schema):
        return schema
    needed = schema.get("required") if isinstance(schema.get("required"), list) else None
    bare = {k: _typed(v) for k, v in schema.items() if not (k == "required" and needed is not None) and not (k == "type" and v == "object")}
    return {"type": "object", "properties": bare, "required": needed or []} if bare else schema


def standard_tool(tool: dict) -> dict:
    """Parameters as inputSchema where there is none: null as an empty schema, a schema as it is, a flat map
    wrapped with the tool's own required names, a list by ``schema_of_mcp``; then P13."""
    made = dict(tool)
    if "inputSchema" not in made and "parameters" in made:
        raw = made.pop("parameters")
        if isinstance(raw, list):
            raw = schema_of_mcp(raw)
        elif not (isinstance(raw, dict) and "type" in raw and "properties" in raw):
            raw = {"type": "object", "properties": {k: _typed(v) for k, v in (raw or {}).items()}, "required": made.get("required") or []} if raw is None or isinstance(raw, dict) else raw
        made["inputSchema"] = raw
    return made | {"inputSchema": mended_schema(made["inputSchema"])} if "inputSchema" in made else made


def clean_schema(schema: dict) -> dict:
    """Hollow attributes of each parameter removed, one level deep; a missing type is string."""
    properties = schema.get("properties")
    if not isinstance(properties, dict):
        return schema
    own = {k: {"type": "string"} | {a: v for a, v in p.items() if not hollow(v)} if isinstance(p, dict) else {"type": "string"} for k, p in properties.items()}
    return {**schema, "properties": own}


def described_function(text: str) -> dict:
    """(description, schema) of a function's text: the first line, and the object after 'Parameters:'."""
    first = text.strip().split("\n", 1)[0].strip()
    after = re.split(r"(?i)parameters\s*:", text, maxsplit=1)
    params: dict = {}
    if len(after) == 2:
        found = object_in(after[1])
        if found is None:
            found = dict(re.findall(r"[\"']?(\w+)[\"']?\s*:\s*[\"']([^\"']*)[\"']", after[1]))
        params = {k: {"type": guessed_type(v), "description": v} if isinstance(v, str) else v for k, v in found.items()}
    optional = [k for k, v in params.items() if isinstance(v, dict) and "optional" in str(v.get("description", "")).lower()]
    return {"description": first, "inputSchema": schema_of_map(params, [k for k in params if k not in optional])}


def guessed_type(description: str) -> str:
    low = description.lower()
    # Words that give a parameter's type away.
    for kind, words in (("boolean", ("boolean", "true or false", "whether")), ("integer", ("integer", "number of", "count")), ("number", ("number", "float", "decimal")), ("array", ("array", "list of")), ("object", ("object", "dictionary"))):
        if any(w in low for w in words):
            return kind
    return "string"


def parameter_summary(schema: dict) -> str:
    """P29: 'name:type(required) enum=n' for each parameter."""
    needed = schema.get("required") if isinstance(schema.get("required"), list) else []
    parts = []
    for name, p in (schema.get("properties") or {}).items():
        p = p if isinstance(p, dict) else {}
        parts.append(f"{name}:{p.get('type', 'string')}" + ("(required)" if name in needed else "") + (f" enum={len(p['enum'])}" if isinstance(p.get("enum"), list) else ""))
    return ", ".join(parts)


def truth_call(value: object) -> dict | None:
    """A true call as {name, arguments}: JSON text, {name, arguments} or an object of one key."""
    value = load(value) if isinstance(value, str) else value
    if not isinstance(value, dict) or not value:
        return None
    if "name" in value:
        arguments = value.get("arguments")
        return {"name": value["name"], "arguments": (load(arguments) if isinstance(arguments, str) else arguments) or {}}
    if len(value) == 1:
        name, arguments = next(iter(value.items()))
        return {"name": name, "arguments": arguments if isinstance(arguments, dict) else {}}
    return None


# --- XML documents -----------------------------------------------------------------------------------

# The tags of a trajectory document.
TAGS = ["query_trajectory", "selected_tools", "tool", "name", "planning", "query", "trajectory", "call", "tool_name", "arguments", "argument", "result", "summary", "data", "list", "title", "item", "final_answer", "chart_data", "table", "kpis", "text"]


def clean_xml(text: str, root: str = "query_trajectory") -> str | None:
    """Fences and declaration off, cut to the root, bare ampersands escaped; None if it can't be parsed."""
    t = re.sub(r"```(?:xml)?", "", text)
    a, b = t.find(f"<{root}"), t.rfind(f"</{root}>")
    if a < 0 or b < 0:
        return None
    t = re.sub(r"&(?!#?\w+;)", "&amp;", t[a : b + len(root) + 3])
    return t if xml_root(t) is not None else None


def xml_root(text: str | None) -> ElementTree.Element | None:
    """the root of a readable document. Documents with a DTD are refused: they could expand without bound."""
    if not text or "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    try:
        return ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return None


def fix_xml(text: str, tags: list[str] = TAGS) -> dict:
    """P25: {ok, xml, errors}: unknown tags as text, wrong and missing ends mended from the stack of open tags."""
    out, stack, errors, at = [], [], [], 0
    for m in re.finditer(r"<(/?)([A-Za-z_][\w.-]*)([^<>]*)>", text):
        out.append(text[at : m.start()].replace("<", "&lt;").replace(">", "&gt;"))
        at = m.end()
        end, tag, rest = m.groups()
        if tag not in tags:
            errors.append(f"illegal tag {tag}")
        elif not end:
            if tag == "call" and "call" in stack:
                while "call" in stack:
                    out.append(f"</{stack.pop()}>")
                errors.append("missing </call>")
            out.append(m.group(0))
            if not rest.rstrip().endswith("/"):
                stack.append(tag)
        elif tag in stack:
            while stack[-1] != tag:
                errors.append(f"missing </{stack[-1]}>")
                out.append(f"</{stack.pop()}>")
            out.append(f"</{stack.pop()}>")
        else:
            errors.append(f"stray </{tag}>")
    out.append(text[at:].replace("<", "&lt;").replace(">", "&gt;"))
    while stack:
        errors.append(f"missing </{stack[-1]}>")
        out.append(f"</{stack.pop()}>")
    xml = re.sub(r"&(?!#?\w+;)", "&amp;", "".join(out)).strip()
    return {"ok": xml_root(xml) is not None, "xml": xml, "errors": errors}


def trajectory(text: str) -> dict | None:
    """{selected_tools, query, calls: [{index, tool, arguments, result}], final_answer} of a document:
    XML where it can be read, else Markdown sections; None where there is neither."""
    fixed = clean_xml(text) or (fix_xml(text)["xml"] if "<query_trajectory" in text else None)
    root = xml_root(fixed)
    if root is not None:
        name = lambda t: (t.findtext("name") or "".join(t.itertext())).strip()
        calls = []
        for i, c in enumerate(root.iter("call"), 1):
            arguments = {(a.get("name") or f"arg{k}"): "".join(a.itertext()).strip() for k, a in enumerate(c.iter("argument"))}
            result = c.find("result")
            whole = "".join((result if result is not None else c.find("summary") if c.find("summary") is not None else ElementTree.Element("x")).itertext()).strip()
            calls.append({"index": i, "tool": (c.findtext("tool_name") or "").strip(), "arguments": arguments, "result": whole})
        return {"selected_tools": [name(t) for t in root.iterfind(".//selected_tools/tool")], "query": (root.findtext("query") or "").strip(), "calls": calls, "final_answer": (root.findtext("final_answer") or "").strip()}
    parts = re.split(r"(?m)^##\s+([A-Z_ ]+?)\s*$", text)
    sections = {parts[i].strip().replace(" ", "_"): parts[i + 1].strip() for i in range(1, len(parts) - 1, 2)}
    if not {"QUERY", "TRAJECTORY"} & set(sections):
        return None
    tools = [re.sub(r"^[-*\d.)\s]+", "", x).split(":")[0].strip() for x in sections.get("SELECTED_TOOLS", "").split("\n") if x.strip()]
    calls = []
    for line in sections.get("TRAJECTORY", "").split("\n"):
        if m := re.match(r"^\s*(?:\d+[.)]|[-*])?\s*(?:tool|tool_name)\s*:\s*(.+)$", line, re.IGNORECASE):
            calls.append({"index": len(calls) + 1, "tool": m[1].strip(), "arguments": {}, "result": ""})
        elif calls and (m := re.match(r"^\s*(?:[-*]\s*)?result\s*:\s*(.*)$", line, re.IGNORECASE)):
            calls[-1]["result"] = m[1].strip()
        elif calls and (m := re.match(r"^\s*[-*]?\s*(\w+)\s*[:=]\s*(.+)$", line)):
            calls[-1]["arguments"][m[1]] = m[2].strip()
    return {"selected_tools": tools, "query": sections.get("QUERY", ""), "calls": calls, "final_answer": sections.get("FINAL_ANSWER", "")}


def trajectory_xml(doc: dict, most_items: int = 10) -> str:
    """A document's XML, at most ``most_items`` list items in a result."""
    root = ElementTree.Element("query_trajectory")
    chosen = ElementTree.SubElement(root, "selected_tools")
    for t in doc.get("selected_tools") or []:
        ElementTree.SubElement(chosen, "tool").text = t
    ElementTree.SubElement(root, "query").text = doc.get("query") or ""
    steps = ElementTree.SubElement(root, "trajectory")
    for c in doc.get("calls") or []:
        call = ElementTree.SubElement(steps, "call")
        ElementTree.SubElement(call, "tool_name").text = c.get("tool") or ""
        arguments = ElementTree.SubElement(call, "arguments")
        for k, v in (c.get("arguments") or {}).items():
            ElementTree.SubElement(arguments, "argument", {"name": k}).text = str(v)
        result = ElementTree.SubElement(call, "result")
        ElementTree.SubElement(result, "summary").text = c.get("result") or ""
        for item in (c.get("items") or [])[:most_items]:
            ElementTree.SubElement(result, "item").text = str(item)
    ElementTree.SubElement(root, "final_answer").text = doc.get("final_answer") or ""
    return ElementTree.tostring(root, encoding="unicode")
