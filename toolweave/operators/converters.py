"""Converters of public data sets into conversation records, and training exports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.functions import jsonx as jx
from toolweave.functions import text as tx

RECORD = "conversations array<struct<`from`:string,value:string>>, system string, tools string, properties map<string,string>"


def _record(messages: list[tuple[str, str]], tools: list[dict], properties: dict) -> dict:
    return {"conversations": [{"from": r, "value": v} for r, v in messages], "system": "", "tools": jx.dump(tools), "properties": {k: str(v) for k, v in properties.items()}}


def _properties(messages: list[tuple[str, str]]) -> dict:
    turns = sum(r == "human" for r, _ in messages)
    most, now = 0, 0
    for role, _ in messages:
        now = 0 if role == "human" else now + (role == "function_call")
        most = max(most, now)
    return {"hop": "multi-hop" if most >= 2 else "single-hop", "turn": "multi-turn" if turns >= 2 else "single-turn"}


def alpaca_records(raw: dict) -> list[dict]:
    """One record per instance; steps of (action, input, ...) and observation become calls and results; only
    used tools are listed, 'components' is no tool; unreadable arguments are {}."""
    described = {k: v for k, v in (raw.get("Function_Description") or {}).items() if k != "components" and isinstance(v, str)}
    out = []
    for instance in raw.get("Instances") or []:
        if not isinstance(instance, dict) or not instance.get("input"):
            continue
        messages, used = [("human", str(instance["input"]))], []
        for step in instance.get("intermediate_steps") or []:
            if not isinstance(step, list) or len(step) != 2 or not isinstance(step[0], list) or len(step[0]) < 2:
                continue
            name = str(step[0][0])
            arguments = step[0][1] if isinstance(step[0][1], dict) else jx.load(str(step[0][1]))
            messages += [("function_call", jx.dump({"name": name, "arguments": arguments if isinstance(arguments, dict) else {}})), ("observation", step[1] if isinstance(step[1], str) else jx.dump(step[1]))]
            if name in described and name not in used:
                used.append(name)
        messages.append(("gpt", str(instance.get("output") or "")))
        tools = [{"name": n} | jx.described_function(described[n]) for n in used]
        out.append(_record(messages, tools, _properties(messages)))
    return out


def spoken_turns(text: str) -> list[tuple[str, str]]:
    """Messages of a text with 'user:' and 'system:' prefixes; a text without is one human message."""
    parts = re.split(r"(?mi)^\s*(user|system|assistant)\s*:\s*", text)
    found = [(parts[i].lower(), parts[i + 1].strip()) for i in range(1, len(parts) - 1, 2)]
    return [("human" if r == "user" else "gpt", v) for r, v in found] if found else [("human", text.strip())]


def acebench_record(question: str, functions: list, answers: list) -> dict:
    """The calls of the true answer after the question's last human message; names with a numeric suffix
    fall back to the listed function; hop and turn are counted anew."""
    listed = {f["name"]: f for f in functions if isinstance(f, dict) and f.get("name")}
    messages, used = spoken_turns(question), []
    for answer in answers:
        call = jx.truth_call(answer)
        if call is None:
            continue
        cut = re.sub(r"_\d+$", "", str(call["name"]))
        name = call["name"] if call["name"] in listed else cut if cut in listed else call["name"]
        messages += [("function_call", jx.dump({"name": name, "arguments": call["arguments"]})), ("observation", "")]
        if name in listed and name not in used:
            used.append(name)
    messages.append(("gpt", ""))
    return _record(messages, [jx.input_schema_of(listed[n]) for n in used], _properties(messages))


def corpus_tool(raw: str | None) -> dict | None:
    """A corpus entry (api_name or name, api_description or description, parameters or required and
    optional lists) as a tool; None without a name or a description."""
    entry = jx.load(raw)
    if not isinstance(entry, dict):
        return None
    name, description = entry.get("api_name") or entry.get("name"), entry.get("api_description") or entry.get("description")
    if not isinstance(name, str) or not name.strip() or not isinstance(description, str) or not description.strip():
        return None
    if "required_parameters" in entry or "optional_parameters" in entry:
        schema = jx.schema_of_lists(entry.get("required_parameters") or [], entry.get("optional_parameters") or [])
    else:
        schema = jx.clean_schema(jx.input_schema_of(entry)["inputSchema"])
    return {"name": name.strip(), "description": description.strip(), "inputSchema": schema}


def trajectory_record(doc: dict, pool: dict[str, dict] | None = None) -> dict:
    """A multi-hop document as a record: query, calls with results, answer; tools in first-use order."""
    messages = [("human", doc.get("query") or "")]
    for c in doc.get("calls") or []:
        block = [{"type": "text", "text": c.get("result") or ""}]
        messages += [("function_call", jx.dump({"name": c.get("tool"), "arguments": c.get("arguments") or {}})), ("observation", jx.dump(block))]
    messages.append(("gpt", doc.get("final_answer") or ""))
    used = list(dict.fromkeys(c.get("tool") for c in doc.get("calls") or [] if c.get("tool")))
    lower = {k.lower(): v for k, v in (pool or {}).items()}
    tools = [(pool or {}).get(n) or lower.get(n.lower()) or {"name": n} for n in used]
    return _record(messages, tools, {"turn_1": _properties(messages)["hop"], "augmented": str(bool(doc.get("augmented"))).lower()})


def episode_record(episode: dict) -> dict:
    """An episode's turns as one record; calls take the tool messages that follow, the k-th the k-th (J16);
    where no call resolves, the selected tools are listed."""
    messages, used, properties = [], [], {}
    chosen = {t["name"]: t for t in episode.get("selected_tools") or [] if isinstance(t, dict) and t.get("name")}
    for number, turn in enumerate(episode.get("conversations") or [], 1):
        own = turn.get("messages") or []
        outputs = [m.get("content") or "" for m in own if m.get("role") == "tool"]
        k = 0
        for m in own:
            if m.get("role") == "user":
                messages.append(("human", m.get("content") or ""))
            for call in m.get("tool_calls") or []:
                name = call.get("name") or (call.get("function") or {}).get("name")
                arguments = call.get("arguments") or (call.get("function") or {}).get("arguments") or {}
                messages += [("function_call", jx.dump({"name": name, "arguments": jx.load(arguments) if isinstance(arguments, str) else arguments})), ("observation", outputs[k] if k < len(outputs) else "")]
                k += 1
                if name in chosen and name not in used:
                    used.append(name)
            if m.get("role") == "assistant" and m.get("content"):
                messages.append(("gpt", m["content"]))
        properties[f"turn_{number}"] = "multi-hop" if k >= 2 else "single-hop"
    properties["num_turns"] = str(len(episode.get("conversations") or []))
    return _record(messages, [chosen[n] for n in used] or list(chosen.values()), properties)


def convert(df: DataFrame, raw: str, work, keep: list[str] = ()) -> DataFrame:
    """(keep, record columns): work(value) gives the records of each JSON text; unreadable ones give none."""
    keep = list(keep)

    def run(parts):
        for part in parts:
            rows = []
            for values in part.itertuples(index=False):
                value = jx.load(values[-1])
                if value is not None:
                    got = work(value)
                    rows.extend([*values[:-1], r["conversations"], r["system"], r["tools"], r["properties"]] for r in (got if isinstance(got, list) else [got]))
            yield pd.DataFrame(rows, columns=[*keep, "conversations", "system", "tools", "properties"])

    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, F.col(raw).cast("string")).mapInPandas(run, head + RECORD)


def corpus(df: DataFrame, raw: str, order: str) -> DataFrame:
    """(name, description, schema) of corpus entries, the first of each name and description."""
    made = df.select(F.col(order).alias("_o"), jx.on_text(lambda t: None if (x := corpus_tool(t)) is None else jx.dump(x), F.col(raw)).alias("tool")).where("tool IS NOT NULL")
    flat = made.select("_o", F.get_json_object("tool", "$.name").alias("name"), F.get_json_object("tool", "$.description").alias("description"), F.get_json_object("tool", "$.inputSchema").alias("schema"))
    return flat.groupBy("name", "description").agg(F.min_by("schema", "_o").alias("schema"))


def server_pool(servers: DataFrame, name: str, tools: str, order: str) -> DataFrame:
    """(slug, tool_pos, name, description, schema) of MCP servers (name, JSON list of tools); servers without
    tools are dropped, of two with one slug the later counts (D7)."""
    slugged = servers.withColumn("slug", tx.slug(F.col(name))).where(F.coalesce(F.json_array_length(tools), F.lit(0)) > 0)
    last = slugged.groupBy("slug").agg(F.max_by(tools, order).alias("_t"))
    flat = last.select("slug", F.posexplode(F.from_json("_t", "array<string>")).alias("tool_pos", "_x"))
    schema = jx.on_json(lambda t: jx.schema_of_mcp(t.get("parameters") or []) if isinstance(t, dict) else None, F.col("_x"))
    return flat.select("slug", "tool_pos", F.get_json_object("_x", "$.name").alias("name"), F.get_json_object("_x", "$.description").alias("description"), schema.alias("schema"))


def training_export(records: DataFrame, masked: bool = False) -> DataFrame:
    """Records without properties, with tagged answers (P17) or, masked, with empty observations and answers."""
    value = lambda m: m["value"]
    role = lambda m: m["from"]
    if masked:
        new = lambda m: F.when(role(m) == "observation", "").when(role(m) == "gpt", "<answer></answer>").otherwise(value(m))
    else:
        tagged = lambda m: F.when(tx.blank(value(m)), "<answer></answer>").otherwise(F.concat(F.lit("<answer>"), value(m), F.lit("</answer>")))
        new = lambda m: F.when(role(m) == "gpt", tagged(m)).otherwise(value(m))
    made = F.transform("conversations", lambda m: F.struct(role(m).alias("from"), new(m).alias("value")))
    return records.withColumn("conversations", made).drop("properties")


def single_hop_export(records: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the tool lists (conv_id, tools) in place of their own, raw and masked."""
    listed = records.join(lists.select("conv_id", F.col("tools").alias("_t")), "conv_id", "left").withColumn("tools", F.coalesce("_t", "tools")).drop("_t")
    return training_export(listed), training_export(listed, masked=True)


def grouped_records(msg: DataFrame, records: DataFrame) -> DataFrame:
    """(conv_id, conversations, system, tools, properties): messages folded back into records, in order."""
    folded = msg.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "value"))).alias("_m"))
    made = F.transform("_m", lambda m: F.struct(m["role"].alias("from"), m["value"].alias("value")))
    return records.join(folded, "conv_id").select("conv_id", made.alias("conversations"), F.col("system_prompt").alias("system"), "tools", "properties")


def canonical(value: object) -> str:
    """JSON text with sorted keys, for ids."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)
