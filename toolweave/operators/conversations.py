"""Turns, hops, flow checks and message rewriting over one table of messages.

Every operator takes ``msg`` with conv_id, pos, role and value, one row per message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from toolweave.functions import text as tx

ANSWERS = ("gpt", "assistant")


def by_pos() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("pos")


def _is(role: str) -> Column:
    return F.col("role") == role


def with_turns(msg: DataFrame) -> DataFrame:
    """Msg + turn, from 1; messages before the first human one are turn 0."""
    upto = by_pos().rowsBetween(Window.unboundedPreceding, 0)
    return msg.withColumn("turn", F.sum(_is("human").cast("int")).over(upto).cast("bigint"))


def turn_hops(msg: DataFrame) -> DataFrame:
    """(conv_id, turn, n_calls, hop) of every turn; two or more calls are multi-hop, none counts as single-hop."""
    calls = F.count_if(_is("function_call"))
    turns = with_turns(msg).where("turn > 0").groupBy("conv_id", "turn").agg(calls.alias("n_calls"))
    return turns.withColumn("hop", F.when(F.col("n_calls") >= 2, "multi-hop").otherwise("single-hop"))


def conversation_types(msg: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turn_type, max_calls): none without a human message, else single-turn or multi-turn."""
    turns = F.count_if(_is("human"))
    base = msg.groupBy("conv_id").agg(turns.alias("n_turns"))
    calls = turn_hops(msg).groupBy("conv_id").agg(F.max("n_calls").alias("max_calls"))
    kind = F.when(F.col("n_turns") == 0, "none").when(F.col("n_turns") == 1, "single-turn").otherwise("multi-turn")
    return base.join(calls, "conv_id", "left").select("conv_id", "n_turns", kind.alias("turn_type"), F.coalesce("max_calls", F.lit(0)).alias("max_calls"))


def hop_turn_stats(msg: DataFrame) -> DataFrame:
    """A2: (kind, label, n, share): conversations by turn type and turns by hop label, shares within the kind."""
    types = conversation_types(msg).select(F.lit("conversation").alias("kind"), F.col("turn_type").alias("label"))
    hops = turn_hops(msg).select(F.lit("turn").alias("kind"), F.col("hop").alias("label"))
    counts = types.unionByName(hops).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6)
    return counts.withColumn("share", share)


def turn_distribution(msg: DataFrame) -> DataFrame:
    """A2: (n_turns, n) conversations by their number of turns."""
    return conversation_types(msg).groupBy("n_turns").agg(F.count(F.lit(1)).alias("n"))


def direct_answers(msg: DataFrame) -> DataFrame:
    """(conv_id, direct): whether a human message is followed at once by an answer."""
    hit = _is("human") & F.lead("role").over(by_pos()).isin(*ANSWERS)
    return msg.withColumn("_hit", F.coalesce(hit, F.lit(False))).groupBy("conv_id").agg(F.max("_hit").alias("direct"))


def without_direct_answers(msg: DataFrame) -> DataFrame:
    """the messages of conversations without a direct answer."""
    return msg.join(direct_answers(msg).where("direct"), "conv_id", "left_anti")


def call_name(value: Column) -> Column:
    """The called tool's name, null where the value is no JSON object or the name is absent or blank."""
    name = F.get_json_object(value, "$.name")
    return F.when(value.rlike(r"^\s*\{") & ~tx.blank(name), name)


def call_arguments(value: Column) -> Column:
    """The arguments as JSON text without white space; null where absent or null."""
    return F.regexp_replace(F.get_json_object(value, "$.arguments"), r"\s+", "")


def empty_calls(msg: DataFrame) -> DataFrame:
    """(conv_id) with a call that is blank, unreadable, no object or nameless."""
    return msg.where(_is("function_call") & call_name(F.col("value")).isNull()).select("conv_id").distinct()


def empty_arguments(msg: DataFrame) -> DataFrame:
    """(conv_id, pos, name) of named calls whose arguments are absent, null or {}; [] passes."""
    call = msg.where(_is("function_call")).select("conv_id", "pos", call_name(F.col("value")).alias("name"), call_arguments(F.col("value")).alias("arguments"))
    return call.where("name IS NOT NULL AND coalesce(arguments, '{}') = '{}'").select("conv_id", "pos", "name")


def flow_issues(msg: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """F8: (conv_id, issue), each once: a call not followed by an observation or at the end, an observation
    followed by something else than a message of role gpt or a call, a call that is no JSON, a call that is no object, has no
    member name or whose arguments are a text that is no JSON, and, where ``tools`` (conv_id, name) is given, a
    call of a tool its conversation does not list. An observation at the end passes, and so does a blank name. Null calls are no JSON."""
    nxt = F.col("_nxt")
    call, observed = _is("function_call"), _is("observation")
    parsed = F.try_parse_json("value")
    member = lambda name, kind: F.try_variant_get(parsed, f"$.{name}", kind)
    odd = (F.col("value").rlike(r"^\s*\{") & member("name", "variant").isNotNull()).eqNullSafe(False)
    text = F.when(F.schema_of_variant(member("arguments", "variant")) == "STRING", member("arguments", "string"))
    unreadable = text.isNotNull() & F.try_parse_json(text).isNull()
    flags = F.array_compact(F.array(
        F.when(call & nxt.isNull(), F.lit("incomplete_flow")),
        F.when(call & (nxt != "observation"), F.lit("invalid_flow")),
        F.when(observed & ~nxt.isin("gpt", "function_call"), F.lit("invalid_flow")),
        F.when(call & parsed.isNull(), F.lit("invalid_json")),
        F.when(call & parsed.isNotNull() & (odd | F.coalesce(unreadable, F.lit(False))), F.lit("invalid_function_call_json")),
    ))
    found = msg.withColumn("_nxt", F.lead("role").over(by_pos())).select("conv_id", F.explode(flags).alias("issue")).distinct()
    if tools is None:
        return found
    called = msg.where(call).select("conv_id", call_name(F.col("value")).alias("name")).where("name IS NOT NULL").distinct()
    unknown = called.join(tools.select("conv_id", "name").distinct(), ["conv_id", "name"], "left_anti")
    return found.unionByName(unknown.select("conv_id", F.lit("tool_not_found").alias("issue")).distinct())


def issue_counts(issues: DataFrame) -> DataFrame:
    """A4: (issue, n) conversations by issue; one may count in several."""
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def answer_tags(msg: DataFrame) -> DataFrame:
    """Answers of role gpt inside <answer> tags, blank or null ones as an empty tag."""
    tagged = F.when(tx.blank(F.col("value")), "<answer></answer>").otherwise(F.concat(F.lit("<answer>"), F.col("value"), F.lit("</answer>")))
    return msg.withColumn("value", F.when(_is("gpt"), tagged).otherwise(F.col("value")))


def training_mask(msg: DataFrame) -> DataFrame:
    """Observations as '', answers of role gpt as an empty tag."""
    return msg.withColumn("value", F.when(_is("observation"), F.lit("")).when(_is("gpt"), F.lit("<answer></answer>")).otherwise(F.col("value")))


def tag_content(value: Column, tag: str) -> Column:
    """P20: the text inside the first <tag>, to the end where it is not closed; null where it is absent or empty."""
    closed = F.nullif(F.regexp_extract(value, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))
    unclosed = F.when(~value.contains(f"</{tag}>"), F.nullif(F.regexp_extract(value, rf"(?s)<{tag}>\s*(.*?)\s*$", 1), F.lit("")))
    return F.coalesce(closed, unclosed)


def ordinals(msg: DataFrame) -> DataFrame:
    """Msg + n_call, n_answer (running counts), last_observation (position of the latest observation before)."""
    upto = by_pos().rowsBetween(Window.unboundedPreceding, 0)
    before = by_pos().rowsBetween(Window.unboundedPreceding, -1)
    return msg.select(
        "*",
        F.count_if(_is("function_call")).over(upto).alias("n_call"),
        F.count_if(F.col("role").isin(*ANSWERS)).over(upto).alias("n_answer"),
        F.max(F.when(_is("observation"), F.col("pos"))).over(before).alias("last_observation"),
    )


def history(msg: DataFrame, n: int) -> DataFrame:
    """(conv_id, pos, n_before, history): the text of all messages before the n-th call, 'role: value'
    by line; it stops before the first null value."""
    upto = by_pos().rowsBetween(Window.unboundedPreceding, 0)
    marked = msg.withColumn("_stop", F.max(F.col("value").isNull().cast("int")).over(upto)).withColumn("_n", F.count_if(_is("function_call")).over(upto))
    cut = marked.where(_is("function_call") & (F.col("_n") == n)).select("conv_id", F.col("pos").alias("_at"))
    rows = marked.join(cut, "conv_id").where((F.col("pos") < F.col("_at")) & (F.col("_stop") == 0))
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(": ", "role", "value").alias("line"))))
    kept = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_before"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))
    out = cut.join(kept, "conv_id", "left")
    return out.select("conv_id", F.col("_at").alias("pos"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("history", F.lit("")).alias("history"))


def used_tools(msg: DataFrame) -> DataFrame:
    """(conv_id, name, first_pos, rank): distinct called tools in the order of their first use."""
    calls = msg.where(_is("function_call")).select("conv_id", "pos", call_name(F.col("value")).alias("name")).where("name IS NOT NULL")
    first = calls.groupBy("conv_id", "name").agg(F.min("pos").alias("first_pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_pos")))


def first_call(msg: DataFrame) -> DataFrame:
    """(conv_id, pos, value) of the first call."""
    calls = msg.where(_is("function_call")).groupBy("conv_id").agg(F.min(F.struct("pos", "value")).alias("_m"))
    return calls.select("conv_id", "_m.pos", "_m.value")


def last_answers(msg: DataFrame) -> DataFrame:
    """(conv_id, n_answers, last_blank, same_as_before): the last answer against the one before it."""
    answers = msg.where(F.col("role").isin(*ANSWERS)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_a"))
    last, before = F.try_element_at("_a", F.lit(-1))["value"], F.try_element_at("_a", F.lit(-2))["value"]
    return answers.select("conv_id", F.size("_a").cast("bigint").alias("n_answers"), tx.blank(last).alias("last_blank"), F.coalesce(last == before, F.lit(False)).alias("same_as_before"))


def answer_audit(msg: DataFrame) -> DataFrame:
    """Counters of the answer extraction over all conversations."""
    return last_answers(msg).agg(
        F.count(F.lit(1)).alias("conversations"), F.coalesce(F.sum("n_answers"), F.lit(0)).alias("answers"),
        F.count_if("last_blank").alias("blank_last"), F.count_if("same_as_before").alias("same_last"), F.count_if(F.col("n_answers") == 1).alias("single_answer"),
    )


def cjk_by_file(records: DataFrame, file: str, index: str, text: str, pattern: str) -> DataFrame:
    """(file, n, n_cjk, pct, example): rows of a file with a character of the class and the first such row."""
    hit = F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    by = records.withColumn("_hit", hit).groupBy(file).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("n_cjk"), F.min(F.when(F.col("_hit"), F.col(index))).alias("example")
    )
    return by.select(file, "n", "n_cjk", F.round(100 * F.col("n_cjk") / F.col("n"), 2).alias("pct"), "example")


def metadata_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn_key, hop) from properties named turn_<k>; other names that begin so are ignored."""
    entries = records.select("conv_id", F.explode("properties").alias("turn_key", "hop"))
    return entries.where(F.col("turn_key").rlike(r"^turn_\d+$"))


def observation_blocks(msg: DataFrame) -> DataFrame:
    """(conv_id, pos, block, type, n_items): the blocks of each readable observation array."""
    rows = msg.where(_is("observation") & F.col("value").rlike(r"^\s*\[")).select("conv_id", "pos", F.from_json("value", "array<string>").alias("_b"))
    blocks = rows.select("conv_id", "pos", F.posexplode("_b").alias("block", "_x"))
    items = F.coalesce(F.json_array_length(F.get_json_object("_x", "$.items")), F.lit(0))
    return blocks.select("conv_id", "pos", "block", F.get_json_object("_x", "$.type").alias("type"), items.alias("n_items"))


def paired_results(msg: DataFrame) -> DataFrame:
    """(conv_id, turn, ordinal, call_pos, result_pos): the n-th call of a turn with its n-th observation, null where there is none."""
    turns = with_turns(msg).where("turn > 0 AND role IN ('function_call', 'observation')")
    ordinal = F.row_number().over(Window.partitionBy("conv_id", "turn", "role").orderBy("pos"))
    rows = turns.withColumn("ordinal", ordinal)
    calls = rows.where(_is("function_call")).select("conv_id", "turn", "ordinal", F.col("pos").alias("call_pos"))
    results = rows.where(_is("observation")).select("conv_id", "turn", "ordinal", F.col("pos").alias("result_pos"))
    return calls.join(results, ["conv_id", "turn", "ordinal"], "left")
