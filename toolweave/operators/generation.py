"""Operators with a model in the loop. Clients are injected; the defaults work offline and are deterministic.

A client is a picklable callable: chat clients map a list of messages to a text, embedding clients a list
of texts to a list of vectors. They run inside the tasks, one call per batch or row.
"""

from __future__ import annotations

import functools
import hashlib
import random
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toolweave.functions import jsonx as jx
from toolweave.operators import conversations as cv

Chat = Callable[[list[dict]], str]
Embed = Callable[[list[str]], list[list[float]]]


class ClientError(Exception):
    """A call that failed; ``retry`` tells whether another try may help, ``after`` how long the service asks to wait."""

    def __init__(self, message: str, retry: bool = True, after: float | None = None):
        super().__init__(message)
        self.retry, self.after = retry, after


def with_retries(call: Callable, tries: int = 5, base: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> Callable:
    """Call again after retryable errors, with doubling, jittered waits or the wait the service names."""
    jitter = random.Random(seed)

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except ClientError as e:
                if not e.retry or k == tries - 1:
                    raise
                sleep(e.after if e.after is not None else min(most, base * 2**k) * (0.5 + jitter.random() / 2))

    return run


@functools.lru_cache(maxsize=100_000)
def _direction(word: str, size: int) -> np.ndarray:
    return np.random.default_rng(int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")).standard_normal(size)


def hash_embedding(texts: list[str], size: int = 32) -> list[list[float]]:
    """S14, offline: the sum of a fixed random direction for each word, of unit length."""
    out = []
    for text in texts:
        v = np.zeros(size)
        for w in text.lower().split():
            v += _direction(w, size)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def echo_chat(messages: list[dict]) -> str:
    """S15, offline: the last user message back as an answer."""
    said = [m["content"] or "" for m in messages if m["role"] == "user"]
    return "<answer>" + (said[-1] if said else "") + "</answer>"


def filled(template: str, values: dict[str, object]) -> str:
    """{{name}} placeholders replaced; unknown ones stay."""
    for k, v in values.items():
        template = template.replace("{{" + k + "}}", "" if v is None else str(v))
    return template


def bundle(text: str, marker: str = "=====") -> dict[str, str]:
    """The parts of a prompt bundle between lines '===== NAME ====='."""
    parts, name = {}, None
    for line in text.split("\n"):
        if line.startswith(marker) and line.rstrip().endswith(marker):
            name = line.strip("= ").strip()
            parts[name] = []
        elif name is not None:
            parts[name].append(line)
    return {k: "\n".join(v).strip() for k, v in parts.items()}


def embed(df: DataFrame, key: str, text: str, client: Embed = hash_embedding, batch: int = 512) -> DataFrame:
    """(key, embedding) in batches; the client must give one vector per text. Null texts are left out."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))

    def run(parts):
        for part in parts:
            vectors = []
            for i in range(0, len(part), batch):
                texts = part["_t"].iloc[i : i + batch].tolist()
                got = client(texts)
                if len(got) != len(texts):
                    raise ClientError(f"{len(got)} vectors for {len(texts)} texts", retry=False)
                vectors.extend(got)
            yield pd.DataFrame({key: part[key], "embedding": vectors})

    return rows.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<double>")


def assembled(msg: DataFrame, records: DataFrame, n: int) -> DataFrame:
    """(conv_id, prompt array<struct<role, content>>): system text, the history before the n-th call, and the
    last question unless the history ends with it. Observations have the role tool, blank ones as '{}'."""
    upto = cv.by_pos().rowsBetween(Window.unboundedPreceding, 0)
    marked = msg.withColumn("_n", F.count_if(F.col("role") == "function_call").over(upto))
    cut = marked.where((F.col("role") == "function_call") & (F.col("_n") == n)).select("conv_id", F.col("pos").alias("_at"))
    rows = marked.join(cut, "conv_id").where("pos < _at")
    names = F.when(F.col("role") == "human", "user").when(F.col("role") == "observation", "tool").otherwise("assistant")
    content = F.when((F.col("role") == "observation") & (F.trim(F.coalesce("value", F.lit(""))) == ""), "{}").otherwise(F.coalesce("value", F.lit("")))
    said = F.array_sort(F.collect_list(F.struct("pos", names.alias("role"), content.alias("content"))))
    by = rows.groupBy("conv_id").agg(said.alias("_h"))
    history = F.transform("_h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    system = F.array(F.struct(F.lit("system").alias("role"), F.coalesce("system_prompt", F.lit("")).alias("content")))
    return cut.join(records.select("conv_id", "system_prompt"), "conv_id").join(by, "conv_id", "left").select("conv_id", F.concat(system, F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))).alias("prompt"))


def infer(prompts: DataFrame, key: str, prompt: str, client: Chat = echo_chat, done: DataFrame | None = None) -> DataFrame:
    """G1: (key, answer): one call per row that ``done`` (key, answer) does not have yet; a failed call gives a
    null answer, to be tried again in the next run. Write the result and pass it as ``done`` to resume (J10)."""
    todo = prompts if done is None else prompts.join(done.where("answer IS NOT NULL").select(key), key, "left_anti")

    def run(parts):
        for part in parts:
            answers = []
            for messages in part[prompt]:
                try:
                    answers.append(client([{"role": m["role"], "content": m["content"]} for m in messages]))
                except ClientError:
                    answers.append(None)
            yield pd.DataFrame({key: part[key], "answer": pd.Series(answers, dtype=object)})

    return todo.select(key, prompt).mapInPandas(run, f"`{key}` {prompts.schema[key].dataType.simpleString()}, answer string")


def generate(df: DataFrame, keep: list[str], values: list[str], template: str, client: Chat, read: Callable[[str], object], tries: int = 3) -> DataFrame:
    """(keep, output, tries): ``template`` filled with the row's values is asked until ``read``
    gives a value, at most ``tries`` times; output is its JSON, null where no try succeeded."""
    keep, values = list(keep), list(values)

    def run(parts):
        for part in parts:
            out, used = [], []
            for row in part.to_dict("records"):
                found, k = None, 0
                while found is None and k < tries:
                    k += 1
                    try:
                        found = read(client([{"role": "user", "content": filled(template, {v: row[v] for v in values} | {"try": k})}]))
                    except ClientError as e:
                        if not e.retry:
                            break
                out.append(None if found is None else jx.dump(found))
                used.append(k)
            yield part[keep].assign(output=pd.Series(out, dtype=object, index=part.index), tries=used)

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)
    return df.select(*dict.fromkeys([*keep, *values])).mapInPandas(run, f"{kinds}output string, tries int")


def stepwise(df: DataFrame, key: str, query: str, tools: str, planner: Chat, simulator: Chat, most: int = 5) -> DataFrame:
    """(key, document): calls planned one at a time with the results so far, each simulated, until the
    planner says done or ``most`` calls; the document is JSON as trajectory_xml takes it, null if no call was made."""

    def run(parts):
        for part in parts:
            made = []
            for q, t in zip(part[query], part[tools], strict=True):
                calls: list[dict] = []
                while len(calls) < most:
                    step = jx.object_in(planner([{"role": "user", "content": jx.dump({"query": q, "tools": t, "calls": calls})}])) or {"done": True}
                    if step.get("done") or not step.get("tool_name"):
                        break
                    result = simulator([{"role": "user", "content": jx.dump(step)}])
                    calls.append({"index": len(calls) + 1, "tool": step["tool_name"], "arguments": step.get("arguments") or {}, "result": result})
                made.append(jx.dump({"query": q, "calls": calls, "final_answer": calls[-1]["result"]}) if calls else None)
            yield pd.DataFrame({key: part[key], "document": pd.Series(made, dtype=object)})

    return df.select(key, query, tools).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, document string")


def episodes(df: DataFrame, key: str, seed: int, turns: Callable[[int], int], turn: Callable[[dict], dict | None], tries: int = 3) -> DataFrame:
    """(key, episode): turns generated one after the other, each from the state of those before; a turn that
    fails ``tries`` times ends the episode as null. The seed of an episode is seed + key for any number of workers (q31)."""

    def run(parts):
        for part in parts:
            made = []
            for k in part[key]:
                state: dict | None = {"key": int(k), "seed": seed + int(k), "turns": []}
                for i in range(turns(seed + int(k))):
                    got = next((x for t in range(tries) if (x := turn(state | {"turn": i + 1, "try": t})) is not None), None)
                    if got is None:
                        state = None
                        break
                    state["turns"].append(got)
                made.append(None if state is None else jx.dump(state))
            yield pd.DataFrame({key: part[key], "episode": pd.Series(made, dtype=object)})

    return df.select(key).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, episode string")


def keyword_labels(text: str, categories: list[str], domains: list[str]) -> dict:
    """G9, offline: the first label whose stem stands in the text, else the first by hash."""
    low = text.lower()
    pick = lambda labels: next((x for x in labels if x[:5] in low), labels[int(hashlib.md5(low.encode()).hexdigest(), 16) % len(labels)])
    return {"category": pick(categories), "domain": pick(domains)}


def classify(df: DataFrame, key: str, text: str, categories: list[str], domains: list[str], client: Callable[[str], dict] | None = None, tries: int = 3) -> DataFrame:
    """(key, category, domain): labels from the closed sets; others are asked for again and null at last."""
    ask = client or (lambda t: keyword_labels(t, categories, domains))

    def run(parts):
        for part in parts:
            rows = []
            for t in part["_t"]:
                good = None
                for _ in range(tries):
                    got = ask(t) or {}
                    if got.get("category") in categories and got.get("domain") in domains:
                        good = got
                        break
                rows.append((good["category"], good["domain"]) if good else (None, None))
            yield pd.DataFrame({key: part[key], "category": [a for a, _ in rows], "domain": [b for _, b in rows]})

    return df.select(key, F.coalesce(text, F.lit("")).alias("_t")).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, category string, domain string")


def hash_judge(text: str, metrics: list[str]) -> dict:
    """G11, offline: scores from 1 to 10 by a hash of metric and text."""
    return {m: int(hashlib.md5(f"{m}\n{text}".encode()).hexdigest(), 16) % 10 + 1 for m in metrics}


def judge(df: DataFrame, key: str, text: str, metrics: list[str], client: Callable[[str, list[str]], dict] = hash_judge) -> DataFrame:
    """(key, one int per metric); scores outside 1 to 10, or missing, are null."""

    def run(parts):
        for part in parts:
            got = [client(t, metrics) or {} for t in part["_t"]]
            good = lambda v: v if isinstance(v, (int, float)) and 1 <= v <= 10 else None
            yield pd.DataFrame({key: part[key]} | {m: pd.array([good(g.get(m)) for g in got], dtype="Int64") for m in metrics})

    return df.select(key, F.coalesce(text, F.lit("")).alias("_t")).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`{m}` bigint" for m in metrics))
