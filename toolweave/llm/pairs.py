"""Broken prompt and response pairs (problem 7).

The distinct answers are sorted over the whole table and scanned with a stack of those that begin the present
one: an answer that any other continues inside a word is a shortened version. Lengths at which answers pile
up are length limits. Both speak first; then rules for empty, copied, refusing, cut and wrong-language answers
give each pair at most one defect.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm import language
from toolweave.plans.settle import settle

# Answers that stand for nothing.
PLACEHOLDERS = frozenset(["null", "none", "nil", "nan", "n/a", "na", "undefined", "[]", "{}", "()", "\"\"", "''", "-", "--", "...", "…", "<empty>", "empty", "[none]", "[null]", "(none)", "(empty)"])
# Sentences that decline, by language.
_DECLINES = re.compile(
    r"(?i)\b(can(?:'t|not)(?! help but)|could not(?! help but)|unable to|won't be able|not able|not permitted|not allowed|must decline|have to decline|refuse to)\b.{0,40}\b(help|answer|assist|provide|discuss|do that|carry out|comply|request|question|task|information)"
    r"|\b(must|have to) decline|not permitted to discuss|against my guidelines|(?:would|'d|will|'ll|i) (?:rather|prefer) not (?:to )?(?:answer|discuss|say|share|get into|go into|talk about|help)"
    r"|je ne (peux|suis) pas.{0,30}(aider|autorisé|répondre)|(désolé).{0,10}je ne peux"
    r"|no puedo.{0,20}(ayudar|responder)|no me está permitido|(não posso|não me é permitido|não tenho permissão|não estou autorizad).{0,25}(ajudar|responder|pedido|pergunta)"
    r"|(leider|kann|darf).{0,45}nicht.{0,20}(beantworten|helfen|erfüllen)|(не могу|не имею права|мне не разрешено|не вправе).{0,25}(помочь|ответить|отвечать|выполнить)?"
    r"|(无法|不能|不可以).{0,12}(协助|帮|回答|提供|完成)|(お応え|お答え|回答|お手伝い|対応).{0,12}(できません|することができません|いたしかねます)"
)
# Sentences around a refusal that give nothing either.
_FILLERS = re.compile(
    r"(?i)^\W*(is there anything else|please ask something else|ask me something else|consult a|please consult|thank you for asking|thanks for asking|i(?:'m| am) sorry|sorry|i apologi[sz]e|lo siento|desculpe|désolé|es tut mir leid|tut mir leid|извините|к сожалению|простите|抱歉|很抱歉|对不起|请谅解|申し訳|すみません|¿hay algo más|há mais alguma|y a-t-il autre chose|kann ich sonst|还有什么|他に)"
)
# Names of the languages a question may ask for.
_NAMES = {
    "en": r"english|inglés|inglês|anglais|englisch|английск|英语|英文|英語", "es": r"spanish|español|espanhol|espagnol|spanisch|испанск|西班牙|スペイン語",
    "pt": r"portuguese|portugués|português|portugais|portugiesisch|португальск|葡萄牙|ポルトガル", "fr": r"french|francés|francês|français|französisch|французск|法语|法文|フランス語",
    "de": r"german|alemán|alemão|allemand|deutsch|немецк|德语|德文|ドイツ語", "ru": r"russian|ruso|russo|russe|russisch|русск|俄语|俄文|ロシア語",
    "zh": r"chinese|chino|chinês|chinois|chinesisch|китайск|中文|汉语|中国語", "ja": r"japanese|japonés|japonês|japonais|japanisch|японск|日语|日文|日本語",
}
_NAMED = {k: re.compile(v, re.IGNORECASE) for k, v in _NAMES.items()}
_SENTENCES = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_PROPER_END = re.compile(r"[.!?。！？…;；:：]?[.!?。！？…][\"'”’»」』）)\]*_`]*$")
_LIST_ITEM = re.compile(r"^\s*(?:[-*•‣]|\d+[.)])\s+(?P<item>\S.*)$")
# One word without spaces; in scripts that don't space words no more than a few characters are one.
_BARE = re.compile(r"^(?:[^\s぀-ヿ㐀-鿿]{1,24}|[぀-ヿ㐀-鿿]{1,4})$")
_SYMBOL_END = re.compile(r"[^\w\s,;:(\[{<\-–—\"'“‘«/&+=*]$")
#: Characters a short lead-in before a copied question may have, letters and digits only.
LEAD_IN = 24


def _letters(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalnum())


def is_empty(answer: str | None) -> bool:
    return answer is None or not answer.strip() or answer.strip().strip("\"'`").strip().lower() in PLACEHOLDERS or not answer.strip().strip("\"'`").strip()


def is_copy(question: str | None, answer: str) -> bool:
    """The answer is the question, once or more, apart from case, marks, white space and a short lead-in."""
    q, a = _letters(question or ""), _letters(answer)
    if not q or len(a) < len(q):
        return False
    at = a.find(q)
    return 0 <= at <= LEAD_IN and a[at:].replace(q, "") == ""


def is_refusal(answer: str) -> bool:
    """Some sentence declines, and every other declines or fills."""
    declined = False
    for s in _SENTENCES.findall(answer):
        if not any(c.isalnum() for c in s):
            continue
        if _DECLINES.search(s):
            declined = True
        elif not _FILLERS.search(s):
            return False
    return declined


def open_end(answer: str) -> str:
    """'cut' where the answer stops inside something, 'item' or 'bare' for ends that only look complete, else 'end'."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return "cut"
    plain = re.sub(r"```.*?```", " ", text, flags=re.DOTALL)
    depth = sum(plain.count(c) for c in "([{（【「『") - sum(plain.count(c) for c in ")]}）】」』")
    line = text.rsplit("\n", 1)[-1]
    item = _LIST_ITEM.match(line)
    if item:
        parts = item["item"]
        numbered = re.search(r":\s*\S", parts)
        others = [m["item"] for m in map(_LIST_ITEM.match, text.split("\n")[:-1]) if m]
        # Where the items before have "label: value", one without a value was cut.
        if others and all(re.search(r":\s*\S", x) for x in others) and not numbered and not _PROPER_END.search(parts):
            return "cut"
        return "cut" if parts.endswith((":", ",", "(")) or (not others and not numbered and text != line and not _PROPER_END.search(parts)) else "item"
    bracketed = re.search(r"[(（\[【「『][^)）\]】」』]*$", plain)
    if depth > 0 and bracketed and not re.match(r"^\s*[\[{(]", text):
        return "cut"
    if text.endswith("```"):
        return "end"
    if re.match(r"^[\[{]", text):
        return "end" if depth <= 0 else "cut"
    if _PROPER_END.search(text) or (_SYMBOL_END.search(text) and not text[-1].isalnum()):
        return "end"
    return "bare" if _BARE.match(text) and "\n" not in text else "cut"


def chat_pairs(messages: DataFrame, conv: str, pos: str, role: str, value: str) -> DataFrame:
    """(conv, pos, question, answer): each human message with the first gpt or assistant message after it
    and before the next human one; the answer is null if there is none. Values are taken as they are."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(pos).alias("pos"), F.col(role).alias("role"), F.col(value).alias("value"))
    rows = rows.where(F.col("role").isin("human", "gpt", "assistant"))
    turn = F.expr("count_if(role = 'human') OVER (PARTITION BY conv ORDER BY pos, role DESC ROWS UNBOUNDED PRECEDING)")
    by = rows.withColumn("turn", turn).where("turn > 0").groupBy("conv", "turn")
    human = F.min(F.when(F.col("role") == "human", F.struct("pos", "value")))
    first = F.min(F.when(F.col("role") != "human", F.struct("pos", "value")))
    return by.agg(human.alias("q"), first.alias("a")).select(F.col("conv").alias(conv), F.col("q.pos").alias(pos), F.col("q.value").alias("question"), F.col("a.value").alias("answer"))


#: Characters of open answers that may be sent to every task; more are joined by shuffle.
SENT_CHARS = 8_000_000


def shortened(pairs: DataFrame, least: int = 40) -> DataFrame:
    """(answer) of the distinct answers of at least ``least`` characters that another answer continues inside a word or number.

    Answers are range-partitioned and sorted, so those that begin with an answer follow it in a row; a stack
    holds the answers that begin the present one and are not yet known to be shortened. What is on the stack at the
    end of a partition is compared with the answers that begin with the same ``least`` characters anywhere.
    """
    rows = pairs.where(F.length("answer") >= least).select("answer")
    ordered = rows.distinct().repartitionByRange("answer").sortWithinPartitions("answer")

    def run(batches):
        stack: list[str] = []
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                while stack and not x.startswith(stack[-1]):
                    stack.pop()
                done = [a for a in stack if _continues(a, x)]
                if done:
                    out.extend((a, True) for a in done)
                    stack[:] = [a for a in stack if a not in done]
                if x[-1:].isalnum():
                    stack.append(x)
            yield _rows(out)
        yield _rows([(a, False) for a in stack])

    marked = settle(ordered.mapInArrow(run, "answer string, found boolean"), "neighbours")
    left = marked.where("NOT found").select(F.col("answer").alias("a"), F.substring("answer", 1, least).alias("_head"))
    size = left.agg(F.coalesce(F.sum(F.length("a")), F.lit(0))).first()[0]
    left = F.broadcast(left) if size <= SENT_CHARS else left
    crossing = rows.withColumn("_head", F.substring("answer", 1, least)).join(left, "_head").where("startswith(answer, a) AND length(answer) > length(a)")
    return marked.where("found").select("answer").unionByName(crossing.select("a", "answer").mapInArrow(_cross, "answer string")).distinct()


def _continues(a: str, b: str) -> bool:
    return len(b) > len(a) and b.startswith(a) and a[-1:].isalnum() and b[len(a)].isalnum()


def _rows(out: list[tuple[str, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([m for _, m in out], pa.bool_())], names=["answer", "found"])


def _cross(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _continues(a, b)], pa.string())], names=["answer"])


def length_spikes(pairs: DataFrame, least: int = 20, times: float = 8.0) -> list[int]:
    """Lengths at which at least ``least`` answers lie and ``times`` as many as at the mean of the 10 lengths
    to either side. One row per length comes to the driver: as many as the longest answer has characters."""
    counts = {r["n"]: r["c"] for r in pairs.where("answer IS NOT NULL").groupBy(F.length("answer").alias("n")).agg(F.count(F.lit(1)).alias("c")).where("n >= 100").collect()}
    near = lambda n: sum(counts.get(n + d, 0) for d in range(-10, 11) if d) / 20
    return sorted(n for n, c in counts.items() if c >= least and c >= times * max(1.0, near(n)))


def defects(pairs: DataFrame, keys: list[str], model: dict) -> DataFrame:
    """(keys, defect) of the pairs (keys, question, answer) with a defect, at most one each, tried in this
    order: empty, copy, refusal, truncated, other_language.

    Null and blank answers are empty; a null question can be neither copied nor of another language.
    Answers or questions of fewer than 12 letters have no language. Repeated rows repeat.
    """
    pairs = settle(pairs, "pairs")
    spikes = frozenset(length_spikes(pairs))
    short = shortened(pairs).withColumn("_short", F.lit(True))
    rows = pairs.join(short, "answer", "left").select(*keys, "question", "answer", F.coalesce("_short", F.lit(False)).alias("_short"))
    sent = pairs.sparkSession.sparkContext.broadcast(model)
    held: list[language.Scores] = []
    wide = len(keys)

    def run(batches):
        for batch in batches:
            # Words seen so far are kept, up to a bound.
            if not held or len(held[0].at) > language.MOST_WORDS:
                held[:] = [language.Scores(sent.value["words"], sent.value["han"])]
            q, a, s = (batch.column(wide + k).to_pylist() for k in range(3))
            found = [_by_rules(x, y, z, spikes) for x, y, z in zip(q, a, s, strict=True)]
            open_ = [i for i, d in enumerate(found) if d is None and q[i]]
            asked, given = _languages(held[0], [q[i] for i in open_]), _languages(held[0], [a[i] for i in open_])
            for i, x, y in zip(open_, asked, given, strict=True):
                if x and y and not x & y and not any(_NAMED[lang].search(q[i]) for lang in y):
                    found[i] = "other_language"
            at = pa.array([i for i, d in enumerate(found) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(wide)), pa.array([d for d in found if d], pa.string())], names=[*keys, "defect"])

    kinds = "".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{kinds}defect string")


def _by_rules(question: str | None, answer: str | None, short: bool, spikes: frozenset[int]) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if short:
        return "truncated"
    end = open_end(answer)
    return "truncated" if end == "cut" or (end != "end" and len(answer) in spikes) else None


def _languages(scores: language.Scores, texts: list[str]) -> list[set[str]]:
    out: list[set[str]] = [set() for _ in texts]
    if texts:
        owner, lang, _, _, _, letters = language.segment(scores, texts, [None] * len(texts))
        for t, k in zip(owner.tolist(), lang.tolist(), strict=True):
            if letters[t] >= language.LEAST_LETTERS:
                out[t].add(language.LANGUAGES[k])
    return out
