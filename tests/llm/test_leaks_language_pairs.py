import re

import pytest
from pyspark.sql import functions as F

from toolweave.llm import language, leaks, pairs

ITEM = "Could you fetch the upcoming visa rules for Krenrei within one hour? Show me whether Gliandflei can publish coach timetables."


def found(spark, texts, nested=False, items=((1, ITEM), (2, "too short"), (3, None))):
    a = spark.createDataFrame(list(items), "item_id long, text string")
    b = spark.createDataFrame(list(enumerate(texts)), "conv_id long, value string")
    return sorted(set(map(tuple, leaks.leaked_items(a, "item_id", "text", b, "conv_id", "value", nested=nested).collect())))


def test_leak_edges(spark):
    words = re.findall("[A-Za-z0-9]+", ITEM)
    texts = [
        ITEM, "so: " + " -- ".join(w.upper() for w in words[2:17]) + "!", " ".join(words[:14]), "x" + " ".join(words[:15]), " ".join(words[:15]) + "s",
        None, "", "é" * 10_000 + " " + " ".join(words[1:16]) + " " + "ü" * 10_000, " ".join(words[:8]) + " well " + " ".join(words[8:16]),
    ]
    assert [c for _, c in found(spark, texts)] == [0, 1, 7]


def test_leak_nested(spark):
    import json

    part = " ".join(re.findall("[A-Za-z0-9]+", ITEM)[:15])
    texts = [json.dumps([{"description": part}]), json.dumps(json.dumps({"a": {"b": [part]}})), json.dumps([{"x": part[:40]}, {"y": part[40:]}]), "{broken " + part, None, "null", json.dumps([{"d": "line\n" + part.replace(" ", "\t")}])]
    assert [c for _, c in found(spark, texts, nested=True)] == [0, 1, 6]


def test_leak_empty(spark):
    assert found(spark, []) == [] and found(spark, [ITEM], items=[]) == []


def test_short_words(spark):
    item = "a b c d e f g h i j k l m n o p"
    assert found(spark, ["x a b c d e f g h i j k l m n o y", "a b c d e f g h i j k l m n z"], items=[(1, item)]) == [(1, 0)]


def word_edits(item, text, words, edits):
    """Whether a passage of the item stands in the text with so few edits, by the whole table of distances."""
    a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (item, text))
    for s in range(len(a) - words + 1):
        row = [0] * (len(b) + 1)
        for x in a[s : s + words]:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        if min(row) <= edits:
            return True
    return False


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leak_edits_against_brute_force(edits):
    import random

    rng = random.Random(edits)
    vocabulary = ["a", "to", "of", "visa", "rules", "timetable", "within", "publish", "coach", "hour", "x1", "extraordinarily"]
    items = [(i, " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(rng.randint(14, 24)))) for i in range(12)]
    texts = []
    for _ in range(80):
        w = rng.choice(items)[1].split()[rng.randint(0, 4) :]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice([[], ["replaced"], ["some", "more"]])
        texts.append(("before " * rng.randint(0, 3) + ", ".join(w) + " after" * rng.randint(0, 3)).upper())
    index = leaks.ItemIndex(items, 15, edits, leaks.Q)
    assert set(index.search(texts)) == {(t, i) for t, x in enumerate(texts) for i, y in items if word_edits(y, x, 15, edits)}


def test_one_replaced_word_is_found(spark):
    words = re.findall("[A-Za-z0-9]+", ITEM)[:18]
    words[9] = "somethingelse"
    a = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    b = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:9]))], "conv_id long, value string")
    assert leaks.leaked_items(a, "item_id", "text", b, "conv_id", "value").count() == 0
    assert [tuple(r) for r in leaks.leaked_items(a, "item_id", "text", b, "conv_id", "value", edits=1, q=8).collect()] == [(1, 7)]


def test_many_items_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MAX_ITEM_CHARS", 300)
    items = [(i, f"{ITEM} number {i}") for i in range(9)]
    assert found(spark, [ITEM], items=items) == [(i, 0) for i in range(9)]


EN = "The list of all orders was sent to the office and they have not been able to find it. "
FR = "Les factures de la semaine ont été envoyées à tous les clients qui les attendaient depuis le mois dernier. "
ES = "Los pedidos de la semana se enviaron a todos los clientes que los esperaban desde el mes pasado. "
DE = "Die Rechnungen der Woche wurden an alle Kunden geschickt, die seit dem letzten Monat auf sie gewartet haben. "
RU = "Все заказы были отправлены клиентам на прошлой неделе, ошибок не было. "
ZH = "编号已经关闭，所有的订单都已经顺利保存了。"
JA = "番号はすでに閉じられ、注文は問題なく保存しました。"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t * 2, lang) for lang, t in (("en", EN), ("fr", FR), ("es", ES), ("de", DE), ("ru", RU), ("zh", ZH), ("ja", JA)) for _ in range(6)]
    return language.learn([(spark.createDataFrame([(f"{t} {i}", lang) for i, (t, lang) in enumerate(rows)], "t string, l string"), "t", "l")])


def test_segments(spark, model):
    texts = [EN, EN + FR + EN, ZH + EN, JA, RU + "\n" + DE, ES, "Voulfiax", None, "", "12 34 🙂", (EN * 400) + FR * 3, ZH[:8] + "Voulfiax" + ZH[8:]]
    df = spark.createDataFrame([(i, t, "en_GB") for i, t in enumerate(texts)], "id long, t string, l string").withColumn("lang", F.lit(1))
    out = {}
    for r in language.segments(df, ["id"], "t", "l", model).orderBy("id", "seg").collect():
        out.setdefault(r.id, []).append(r.lang)
        assert r.declared == "en" and 0.5 < r.confidence <= 1
    assert out == {0: ["en"], 1: ["en", "fr", "en"], 2: ["zh", "en"], 3: ["ja"], 4: ["ru", "de"], 5: ["es"], 10: ["en", "fr"], 11: ["zh"]}
    assert language.segments(df.limit(0), ["id"], "t", "l", model).count() == 0


def test_declared_codes(spark):
    labels = ["en", "EN", "en-US", "pt_BR", "English", " zho ", "", "und", "unknown", None, "Chinese", "xx"]
    df = spark.createDataFrame([(x,) for x in labels], "l string").select(language.declared_code(F.col("l")))
    assert [r[0] for r in df.collect()] == ["en", "en", "en", "pt", "en", "zh", None, None, None, None, "zh", None]


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 5, 1])
    score = rng.normal(size=(10, 3)).astype(np.float32)
    penalty = rng.uniform(0.1, 1, 10).astype(np.float32)
    path, at = language.viterbi(score, lengths, penalty), 0
    for n in lengths.tolist():
        value = lambda p: sum(score[at + k, s] for k, s in enumerate(p)) - sum(penalty[at + k] for k in range(1, n) if p[k] != p[k - 1])  # noqa: B023, E731
        if n:
            best = max(value(p) for p in itertools.product(range(3), repeat=n))
            assert abs(value(path[at : at + n].tolist()) - best) < 1e-4
        at += n


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("How many?", None, "empty"), ("How many?", " \n", "empty"), ("How many?", "null", "empty"), ("How many?", "[]", "empty"), ("How many?", "42", None), ("How many?", "OK", None), ("When?", "17:30", None),
        ("How many orders are there?", "how many orders are there", "copy"), ("How many orders are there?", "You asked: How many orders are there? How many orders are there?", "copy"),
        ("How many orders are there?", "You asked: How many orders are there? There are 7 of them.", None), ("Which?", "I'm sorry, but I can't help with that request. Please ask something else.", "refusal"),
        ("Which?", "I can't help but admire the answer.", None), ("Which?", "I'd rather not get into that.", "refusal"), ("Which?", "I'm not able to print them, so I sent a file. The list holds 7 orders.", None), ("Which?", "很抱歉，我无法协助您完成这个请求，请谅解。", "refusal"), ("Which?", "Sorry for the wait. The list holds 7 orders.", None),
        ("Which?", "The list holds 7 orders. However, the", "truncated"), ("Which?", "The rest is listed here (orders, rules", "truncated"), ("Which?", 'Done.\n```json\n{"status": "a', "truncated"),
        ("Which?", 'Done.\n```json\n{"status": 1}\n```', None), ("Which?", "These:\n- orders: 7\n- rules: 12", None), ("Which?", "Great, all done 👍", None), ("Which?", "编号已经关闭，所有的订单", "truncated"), ("Which?", "编号已经关闭。", None),
    ],
)
def test_rules(question, answer, defect):
    assert pairs._by_rules(question, answer, False, frozenset()) == defect


def test_pairs_and_languages(spark, model):
    rows = [
        (1, 0, "human", EN), (1, 1, "function_call", "{}"), (1, 2, "gpt", FR), (1, 3, "human", "Please answer in French. " + EN), (1, 4, "assistant", FR), (1, 5, "human", EN),
        (2, 0, "gpt", "Hello."), (2, 1, "human", None), (2, 2, "gpt", EN + FR), (2, 3, "human", EN), (2, 4, "gpt", EN + FR),
    ]
    msg = spark.createDataFrame(rows, "conv_id long, pos int, role string, value string").withColumn("question", F.lit(0))
    made = pairs.chat_pairs(msg, "conv_id", "pos", "role", "value")
    assert made.count() == 5
    got = sorted(map(tuple, pairs.defects(made, ["conv_id", "pos"], model).collect()))
    assert got == [(1, 0, "other_language"), (1, 5, "empty")]
    assert pairs.defects(made.limit(0), ["conv_id", "pos"], model).count() == 0


def test_shortened(spark):
    full = "The list of the orders holds: alpha 77, beta 12, and gamma 8345 in the end"
    rows = [(1, full), (2, full[:-4]), (3, full[: full.index("345")]), (4, None), (5, full)]
    df = spark.createDataFrame(rows, "k long, answer string")
    assert {r[0] for r in pairs.shortened(df).collect()} == {full[: full.index("345")]}


def test_length_spikes(spark):
    rows = [("a" * 200,)] * 50 + [("b" * n,) for n in range(120, 280)]
    assert pairs.length_spikes(spark.createDataFrame(rows, "answer string")) == [200]


def test_shortened_with_others_between(spark):
    """The continuing answer need not be the next in order, nor in the same partition."""
    head = "The parcel that you asked for was left at the ba"
    rows = [head, head + ".", head + "! Thank you", head + "nk of the river.", head + "nk of the ri", "Another answer that is long enough to be compared", None]
    df = spark.createDataFrame([(x,) for x in rows], "answer string")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r[0] for r in pairs.shortened(df).collect()} == {head, head + "nk of the ri"}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_shortened_against_brute_force(spark):
    import random

    rng = random.Random(8)
    answers = {"z" * 40 + "".join(rng.choice("ab .") for _ in range(rng.randint(0, 7))) for _ in range(400)}
    got = {r[0] for r in pairs.shortened(spark.createDataFrame([(x,) for x in answers], "answer string").repartition(5)).collect()}
    assert got == {a for a in answers if any(pairs._continues(a, b) for b in answers)}


def test_a_length_limit_speaks_first(spark):
    assert pairs._by_rules("Which?", "These:\n- orders: 7\n- rules: 12", False, frozenset({30})) == "truncated"
    assert pairs._by_rules("Which?", "The list holds 7 orders.", False, frozenset({24})) is None
