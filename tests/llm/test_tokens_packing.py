import base64
import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from toolweave.llm import bpe, packing, tokens

PATH = bpe.tokenizer_path("byte_bpe_50k.tiktoken")
_ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=_ranks, special_tokens={})


def encoded(texts):
    ids, at = bpe.load(PATH).encode(texts)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def test_hand_made_texts():
    texts = [None, "", " ", "  a", "a ", "a  b", "a \n b", "\r\n\t x", "aaaa" * 99, "<|endoftext|> é é 👍🏽", "don't we'll", "\x00 \x00a b\x00 c", "x　 y", "a b", "12 345", "請 読む" * 50]
    assert encoded(texts) == [REFERENCE.encode_ordinary(t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab '\n\t .,1é中́👍\x00")), max_size=60), max_size=5))
def test_any_text(texts):
    assert encoded(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_encode_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", None), (3, "Hello world", "y"), (4, "word " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r[0], list(r[1])) for r in tokens.encode(df, "doc_id", "text").collect())
    assert got == sorted((i, REFERENCE.encode_ordinary(t or "")) for i, t, _ in rows)
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def checked(sizes, capacity):
    container, place = packing.pack_block(sizes, capacity)
    sums = {}
    for c, s in zip(container, sizes):
        sums[c] = sums.get(c, 0) + s
    assert all(v <= capacity for v in sums.values())
    assert len({*zip(container, place)}) == len(sizes)
    return sums


def test_pack_is_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 900) for _ in range(2000)]
    assert len(checked(sizes, 2048)) <= -(-sum(sizes) // 2048) + 1


def test_pack_optimal_on_small_cases():
    assert len(checked([5, 5, 5, 5], 10)) == 2
    assert len(checked([6, 4, 6, 4], 10)) == 2
    assert len(checked([0, 0], 10)) == 1
    assert checked([], 10) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_pack_any(sizes):
    checked(sizes, 50)


def test_fill_container_finds_the_best_sum():
    left = {9: 2, 7: 1, 4: 3, 1: 1}
    picked = packing.fill_container(left, sorted(left, reverse=True), 21)
    assert sum(a * b for a, b in picked) == 21 and all(b <= left[a] for a, b in picked)


def test_pack_table(spark):
    rows = [(1, 5000), (2, None), (3, 0), (4, 2048), (5, 100), (5, 100), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n int")
    got = packing.pack(df, "doc_id", "n", 2048).collect()
    assert sorted((r.piece, r.n_tokens) for r in got if r.doc_id == 1) == [(0, 2048), (1, 2048), (2, 904)]
    assert len(got) == 9 and sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    assert packing.pack(df.limit(0), "doc_id", "n", 2048).count() == 0
    again = packing.pack(df.repartition(3), "doc_id", "n", 2048).collect()
    key = lambda r: (r.container, r.place, r.piece, r.n_tokens, r.doc_id or -1)
    assert sorted(map(key, got)) == sorted(map(key, again))
