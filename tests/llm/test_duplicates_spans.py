import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from toolweave.llm import ballhash, spans


def texts(n, seed, size=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    return rng, [" ".join(rng.choice(words) for _ in range(size)) for _ in range(n)]


def jaccard(a, b):
    x, y = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_pairs_against_brute_force(spark):
    rng, base = texts(120, 3)
    rows = list(enumerate(base))
    for i in range(60):
        w = base[i].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 9))
        rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, ""), (903, "ab"), (904, base[0]), (0, base[0])]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("cls", F.lit("clash"))
    pairs, members = ballhash.similar_pairs(df, "id", F.col("t"), 0.7)
    got = {tuple(sorted(r)) for r in ballhash.member_pairs(pairs, members, "id").collect()}
    known = {i: t for i, t in rows if t is not None}
    truth = {(a, b) for a, b in itertools.combinations(sorted(known), 2) if jaccard(known[a], known[b]) >= 0.7}
    assert got <= truth
    assert len(got) >= 0.97 * len(truth)
    assert (0, 904) in got and (901, 902) in got


def test_similar_pairs_empty(spark):
    df = spark.createDataFrame([], "id long, t string")
    pairs, members = ballhash.similar_pairs(df, "id", F.col("t"), 0.7)
    assert pairs.count() == 0 and members.count() == 0


def test_first_version_counts(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    df = spark.createDataFrame([(1, "2024", a), (1, "2025", b), (2, "2024", b)], "id long, v string, t string")
    pairs, members = ballhash.similar_pairs(df, "id", F.col("t"), 0.7, F.col("v"))
    assert ballhash.member_pairs(pairs, members, "id").count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    v, w = np.sort(rng.integers(0, 1 << 40, 1000)), rng.integers(0, 1 << 16, 1000)
    a, b = ballhash._unpack(ballhash._pack(v, w))
    assert (a == v).all() and (b == w).all()


def test_ball_meets_in_the_middle():
    x = np.arange(1, 15, dtype=np.int64)[None, :]
    y, z = x.copy(), x.copy()
    y[0, 3] = 99
    y[0, 8:] = 77
    z[0, [1, 2, 8, 9]] = 99
    v = [set(ballhash.variants(p, 7)[0].tolist()) for p in (x, y, z)]
    assert len(v[0]) == 14 and len(v[0] & v[1]) == 1 and not v[0] & v[2]


def test_recall_at_the_threshold_at_every_size():
    """Texts with a similarity of 0.70 to 0.75 meet as often in a table of a hundred million rows as in a small one."""
    rng, _ = texts(1, 1)
    pairs = []
    while len(pairs) < 300:
        letters = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(80, 200))]
        other = letters.copy()
        for _ in range(rng.randint(2, 9)):
            other[rng.randrange(len(other))] = rng.choice("0123456789")
        a, b = "".join(letters), "".join(other)
        if 0.70 <= jaccard(a, b) <= 0.75:
            pairs.append((a, b))
    for rows in (2_000, 200_000, 20_000_000, 100_000_000):
        symbols, tables = ballhash.shape_for(rows, 0.7)
        a, b = (ballhash.variants(ballhash.fingerprints(list(x), 5, symbols, tables)[0], symbols) for x in zip(*pairs, strict=True))
        recall = (a == b).any(axis=1).mean()
        assert recall >= 0.95, (rows, symbols, tables, recall)


def test_common_values_meet_in_cells(spark, monkeypatch):
    """Records that share one value by the hundred are paired outside the ranges, and none is lost."""
    monkeypatch.setattr(ballhash, "OFTEN", 20)
    rng, base = texts(2, 31, 60)
    rows = [(i, f"{base[0]} {i}") for i in range(90)] + [(100 + i, f"{base[1]} {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    pairs, members = ballhash.similar_pairs(df, "id", F.col("t"), 0.7)
    assert {tuple(r) for r in ballhash.member_pairs(pairs, members, "id").collect()} == set(itertools.combinations(range(90), 2)) | set(itertools.combinations(range(100, 110), 2))
    assert {tuple(r)[2:] for r in ballhash.class_links(pairs, members, "id").collect()} == {(1, 89), (1, 9)}


def brute_spans(docs, least):
    out = set()
    grams = {}
    for i, t in docs.items():
        for k in range(len(t) - least + 1):
            grams.setdefault(t[k : k + least], set()).add(i)
    for g in grams.values():
        out |= set(itertools.combinations(sorted(g), 2))
    return out


def run_spans(spark, rows, **more):
    """(spans, members, pairs of documents, characters shared by document)."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    found = spans.search(df, "doc_id", "text", **more)
    share = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_share(found).collect()}
    return found.cold().unionByName(spans.hot_spans(found)), found.members, {tuple(r) for r in spans.found_pairs(found).collect()}, share


def test_spans_against_brute_force(spark):
    rng, base = texts(40, 5, 80)
    rows = list(enumerate(base))
    for i in range(20):
        a, b = rng.sample(base, 2)
        cut = rng.randint(150, 320)
        at = rng.randint(0, max(0, len(a) - cut))
        rows.append((len(rows), b[: rng.randint(0, 200)] + a[at : at + cut] + b[-50:]))
    rows += [(500, None), (501, ""), (502, "short"), (503, "short"), (504, base[3]), (505, "aé👍" * 400), (506, "aé👍" * 300)]
    _, members, got, _ = run_spans(spark, rows)
    assert got == brute_spans({i: t for i, t in rows if t}, 200)
    assert members.where("doc_id = 501").count() == 1


def test_common_shingles_go_by_whole_windows(spark):
    """More than PAIRED texts share 160 characters, two of them 230."""
    rng, base = texts(spans.PAIRED + 20, 7, 30)
    common = "z" + "".join(rng.choice("qwertyuiop ") for _ in range(159))
    rows = [(i, t[:100] + common + t[100:]) for i, t in enumerate(base)]
    rows.append((1000, "start " + rows[0][1][60:300]))
    _, _, got, _ = run_spans(spark, rows)
    assert got == brute_spans(dict(rows), 200) == {(0, 1000)}


def test_shared_share(spark):
    rng, base = texts(3, 9, 100)
    rows = [(1, base[0]), (2, base[1] + base[0][50:350]), (3, base[2]), (4, base[2]), (5, "tiny")]
    _, _, _, got = run_spans(spark, rows)
    assert 300 <= got[1][1] <= 303 and 300 <= got[2][1] <= 303
    assert got[3] == (len(base[2]), len(base[2])) == got[4] and got[5] == (4, 0)


def test_spans_empty(spark):
    assert run_spans(spark, [])[2] == set()


def test_all_stretches_of_a_diagonal(spark):
    """One character replaced at place 1,000 leaves two spans on the same diagonal, and both count."""
    text = texts(1, 11, 800)[1][0][:4000]
    other = text[:1000] + "#" + text[1001:]
    shared, _, _, share = run_spans(spark, [(1, text), (2, "ab" + other)])
    assert sorted((r.start_a, r.start_b, r.length) for r in shared.collect()) == [(0, 2, 1000), (1001, 1003, 2999)]
    assert {n for _, n in share.values()} == {3999}


def test_every_repeat_of_a_common_banner_counts(spark):
    """A banner stands more than PAIRED times in one text and once in another: all its places are shared."""
    rng, pages = texts(spans.PAIRED + 6, 13, 20)
    banner = "".join(rng.choice("QWERTYUIOP") for _ in range(250))
    rows = [(1, banner.join(f"{p}." for p in pages) + banner), (2, "#" + banner + "#")]
    _, _, got, share = run_spans(spark, rows)
    assert got == {(1, 2)}
    assert {k: n for k, (_, n) in share.items()} == {1: len(pages) * 250, 2: 250}


def maximal(docs, least):
    """All maximal shared spans (a, b, start_a, start_b, length) by comparing every alignment of every two texts."""
    out = set()
    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = spans.points_of([docs[a]]), spans.points_of([docs[b]])
        for d in range(-len(y) + 1, len(x)):
            out |= {(a, b, s, s - d, n) for s, n in spans.stretches(x, y, d, least)}
    return out


def test_one_passage_in_very_many_texts(spark):
    """Twice as many texts as are paired at once share a passage, some of them more of what is around it: one row for each two texts, with its whole length."""
    rng, base = texts(120, 17, 12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = []
    for i, t in enumerate(base):
        left, right = ("left " * 4, " right" * 3) if i % 3 == 0 else ("", "")
        rows.append((i, t[: rng.randint(0, 60)] + left + passage + right + t[60:]))
    rows.append((200, base[0][-50:]))
    shared, _, got, share = run_spans(spark, rows)
    found = [tuple(r) for r in shared.collect()]
    assert {f[:2] for f in found} == set(itertools.combinations(range(120), 2)) and len(found) == 7140
    docs = dict(rows)
    for a, b, i, j, n in found:
        assert n >= 400 and docs[a][i : i + n] == docs[b][j : j + n]
        assert (not i or not j or docs[a][i - 1] != docs[b][j - 1]) and docs[a][i + n : i + n + 1] != docs[b][j + n : j + n + 1]
    assert got == set(itertools.combinations(range(120), 2))
    assert all(n >= 400 for i, (_, n) in share.items() if i < 120)


def test_spans_do_not_depend_on_the_switch(spark, monkeypatch):
    rng, base = texts(14, 19, 40)
    passages = [base[i][10:240] for i in range(3)]
    rows = [(i, rng.choice(passages).join(t[40 * k : 40 * k + 40] for k in range(3)) + rng.choice(passages) * 2) for i, t in enumerate(base)] + [(50, "-" * 230), (51, "-" * 215 + "+")]
    results = []
    for most in (0, 3, 1000):
        monkeypatch.setattr(spans, "PAIRED", most)
        shared, _, got, share = run_spans(spark, rows)
        found = sorted(map(tuple, shared.collect()))
        assert len(found) == len(set(found))
        results.append((found, got, share))
    assert results[0] == results[1] == results[2]
    assert set(results[0][0]) == maximal(dict(rows), 200)


def test_bands_are_tuned():
    assert spans.tuned(1.0) == (1, 12)
    bands, rows = spans.tuned(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.98 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_every_span_holds_a_paragraph_of_both_texts():
    rng, base = texts(30, 23, 60)
    for t in base:
        at = rng.randint(0, len(t) - 200)
        values = [set(spans.cut_paragraphs([x], 200, 2)[1].tolist()) for x in (t, "before " + t[at : at + 200] + " after")]
        assert values[0] & values[1]


def test_paragraph_clusters(spark):
    """Near copies of one paragraph in many texts and chains of links, against brute force."""
    rng, base = texts(60, 29, 60)
    rows = []
    for i, t in enumerate(base):
        near = base[i % 5].split()
        for _ in range(i % 3):
            near[rng.randrange(len(near))] = "edit"
        rows.append((i, f"{t}\n\n  {' '.join(near)}\n \nshort"))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("off", F.lit("clash"))
    clusters = spans.paragraph_clusters(df, "doc_id", "text")
    got = [tuple(r) for r in clusters.select("doc_id", "off", "cluster", "kept").collect()]
    parts = {(i, o): p for i, t in rows if t and i is not None for o, p in spans.layout_paragraphs(t, 80)}
    assert {(i, o) for i, o, _, _ in got} == set(parts) and len(got) == len(parts)
    of = {(i, o): c for i, o, c, _ in got}
    sets = {k: spans.word_shingles(p) for k, p in parts.items()}
    true = [(x, y) for x, y in itertools.combinations(sets, 2) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    assert sum(of[x] == of[y] for x, y in true) >= 0.98 * len(true)
    kept = [c for _, _, c, k in got if k]
    assert len(kept) == len(set(kept)) == len(set(of.values()))
    gone = {r.doc_id: (r.paragraphs, r.removed) for r in spans.removals(clusters, "doc_id").collect()}
    assert gone[102] == (2, 2) and 100 not in gone
    assert spans.paragraph_clusters(df.limit(0), "doc_id", "text").count() == 0


def test_recall_of_the_bands():
    """Paragraphs just at the similarity meet in a band as often as they were tuned to."""
    bands, rows = spans.tuned(0.8)
    met = 0
    for i in range(150):
        words = [f"w{i}x{k}" for k in range(104)]
        # 90 of 110 shingles in common: 100 each, ten of which are the paragraph's own.
        a, b = words, words[:94] + [f"v{i}x{k}" for k in range(11)]
        x, y = spans.word_shingles(" ".join(a)), spans.word_shingles(" ".join(b))
        assert 0.79 <= len(x & y) / len(x | y) <= 0.83
        met += any(p == q for p, q in zip(spans.band_values(" ".join(a), bands, rows), spans.band_values(" ".join(b), bands, rows), strict=True))
    assert met >= 0.95 * 150
