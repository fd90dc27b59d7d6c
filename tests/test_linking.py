import itertools
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from toolweave.operators.linking import components, group_pairs
from toolweave.plans import settle as plans_settle


def test_pairs_of_a_large_group_are_those_of_small_ones(spark):
    rows = [("hot", i, i % 7) for i in range(150)] + [("cold", i, i) for i in range(5)] + [("alone", 1, 1), (None, 1, 1), ("cold", None, 3), ("twice", 4, 1), ("twice", 4, 2), ("twice", 5, 3)]
    df = spark.createDataFrame(rows, "g string, m long, c int").withColumn("_n", F.lit("clash"))
    got = [tuple(r) for r in group_pairs(df, ["g"], "m", ["c"], block=20).collect()]
    want = []
    for g in ("hot", "cold", "twice"):
        own = sorted((m, c) for x, m, c in rows if x == g and m is not None)
        want += [(g, a, b, x, y) for (a, x), (b, y) in itertools.combinations(own, 2) if a != b]
    assert sorted(got) == sorted(want)
    odd = group_pairs(df, ["g"], "m", ["c"], F.expr("c_l <> c_r"), block=20)
    assert odd.count() == sum(x != y for *_, x, y in want)
    assert group_pairs(df.limit(0), ["g"], "m").count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300, 360)] + [(i, i) for i in range(3)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, 600 + i) for i in range(50)] + [(None, 1), (2, None)]
    root = {x: x for e in links if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in root}
    assert components(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, name, other=None):
            return self.master if name == "spark.master" else other

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    with pytest.raises(RuntimeError):
        plans_settle.shared_dir(Session("spark://host:7077"))


def test_finished_tables_are_dropped(spark: SparkSession):
    made = plans_settle.settle(spark.range(10).toDF("id"), "gone")
    kept = plans_settle.settle(spark.range(10).toDF("id"), "kept")
    files = made.inputFiles()
    plans_settle.drop(made)
    import os

    assert not os.path.exists(files[0].removeprefix("file://").removeprefix("file:")) and kept.count() == 10
