"""Functions of the package for SQL (UD1): scalar, aggregate and table functions under the prefix tw_."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from toolweave.functions import jsonx as jx


def register(spark: SparkSession) -> list[str]:
    """Register the functions with a session; returns their names.

    tw_rouge_l(a, b), tw_clean_json(text), tw_repair_json(text), tw_summary(schema): scalars in Arrow batches.
    tw_unit_sum(vectors): an aggregate, the unit vector along the sum of a group's vectors.
    tw_calls(text): a table function, (call_no, tool, result) of a trajectory document.
    """
    from toolweave.operators.scoring import rouge_l

    def texts(work):
        def run(x: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else work(t) for t in x], dtype=object)

        return pandas_udf(run, "string")

    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rouge_l(x, y) for x, y in zip(a, b, strict=True)])

    def unit(v: pd.Series) -> list:
        rows = [x for x in v if x is not None]
        total = np.sum([np.asarray(x, dtype=float) for x in rows], axis=0) if rows else np.zeros(0)
        norm = np.linalg.norm(total)
        return (total / norm if norm else total).tolist()

    class Calls:
        def eval(self, text: str):
            for c in (jx.trajectory(text) or {"calls": []})["calls"] if text else []:
                yield c["index"], c["tool"], c["result"]

    clean = lambda t: None if (v := jx.load(t)) is None else jx.dump(jx.without_hollow(v))
    summary = lambda t: jx.parameter_summary(v) if isinstance(v := jx.load(t), dict) else None
    named = {
        "tw_rouge_l": pandas_udf(pairs, "double"), "tw_clean_json": texts(clean), "tw_repair_json": texts(jx.repaired), "tw_summary": texts(summary), "tw_unit_sum": pandas_udf(unit, "array<double>"),
    }
    for name, function in named.items():
        spark.udf.register(name, function)
    spark.udtf.register("tw_calls", udtf(Calls, returnType="call_no int, tool string, result string"))
    return [*named, "tw_calls"]
