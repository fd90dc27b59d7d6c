"""Classes of records with equal text, so that a text repeated in a third of all rows is handled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.plans.settle import settle

#: Ids that may be sent to every task; more are joined by shuffle.
SENT_IDS = 500_000


def sent(ids: DataFrame) -> tuple[DataFrame, int]:
    """The ids, marked for broadcast if they are at most SENT_IDS, and their number up to one more than that."""
    few = ids.limit(SENT_IDS + 1).count()
    return (F.broadcast(ids) if few <= SENT_IDS else ids), few


def classed(df: DataFrame, key: str, text: Column, version: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: doc, cls, n_chars), (one text per class: doc, text).

    A class is named by its least key. Of rows with the same key only the one with the least ``version`` counts (as text; null
    first), of several such that with the least hash. Rows whose key or text is null take no part. Texts are shuffled
    only for keys that stand more than once, as long as the ids of copies are few enough to be sent around.
    """
    version = (F.lit("") if version is None else version).cast("string")
    rows = df.select(F.col(key).alias("doc"), text.alias("text"), version.alias("_v")).where("doc IS NOT NULL AND text IS NOT NULL")
    digest = F.unhex(F.md5("text"))
    hashed = rows.select("doc", "_v", digest.alias("_h"), F.length("text").alias("n_chars"))
    named = hashed.groupBy("doc").agg(F.min(F.struct("_v", "_h", "n_chars")).alias("_r"), F.count(F.lit(1)).alias("_rows"))
    named = settle(named.select("doc", "_r._h", "_r.n_chars", "_rows"), "hashed")
    least = named.groupBy("_h").agg(F.min("doc").alias("cls"))
    members = settle(named.join(least, "_h").select("doc", "cls", "n_chars", "_rows"), "members")
    odd, few = sent(members.where("doc <> cls OR _rows > 1").select("doc"))
    unique = rows.select("doc", "text")
    if few:
        again = members.where("doc = cls AND _rows > 1").select("doc")
        again = F.broadcast(again) if few <= SENT_IDS else again
        again = rows.join(again, "doc", "left_semi").groupBy("doc").agg(F.min(F.struct("_v", digest.alias("_h"), "text")).alias("_t")).select("doc", "_t.text")
        unique = unique.join(odd, "doc", "left_anti").unionByName(again)
    return members.drop("_rows"), unique
