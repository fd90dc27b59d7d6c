"""Queries over scores, calls, vectors and samples; their inputs are derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from toolweave.operators import sampling as sa, scoring as sc, similarity as sim
from toolweave.plans.base import TOOL_SQL, tools
from toolweave.plans.settle import settle
from toolweave.sources.tables import SENT_KEYS, first_deliveries, table

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def scores(s, d, augmented=False):
    """Six metrics of each document, by its id: (id * (2i + 1) + i) mod 10 + 1, null where (id + i) mod 17 = 0."""
    doc = table(s, d, "documents").select("doc_id")
    value = lambda i: (F.col("doc_id") * (2 * i + 1) + i) % 10 + 1
    moved = lambda i: F.greatest(F.lit(1), F.least(F.lit(10), value(i) + F.col("doc_id") % 3 - 1)) if augmented else value(i)
    return doc.select("doc_id", *[F.when((F.col("doc_id") + i) % 17 != 0, moved(i)).alias(m) for i, m in enumerate(sc.METRICS)])


def _score_sql(name="sco", shift=False):
    def value(i):
        v = f"(doc_id * {2 * i + 1} + {i}) % 10 + 1"
        return f"greatest(1, least(10, {v} + doc_id % 3 - 1))" if shift else v

    return f"{name} AS (SELECT doc_id, " + ", ".join(f"CASE WHEN (doc_id + {i}) % 17 <> 0 THEN {value(i)} END AS {m}" for i, m in enumerate(sc.METRICS)) + " FROM documents)"


_LIST = "[" + ", ".join(sc.METRICS) + "]"
_GATE = _score_sql() + f""", av AS (SELECT doc_id, round(list_avg(list_filter({_LIST}, lambda x: x IS NOT NULL)), 6) AS average, list_min({_LIST})::DOUBLE AS min_score FROM sco),
gate AS (SELECT *, CASE WHEN average IS NULL THEN 'no_scores' WHEN min_score < 4 AND average < 8 THEN 'min_and_mean' WHEN min_score < 4 THEN 'min' WHEN average < 8 THEN 'mean' ELSE 'ok' END AS reason FROM av)"""


def calls(s, d):
    """True calls by order: the first three of an order are turn 1, the rest turn 2."""
    rows = table(s, d, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    rows = rows.withColumn("pos", rank)
    return rows.select(
        F.col("l_orderkey").alias("conv_id"), F.when(F.col("pos") <= 3, 1).otherwise(2).alias("turn"), "pos", F.concat(F.lit("tool_"), (F.col("l_partkey") % 50).cast("string")).alias("name"),
        F.col("l_quantity").cast("int").alias("qty"), F.round(F.col("l_discount") * 100).cast("int").alias("discount"), "l_partkey", "l_suppkey", "l_linenumber",
    )


def truth(s, d, of=None):
    return (calls(s, d) if of is None else of).select("conv_id", "turn", "pos", "name", F.concat_ws(":", "qty", "discount").alias("arguments"))


def predicted(s, d, of=None):
    """The calls without some, some with another quantity, some under another name."""
    rows = (calls(s, d) if of is None else of).where((F.col("l_partkey") + F.col("l_linenumber")) % 7 != 0)
    qty = F.when(F.col("l_suppkey") % 5 == 0, F.col("qty") + 1).otherwise(F.col("qty"))
    name = F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("other_"), F.col("name"))).otherwise(F.col("name"))
    return rows.select("conv_id", "turn", "pos", name.alias("name"), F.concat_ws(":", qty, "discount").alias("arguments"))


_CALLS = """cl AS (SELECT l_orderkey AS conv_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos, 'tool_' || (l_partkey % 50) AS name,
l_quantity::INT AS qty, round(l_discount * 100)::INT AS discount, l_partkey, l_suppkey, l_linenumber FROM lineitem),
tru AS (SELECT conv_id, CASE WHEN pos <= 3 THEN 1 ELSE 2 END AS turn, pos, name, qty || ':' || discount AS a FROM cl),
pre AS (SELECT conv_id, CASE WHEN pos <= 3 THEN 1 ELSE 2 END AS turn, pos, CASE WHEN l_partkey % 11 = 0 THEN 'other_' || name ELSE name END AS name, (CASE WHEN l_suppkey % 5 = 0 THEN qty + 1 ELSE qty END) || ':' || discount AS a FROM cl WHERE (l_partkey + l_linenumber) % 7 <> 0),
p1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, name, a ORDER BY pos) AS r FROM pre),
t1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, name, a ORDER BY pos) AS r FROM tru),
ex AS (SELECT p1.conv_id, p1.turn, p1.pos AS p_pos, t1.pos AS t_pos FROM p1 JOIN t1 USING (conv_id, turn, name, a, r)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, name ORDER BY pos) AS r FROM pre WHERE (conv_id, pos) NOT IN (SELECT conv_id, p_pos FROM ex)),
t2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, name ORDER BY pos) AS r FROM tru WHERE (conv_id, pos) NOT IN (SELECT conv_id, t_pos FROM ex)),
ma AS (SELECT conv_id, turn, p_pos, t_pos, true AS exact FROM ex UNION ALL SELECT conv_id, turn, p2.pos, t2.pos, false FROM p2 FULL JOIN t2 USING (conv_id, turn, name, r)),
mt AS (SELECT conv_id, turn, count(p_pos) AS n_pred, count(t_pos) AS n_true, count(*) FILTER (p_pos IS NOT NULL AND t_pos IS NOT NULL) AS n_matched, count(*) FILTER (exact) AS n_exact FROM ma GROUP BY ALL),
me AS (SELECT conv_id, turn, n_pred, n_true, n_matched, CASE WHEN n_pred > 0 AND n_pred = n_matched THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strict_precision, round(coalesce(n_matched / nullif(n_pred, 0), 0), 6) AS flexible_precision, round(coalesce(n_exact / nullif(n_pred, 0), 0), 6) AS strict_accuracy FROM mt)"""


def _dims(by):
    k, g, j = (f"{by}, ", f"{by}, ", f"AND w.{by} = g.{by}") if by else ("", "", "")
    source = f"(SELECT *, conv_id % 3 AS {by} FROM me)" if by else "me"
    w = f"(SELECT DISTINCT {by} FROM {source}) CROSS JOIN" if by else ""
    return f"""rows_ AS (SELECT {k}CASE WHEN n_true >= 2 THEN 'multi-hop' ELSE 'single-hop' END AS dimension, strict_precision, flexible_precision, strict_accuracy FROM {source}
UNION ALL SELECT {k}CASE WHEN count(*) >= 2 THEN 'multi-turn' ELSE 'single-turn' END, avg(strict_precision), avg(flexible_precision), avg(strict_accuracy) FROM {source} GROUP BY {k}conv_id),
g AS (SELECT {g}dimension, count(*) AS n, avg(strict_precision) AS a, avg(flexible_precision) AS b, avg(strict_accuracy) AS c FROM rows_ GROUP BY ALL),
w AS (SELECT * FROM {w} (SELECT unnest(['single-hop', 'multi-hop', 'single-turn', 'multi-turn']) AS dimension)),
dim AS (SELECT {"w." + by + ", " if by else ""}w.dimension, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS strict_precision, round(coalesce(b, 0), 6) AS flexible_precision, round(coalesce(c, 0), 6) AS strict_accuracy FROM w LEFT JOIN g ON w.dimension = g.dimension {j})"""


def _flexible(s, d):
    """The quantity as a text of 10 words, of which a changed call differs in one, so it is flexibly equal."""
    as_json = lambda df: df.withColumn("arguments", F.to_json(F.struct(F.concat(F.lit("a b c d e f g h i "), F.split("arguments", ":")[0]).alias("qty"), F.split("arguments", ":")[1].alias("discount"))))
    p, t = as_json(predicted(s, d)), as_json(truth(s, d))
    return sc.flexible_accuracy(sc.match_calls(p, t), p, t)


def _metrics(s, d):
    """Both sides from one ranking of the calls; the metrics are read several times, so they are written once."""
    ranked = settle(calls(s, d), "calls")
    return settle(sc.turn_metrics(sc.match_calls(predicted(s, d, ranked), truth(s, d, ranked))), "metrics")


def _linked(s, d):
    """Calls with results of several shapes. Where the order is even a call's argument is made from the result of the one
    before: the same value, a part of it, a text that holds it or two of its words; every ninth is named in the query too."""
    rows = calls(s, d)
    before = Window.partitionBy("conv_id").orderBy("pos")
    last, shape = (F.lag(c).over(before) for c in ("l_suppkey", "l_partkey"))
    last, shape = F.concat(F.lit("77"), last.cast("string")), shape % 5
    used = F.when(shape == 0, F.concat(F.lit("item_"), last)).when(shape == 1, last).when(shape == 2, F.concat(F.lit("Ann Lee "), last)).when(shape == 3, F.concat(F.lit("see ref-"), last, F.lit(" now"))).otherwise("active")
    used = F.when((F.col("conv_id") % 2 == 0) & used.isNotNull(), used).otherwise(F.lit("from_query"))
    own = F.concat(F.lit("77"), F.col("l_suppkey").cast("string"))
    kind = F.col("l_partkey") % 5
    result = F.when(kind == 0, F.concat(F.lit("id: item_"), own)).when(kind == 1, F.concat(F.lit('found "post_id_'), own, F.lit('"'))).when(kind == 2, F.concat(F.lit("<item>Author: Ann Lee "), own, F.lit(", Title: none</item>"))).when(kind == 3, F.concat(F.lit("<cell>ref-"), own, F.lit("</cell>"))).otherwise("status: active")
    asked = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("please use from_query and "), used)).otherwise("please use from_query")
    return rows.select("conv_id", "turn", "pos", F.array(used, F.lit("true")).alias("arguments"), result.alias("result"), asked.alias("query"), F.when(F.col("conv_id") % 7 == 0, "mixed").when(F.col("conv_id") % 7 == 1, "parallel").alias("label"))


_GENERIC = "[" + ", ".join(f"'{w}'" for w in sc.GENERIC) + "]"
_FOUND = " || ".join("regexp_extract_all(result, '{}', {})".format(p, g) for p, g in sc.MINED)
_LINKED = _CALLS + f""", li0 AS (SELECT *, CASE WHEN pos <= 3 THEN 1 ELSE 2 END AS turn, '77' || lag(l_suppkey) OVER w AS b, lag(l_partkey) OVER w % 5 AS g FROM cl WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
li1 AS (SELECT *, CASE WHEN conv_id % 2 = 0 AND b IS NOT NULL THEN CASE g WHEN 0 THEN 'item_' || b WHEN 1 THEN b WHEN 2 THEN 'Ann Lee ' || b WHEN 3 THEN 'see ref-' || b || ' now' ELSE 'active' END ELSE 'from_query' END AS used,
CASE l_partkey % 5 WHEN 0 THEN 'id: item_77' || l_suppkey WHEN 1 THEN 'found "post_id_77' || l_suppkey || '"' WHEN 2 THEN '<item>Author: Ann Lee 77' || l_suppkey || ', Title: none</item>' WHEN 3 THEN '<cell>ref-77' || l_suppkey || '</cell>' ELSE 'status: active' END AS result FROM li0),
li AS (SELECT *, CASE WHEN conv_id % 9 = 0 THEN 'please use from_query and ' || used ELSE 'please use from_query' END AS query FROM li1),
mv AS (SELECT conv_id, turn, pos, unnest(list_transform(flatten(list_transform({_FOUND}, lambda v: string_split(regexp_replace(lower(v), '^[^:]*:', ''), ','))), lambda v: trim(v))) AS m FROM li),
mi AS (SELECT * FROM mv WHERE length(m) >= 3 AND NOT list_contains({_GENERIC}, m) AND (regexp_matches(m, '[0-9_.-]') OR length(m) > 8)),
us AS (SELECT DISTINCT x.conv_id, x.turn FROM (SELECT conv_id, turn, pos, lower(query) AS q, lower(used) AS v FROM li) x JOIN mi USING (conv_id, turn) WHERE mi.pos < x.pos AND NOT list_contains({_GENERIC}, v) AND (regexp_matches(v, '[0-9_.-]') OR length(v) > 12) AND NOT contains(q, v) AND (contains(m, v) OR contains(v, m))),
st AS (SELECT conv_id, turn, CASE WHEN bool_or(u) THEN 'serial' ELSE 'parallel' END AS strategy, count(*) AS n_calls FROM (SELECT l.conv_id, l.turn, us.conv_id IS NOT NULL AS u FROM li l LEFT JOIN us ON us.conv_id = l.conv_id AND us.turn = l.turn) GROUP BY ALL)"""
_DECLARED = _LINKED + """, uo AS (SELECT DISTINCT x.conv_id, x.turn FROM (SELECT conv_id, turn, pos, query, unnest([used, 'true']) AS v FROM li) x JOIN li y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.pos < x.pos WHERE length(v) >= 3 AND NOT contains(lower(x.query), lower(v)) AND (contains(lower(y.result), lower(v)) OR contains(lower(v), lower(y.result)))),
sd AS (SELECT l.conv_id, l.turn, CASE WHEN l.conv_id % 7 = 0 THEN 'serial' WHEN l.conv_id % 7 = 1 THEN 'parallel' WHEN bool_or(uo.conv_id IS NOT NULL) THEN 'serial' ELSE 'parallel' END AS strategy, count(*) AS n_calls FROM li l LEFT JOIN uo ON uo.conv_id = l.conv_id AND uo.turn = l.turn GROUP BY l.conv_id, l.turn)"""


def _files(s, d):
    """Five files; a predicted file lacks the conversations that have no predicted call, so its tail is cut."""
    by = lambda df: df.withColumn("file", F.col("conv_id") % 5)
    return sc.file_metrics(by(predicted(s, d)), by(truth(s, d)), "file", "conv_id")


_PAIRED = "np AS (SELECT conv_id, conv_id % 5 AS file, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) - 1 AS k FROM (SELECT DISTINCT conv_id FROM pre)), nt AS (SELECT conv_id, conv_id % 5 AS file, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) - 1 AS k FROM (SELECT DISTINCT conv_id FROM tru))"


def _top(s, d, k, every):
    v = table(s, d, "embeddings")
    return sim.top_k(v.where(F.col("vec_id") % every == 0), v, "vec_id", "embedding", k).select("query", "key", F.round("similarity", 6).alias("similarity"), "rank")


def _top_sql(k, every):
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT a.vec_id AS query, b.vec_id AS key, round(list_dot_product(a.v, b.v), 9) AS sim FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, key) AS rank FROM p) SELECT query, key, round(sim, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= {k}"""


def _greedy(s, d, t):
    return sim.greedy_dedup(table(s, d, "embeddings"), "vec_id", "embedding", [F.col("label")], F.col("label") < 2, t)


_GREEDY_SQL = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, row_number() OVER (ORDER BY label >= 2, label, vec_id) AS o FROM e),
ed AS (SELECT b.o AS late, list(a.o) AS early FROM n a JOIN n b ON a.o < b.o AND b.label >= 2 WHERE round(list_dot_product(a.v, b.v), 9) >= {t} GROUP BY 1),
g AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS kept UNION ALL SELECT g.o + 1, CASE WHEN ed.late IS NOT NULL AND list_has_any(ed.early, g.kept) THEN g.kept ELSE list_append(g.kept, g.o + 1) END FROM g LEFT JOIN ed ON ed.late = g.o + 1 WHERE g.o < (SELECT count(*) FROM n)),
k AS (SELECT unnest(kept) AS o FROM g WHERE o = (SELECT count(*) FROM n))"""


def _lists(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    n, rows = v.agg(F.max("vec_id") + 1, F.count("vec_id")).first()
    ids = F.broadcast(v.select("vec_id")) if rows <= SENT_KEYS else v.select("vec_id")
    need = table(s, d, "orders").select(F.col("o_orderkey").alias("conv_id"), F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int"))).alias("first"))
    need = need.select("conv_id", F.pmod(F.col("conv_id") * 31 + F.col("first") * 17, F.lit(n)).alias("vec_id"), "first")
    return sim.hybrid_lists(need.join(ids, "vec_id", "left_semi"), v, "vec_id", "embedding")


def _doc_jaccard(s, d):
    """Every hundredth tool against all."""
    t = tools(s, d).where("description IS NOT NULL").select("tool_id", F.lower("description").alias("text"))
    return sim.token_jaccard(t.where("tool_id % 100 = 0"), t, "tool_id", "text", 0.6)


def _like_generated(s, d):
    """Every hundredth tool as a new one against all: the same name or much the same words. Of equal times the least row
    counts, as in ``tools``; the columns after the description can't change its name or text."""
    rows = table(s, d, "toolset").withColumn("name", F.coalesce("name", "tool_name"))
    once = first_deliveries(rows, ["tool_id"], ["server", "source_file", "name", "description"])
    t = once.select("tool_id", "name", F.lower("description").alias("text"))
    return sim.token_jaccard(t.where("tool_id % 100 = 0"), t, "tool_id", "text", 0.6, "name")


def _part(s, d):
    return table(s, d, "part")


def _usage(s, d):
    """How often each part name stands, with a brand of it."""
    return _part(s, d).groupBy("p_name").agg(F.count(F.lit(1)).alias("c"), F.min("p_brand").alias("brand"))


_UNIT = "(('0x' || substr(md5({k} || '42'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"
_EPISODE = """WITH u AS (SELECT p_name, count(*) AS c, min(p_brand) AS brand FROM part GROUP BY 1), i AS (SELECT *, {lock} AS inside FROM u), a AS (SELECT p_name FROM i WHERE inside ORDER BY c DESC, p_name LIMIT 6),
b AS (SELECT p_name FROM i WHERE inside AND p_name NOT IN (SELECT p_name FROM a) ORDER BY c, p_name LIMIT 4),
g AS (SELECT p_name, CASE WHEN p_name IN (SELECT p_name FROM a) THEN 'most' WHEN p_name IN (SELECT p_name FROM b) THEN 'least' WHEN inside THEN 'random' ELSE 'outside' END AS source FROM i)
SELECT p_name, source FROM g ORDER BY list_position(['most', 'least', 'random', 'outside'], source), md5(p_name || '42'), p_name LIMIT 10"""
_PART_COUNTS = "c AS (SELECT p_type, count(*) AS c FROM part GROUP BY 1)"

QUERIES = {
    "score_summary": (lambda s, d: sc.score_summary(sc.quality_gate(sc.scored(scores(s, d)))), f"WITH {_GATE} SELECT count(*) AS total, count(*) FILTER (reason = 'ok') AS passed, count(*) FILTER (reason <> 'ok') AS failed, round(avg(average), 6) AS mean_average FROM gate"),
    "quality_gate": (lambda s, d: sc.quality_gate(sc.scored(scores(s, d))).select("doc_id", "average", "min_score", "reason", "passed"), f"WITH {_GATE} SELECT doc_id, average, min_score, reason, reason = 'ok' AS passed FROM gate"),
    "fail_reasons": (lambda s, d: sc.fail_reasons(sc.quality_gate(sc.scored(scores(s, d)))), f"WITH {_GATE} SELECT reason, count(*) AS n FROM gate WHERE reason <> 'ok' GROUP BY 1"),
    "score_join": (lambda s, d: table(s, d, "documents").join(sc.quality_gate(sc.scored(scores(s, d))).where("passed").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars"), f"WITH {_GATE} SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM gate WHERE reason = 'ok')"),
    "score_delta": (lambda s, d: sc.score_delta(scores(s, d, True), scores(s, d), "doc_id"), f"WITH {_score_sql()}, {_score_sql('aug', True)} SELECT a.doc_id, " + ", ".join(f"a.{m} - o.{m} AS {m}_delta" for m in sc.METRICS) + " FROM aug a LEFT JOIN sco o USING (doc_id)"),
    "variant_pass_rate": (lambda s, d: sc.passed_variants(sc.quality_gate(sc.scored(scores(s, d, True))).withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "noisy").otherwise("ambiguous")), "doc_id", "kind")[0],
        "WITH " + _GATE.replace(_score_sql(), _score_sql("sco", True)) + " SELECT CASE WHEN doc_id % 2 = 0 THEN 'noisy' ELSE 'ambiguous' END AS kind, count(*) FILTER (reason = 'ok') AS n_passed, count(*) FILTER (reason <> 'ok') AS n_failed FROM gate GROUP BY 1"),
    "episode_score": (lambda s, d: sc.episode_scores(scores(s, d).withColumn("episode", F.floor(F.col("doc_id") / 4)).withColumn("anchor", F.col("episode") % 10 + 1), "episode"),
        f"""WITH {_score_sql()}, e AS (SELECT *, doc_id // 4 AS episode, doc_id // 4 % 10 + 1 AS anchor FROM sco) SELECT episode, round(0.4::DOUBLE * (coalesce(sum(toolfit), 0) + coalesce(sum(clarity), 0) + coalesce(sum(naturalness), 0)) / nullif(count(toolfit) + count(clarity) + count(naturalness), 0)
+ 0.4::DOUBLE * (coalesce(sum(success), 0) + coalesce(sum(grounding), 0) + coalesce(sum(efficiency), 0)) / nullif(count(success) + count(grounding) + count(efficiency), 0) + 0.2::DOUBLE * avg(anchor), 6) AS total,
least(min(toolfit), min(clarity), min(naturalness), min(success), min(grounding), min(efficiency), min(anchor))::DOUBLE AS min_score FROM e GROUP BY 1"""),
    "call_matching": (lambda s, d: sc.match_calls(predicted(s, d), truth(s, d)), f"WITH {_CALLS} SELECT conv_id, turn, p_pos::INT AS p_pos, t_pos::INT AS t_pos, exact FROM ma"),
    "turn_call_metrics": (_metrics, f"WITH {_CALLS} SELECT * FROM me"),
    "flexible_call_metrics": (_flexible, f"""WITH {_CALLS}, f AS (SELECT m.conv_id, m.turn, m.p_pos, exact OR split_part(p.a, ':', 2) = split_part(t.a, ':', 2) AS ok FROM ma m LEFT JOIN pre p ON p.conv_id = m.conv_id AND p.pos = m.p_pos LEFT JOIN tru t ON t.conv_id = m.conv_id AND t.pos = m.t_pos)
SELECT conv_id, turn, round(coalesce(count(*) FILTER (ok AND p_pos IS NOT NULL) / nullif(count(p_pos), 0), 0), 6) AS flexible_accuracy FROM f GROUP BY ALL"""),
    "dimension_metrics": (lambda s, d: sc.dimension_metrics(_metrics(s, d)), f"WITH {_CALLS}, {_dims('')} SELECT * FROM dim"),
    "weighted_dimension_metrics": (lambda s, d: sc.weighted_dimensions(sc.dimension_metrics(_metrics(s, d).withColumn("file", F.col("conv_id") % 3), ["file"])),
        f"WITH {_CALLS}, {_dims('file')} SELECT dimension, sum(n)::BIGINT AS n, round(coalesce(sum(strict_precision * n) / sum(n), 0), 5) AS strict_precision, round(coalesce(sum(flexible_precision * n) / sum(n), 0), 5) AS flexible_precision, round(coalesce(sum(strict_accuracy * n) / sum(n), 0), 5) AS strict_accuracy FROM dim GROUP BY 1"),
    "subset_metrics": (lambda s, d: sc.subset_metrics(_metrics(s, d), sc.strategies(_linked(s, d))).where("dimension = 'multi-hop'"),
        f"""WITH {_LINKED}, x AS (SELECT me.*, strategy, row_number() OVER (PARTITION BY strategy ORDER BY md5(conv_id || '/' || turn || '/42'), conv_id, turn) AS r FROM me JOIN st USING (conv_id, turn) WHERE n_calls > 1),
z AS (SELECT count(*) FILTER (strategy = 'serial') AS a, count(*) FILTER (strategy = 'parallel') AS b FROM x), n AS (SELECT unnest(generate_series(1, 10)) AS n),
y AS (SELECT 'all' AS subset, x.* FROM x UNION ALL SELECT strategy, x.* FROM x UNION ALL SELECT '1:' || n, x.* FROM x, z, n WHERE r <= CASE WHEN strategy = 'serial' THEN least(a, b // n) ELSE n * least(a, b // n) END)
SELECT subset, 'multi-hop' AS dimension, count(*) FILTER (n_true >= 2) AS n, round(coalesce(avg(strict_precision) FILTER (n_true >= 2), 0), 6) AS strict_precision, round(coalesce(avg(flexible_precision) FILTER (n_true >= 2), 0), 6) AS flexible_precision, round(coalesce(avg(strict_accuracy) FILTER (n_true >= 2), 0), 6) AS strict_accuracy FROM y GROUP BY 1"""),
    "subset_ratios": (lambda s, d: sc.subset_metrics(_metrics(s, d), sc.strategies(_linked(s, d))), None),
    "strategy_detect": (lambda s, d: sc.strategies(_linked(s, d)), f"WITH {_LINKED} SELECT conv_id, turn, strategy, n_calls FROM st"),
    "strategy_declared": (lambda s, d: sc.strategies(_linked(s, d), "label"), f"WITH {_DECLARED} SELECT conv_id, turn, strategy, n_calls FROM sd"),
    "file_pair_counts": (lambda s, d: _files(s, d)[1], f"WITH {_CALLS}, {_PAIRED}, f AS (SELECT coalesce(np.file, nt.file) AS file, np.conv_id AS p, nt.conv_id AS t FROM np FULL JOIN nt ON np.file = nt.file AND np.k = nt.k) SELECT file, count(p) AS n_pred, count(t) AS n_true, count(p) FILTER (t IS NOT NULL) AS n_evaluated FROM f GROUP BY 1"),
    "file_pair_metrics": (lambda s, d: _files(s, d)[0].select("file", "dimension", "n"),
        f"WITH {_CALLS}, {_PAIRED}, q AS (SELECT np.file, np.k, np.conv_id AS p, nt.conv_id AS t FROM np JOIN nt ON np.file = nt.file AND np.k = nt.k), u AS (SELECT file, k, turn, count(*) FILTER (x) AS n_true FROM (SELECT file, k, turn, false AS x FROM q JOIN pre ON pre.conv_id = p UNION ALL SELECT file, k, turn, true FROM q JOIN tru ON tru.conv_id = t) GROUP BY ALL), m AS (SELECT file, CASE WHEN n_true >= 2 THEN 'multi-hop' ELSE 'single-hop' END AS dimension, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT file, dimension, count(*) FROM (SELECT file, k, CASE WHEN count(*) >= 2 THEN 'multi-turn' ELSE 'single-turn' END AS dimension FROM u GROUP BY file, k) GROUP BY ALL), w AS (SELECT DISTINCT q.file, d.dimension FROM q CROSS JOIN (SELECT unnest(['single-hop', 'multi-hop', 'single-turn', 'multi-turn']) AS dimension) d) SELECT w.file, w.dimension, coalesce(n, 0) AS n FROM w LEFT JOIN m USING (file, dimension)"),
    "ratio_subset": (lambda s, d: sa.ratio_subset(sc.strategies(_linked(s, d)).where("n_calls > 1").withColumn("key", F.col("conv_id") * 10 + F.col("turn")), "strategy", "serial", "parallel", "key", 2).select("key", "strategy"),
        f"""WITH {_LINKED}, k AS (SELECT conv_id * 10 + turn AS key, strategy FROM st WHERE n_calls > 1), z AS (SELECT least(count(*) FILTER (strategy = 'serial'), count(*) FILTER (strategy = 'parallel') // 2) AS s FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY md5(key || '42'), key) AS n FROM k) SELECT key, strategy FROM r, z WHERE n <= CASE WHEN strategy = 'serial' THEN s ELSE 2 * s END"""),
    "resume_antijoin": (lambda s, d: truth(s, d).join(predicted(s, d).select("conv_id", "pos"), ["conv_id", "pos"], "left_anti").select("conv_id", "pos"), f"WITH {_CALLS} SELECT conv_id, pos::INT AS pos FROM tru WHERE (conv_id, pos) NOT IN (SELECT conv_id, pos FROM pre)"),
    "positional_pairing": (lambda s, d: predicted(s, d).withColumnRenamed("name", "p").join(truth(s, d).withColumnRenamed("name", "t"), ["conv_id", "pos"]).select("conv_id", "pos", (F.col("p") == F.col("t")).alias("same")), f"WITH {_CALLS} SELECT p.conv_id, p.pos::INT AS pos, p.name = t.name AS same FROM pre p JOIN tru t ON p.conv_id = t.conv_id AND p.pos = t.pos"),
    "file_status": (lambda s, d: sc.file_status(truth(s, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_true")).join(predicted(s, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pred")), "conv_id", "left")),
        f"WITH {_CALLS}, a AS (SELECT conv_id, count(*) AS n_true FROM tru GROUP BY 1), b AS (SELECT conv_id, count(*) AS n_pred FROM pre GROUP BY 1) SELECT CASE WHEN n_pred IS NULL THEN 'missing' WHEN n_pred < n_true THEN 'short' ELSE 'complete' END AS status, count(*) AS n FROM a LEFT JOIN b USING (conv_id) GROUP BY 1"),
    "call_range": (lambda s, d: sc.call_range(calls(s, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "n").groupBy("state").agg(F.count(F.lit(1)).alias("docs")), f"WITH {_CALLS}, a AS (SELECT count(*) AS n FROM cl GROUP BY conv_id) SELECT CASE WHEN n BETWEEN 2 AND 5 THEN 'in_range' ELSE 'out_of_range' END AS state, count(*) AS docs FROM a GROUP BY 1"),
    "last_step_per_query": (lambda s, d: calls(s, d).groupBy("conv_id").agg(F.max_by("name", "pos").alias("name"), F.max("pos").alias("pos")), f"WITH {_CALLS} SELECT conv_id, arg_max(name, pos) AS name, max(pos)::INT AS pos FROM cl GROUP BY 1"),
    "cosine_topk": (lambda s, d: _top(s, d, 10, 10), _top_sql(10, 10)),
    "cosine_top1": (lambda s, d: _top(s, d, 1, 1), _top_sql(1, 1)),
    "cosine_greedy_dedup": (lambda s, d: _greedy(s, d, 0.4).select("vec_id", "kept"), _GREEDY_SQL.format(t=0.4) + " SELECT n.vec_id, k.o IS NOT NULL AS kept FROM n LEFT JOIN k ON k.o = n.o"),
    "cosine_removed": (lambda s, d: _greedy(s, d, 0.4).where("NOT kept").select("vec_id", "representative", F.round("similarity", 6).alias("similarity")),
        _GREEDY_SQL.format(t=0.4) + """, r AS (SELECT b.vec_id, a.vec_id AS representative, round(list_dot_product(a.v, b.v), 9) AS s, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, a.o) AS n FROM n b JOIN n a ON a.o < b.o JOIN k ON k.o = a.o WHERE b.o NOT IN (SELECT o FROM k))
SELECT vec_id, representative, round(s, 6) AS similarity FROM r WHERE n = 1"""),
    "hybrid_toollist": (_lists, None),
    "jaccard_near_dup": (_doc_jaccard, f"""WITH {TOOL_SQL}, w AS (SELECT tool_id, list_distinct(list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda x: x <> '')) AS w FROM tool WHERE description IS NOT NULL), p AS (SELECT a.tool_id AS a, b.tool_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS m, len(b.w) AS n FROM w a JOIN w b ON a.tool_id <> b.tool_id WHERE a.tool_id % 100 = 0 AND len(a.w) > 0 AND len(b.w) > 0)
SELECT a, b, round(i / (m + n - i), 6) AS similarity FROM p WHERE i / (m + n - i) > 0.6"""),
    "near_dup_or_named": (_like_generated, f"""WITH {TOOL_SQL}, w AS (SELECT tool_id, name, list_distinct(list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda x: x <> '')) AS w FROM tool), p AS (SELECT a.tool_id AS a, b.tool_id AS b, a.name = b.name AS same, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS m, len(b.w) AS n FROM w a JOIN w b ON a.tool_id <> b.tool_id WHERE a.tool_id % 100 = 0)
SELECT a, b, coalesce(round(i / nullif(m + n - i, 0), 6), 0)::DOUBLE AS similarity FROM p WHERE coalesce(i / nullif(m + n - i, 0), 0) > 0.6 OR coalesce(same, false)"""),
    "stratified_sample": (lambda s, d: sa.proportional(_part(s, d), "p_type", "p_partkey", 100).select("p_partkey", "p_type"), f"""WITH {_PART_COUNTS}, q AS (SELECT p_type, least(floor(100 * c / sum(c) OVER ()), c) AS q, p_type = max(p_type) OVER () AS l FROM c), z AS (SELECT p_type, CASE WHEN l THEN 100 - (SELECT sum(q) FROM q WHERE NOT l) ELSE q END AS q FROM q),
r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || '42'), p_partkey) AS n FROM part) SELECT p_partkey, p_type FROM r JOIN z USING (p_type) WHERE n <= q"""),
    "uniform_sample": (lambda s, d: sa.uniform(_part(s, d), "p_partkey", 50).select("p_partkey"), "SELECT p_partkey FROM part ORDER BY md5(p_partkey || '42'), p_partkey LIMIT 50"),
    "weighted_sample": (lambda s, d: sa.weighted(_part(s, d), "p_partkey", 1 / (F.col("p_size") + 1), 50).select("p_partkey"), f"SELECT p_partkey FROM part ORDER BY -ln({_UNIT.format(k='p_partkey')}) * (p_size + 1), p_partkey LIMIT 50"),
    "lock_value": (lambda s, d: sa.lock_value(_part(s, d), "p_brand", 10), "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY md5(p_brand || '42'), p_brand LIMIT 20) SELECT p_brand FROM c WHERE n >= 10 ORDER BY md5(p_brand || '42'), p_brand LIMIT 1"),
    "least_used": (lambda s, d: sa.least_used(_part(s, d).groupBy("p_type").agg(F.count(F.lit(1)).alias("c")), "p_type", "c"), f"WITH {_PART_COUNTS} SELECT p_type FROM c ORDER BY c, md5(p_type || '42'), p_type LIMIT 1"),
    "under_represented": (lambda s, d: sa.under_represented(_part(s, d).groupBy("p_type").agg(F.count(F.lit(1)).alias("c")), "p_type", "c"), f"WITH {_PART_COUNTS} SELECT CASE WHEN min(c) < max(c) THEN arg_min(p_type, (c, p_type)) END AS p_type FROM c"),
    "categorical_draws": (lambda s, d: sa.categorical(_part(s, d).groupBy("p_type").agg((1.0 / F.count(F.lit(1))).alias("w")), "p_type", "w", s.range(500).withColumnRenamed("id", "draw")),
        f"WITH {_PART_COUNTS}, w AS (SELECT p_type, sum(1.0::DOUBLE / c) OVER (ORDER BY p_type ROWS UNBOUNDED PRECEDING) / sum(1.0::DOUBLE / c) OVER () AS u FROM c), d AS (SELECT i AS draw, {_UNIT.format(k='i')} AS u FROM range(500) t(i)) SELECT draw, arg_min(p_type, w.u) AS p_type FROM d JOIN w ON w.u > d.u GROUP BY 1"),
    "episode_tools": (lambda s, d: sa.episode_tools(_usage(s, d), "p_name", "c"), _EPISODE.format(lock="true")),
    "episode_tools_locked": (lambda s, d: sa.episode_tools(_usage(s, d), "p_name", "c", "brand", "Brand#13"), _EPISODE.format(lock="brand = 'Brand#13' OR NOT EXISTS (SELECT 1 FROM u WHERE brand = 'Brand#13')")),
    "episode_tools_domain": (lambda s, d: sa.episode_tools(_usage(s, d).where("c > 3"), "p_name", "c", "brand", "Brand#12"), _EPISODE.replace("GROUP BY 1)", "GROUP BY 1 HAVING count(*) > 3)", 1).format(lock="brand = 'Brand#12' OR NOT EXISTS (SELECT 1 FROM u WHERE brand = 'Brand#12')")),
    "ids_with_repeats": (lambda s, d: sa.with_repeats(_part(s, d), "p_partkey", 3000), "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || '42'), p_partkey) - 1 AS r, count(*) OVER () AS n FROM part) SELECT k * n + r AS ordinal, p_partkey FROM r, range(3000) t(k) WHERE k * n + r < 3000"),
    "sequential_ids": (lambda s, d: sa.numbered(_part(s, d).select("p_type", "p_partkey"), ["p_type", "p_partkey"]), "SELECT p_type, p_partkey, row_number() OVER (ORDER BY p_type, p_partkey) AS id FROM part"),
    "report_top": (lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5"),
}
