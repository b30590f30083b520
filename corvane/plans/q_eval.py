"""Queries over evaluation reports. Runs are derived from vectors, orders, lineitem and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import evaluation as M
from ..operators import lexical as E
from ..operators import vectors as V
from ..sources.shared import written
from .views import lines, query, query_vectors, table, vectors

# Two configurations: exact neighbours, and the same list from its sixth place on.
RANKED = "SELECT config, query_id, query_label, rank, vec_id AS id, doc_id FROM (SELECT 'full' AS config, query_id, query_label, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank, vec_id, doc_id FROM cosines WHERE vec_id <> query_id) WHERE rank <= 15 UNION ALL SELECT 'late', query_id, query_label, rank - 5, vec_id, doc_id FROM (SELECT query_id, query_label, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank, vec_id, doc_id FROM cosines WHERE vec_id <> query_id) WHERE rank BETWEEN 6 AND 15"
# The expected vector of a query is the next of its label; required are the next three.
GOLD = "SELECT query_id, id AS expected, k FROM (SELECT q.query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.query_id ORDER BY v.vec_id) AS k FROM query_vectors q JOIN vectors v ON v.doc_id = q.query_label AND v.vec_id <> q.query_id) WHERE k <= 3"
QUESTIONS = f"""WITH r AS MATERIALIZED ({RANKED}), g AS MATERIALIZED ({GOLD}),
q AS (SELECT c.config, g.query_id, g.expected, r.rank FROM (SELECT DISTINCT config FROM r) c CROSS JOIN (SELECT * FROM g WHERE k = 1) g LEFT JOIN r ON r.config = c.config AND r.query_id = g.query_id AND r.id = g.expected),
n AS (SELECT c.config, g.query_id, count(r.id) FILTER (r.rank <= 5) / count(*) AS n5, count(r.id) FILTER (r.rank <= 10) / count(*) AS n10, count(r.id) FILTER (r.rank <= 12) / count(*) AS n12 FROM (SELECT DISTINCT config FROM r) c CROSS JOIN g LEFT JOIN r ON r.config = c.config AND r.query_id = g.query_id AND r.id = g.expected GROUP BY 1, 2)"""


def _ranked(spark, d):
    q = query_vectors(spark, d)
    place = vectors(spark, d).select("vec_id", "doc_id")
    full = V.knn_exact(q, vectors(spark, d), 15, others=True).join(place, "vec_id").join(q.select("query_id", "query_label"), "query_id")
    full = full.select(F.lit("full").alias("config"), "query_id", "query_label", "rank", F.col("vec_id").alias("id"), "doc_id")
    late = full.filter("rank > 5").withColumn("config", F.lit("late")).withColumn("rank", F.col("rank") - 5)
    return full.unionByName(late)


def _questions(spark, d):
    # the first three of a label besides the query are among its first four
    first = V.top_per_group(vectors(spark, d).select("vec_id", F.col("doc_id").alias("query_label")), ["query_label"], ["vec_id"], 4, "k").drop("k")
    gold = query_vectors(spark, d).join(first, "query_label").filter("vec_id <> query_id")
    gold = V.top_per_group(gold, ["query_id"], ["vec_id"], 3, "k").groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("required"))
    ranked = _ranked(spark, d)
    configs = spark.createDataFrame([("full",), ("late",)], "config string")
    q = gold.join(configs).withColumn("expected", F.get("required", F.lit(0)))
    lists = ranked.groupBy("config", "query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("retrieved"))
    return M.expected_ranks(q, ranked).join(lists, ["config", "query_id"], "left")


def _rounded(df, *keep):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


@query("recall_at_k", QUESTIONS + " SELECT config, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5 FROM q GROUP BY 1", "cosines", "vectors", "query_vectors")
def recall_at_k(spark, d):
    return _rounded(_questions(spark, d).groupBy("config").agg(M.recall_at_k("rank", 5).alias("recall_at_5")))


@query("mrr", QUESTIONS + " SELECT config, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM q GROUP BY 1", "cosines", "vectors", "query_vectors")
def mrr(spark, d):
    return _rounded(_questions(spark, d).groupBy("config").agg(M.mrr("rank").alias("mrr")))


@query("ndcg_at_k", QUESTIONS + " SELECT config, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg FROM q GROUP BY 1", "cosines", "vectors", "query_vectors")
def ndcg_at_k(spark, d):
    return _rounded(_questions(spark, d).groupBy("config").agg(M.ndcg_at_k("rank", 10).alias("ndcg")))


@query("recall_required_at_k", QUESTIONS + " SELECT config, round(avg(n10), 6) AS recall_required FROM n GROUP BY 1", "cosines", "vectors", "query_vectors")
def recall_required_at_k(spark, d):
    return _rounded(_questions(spark, d).groupBy("config").agg(F.avg(M.required_share("retrieved", "required", "expected", 10)).alias("recall_required")))


@query("eval_report", QUESTIONS + " SELECT q.config, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_at_10, round(avg(n5), 6) AS recall_required_at_5, round(avg(n10), 6) AS recall_required_at_10, round(avg(n12), 6) AS recall_required_at_12 FROM q JOIN n ON n.config = q.config AND n.query_id = q.query_id GROUP BY 1", "cosines", "vectors", "query_vectors")
def eval_report(spark, d):
    return _rounded(M.eval_report(_questions(spark, d)))


# Latencies: values of events by type.
LATENCY = "SELECT {by}, n, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN v END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN v END) AS p95, max(v) AS max, round(avg(v), 6) AS mean FROM (SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {src} WHERE v IS NOT NULL) GROUP BY {by}, n"


@query("latency_summary", LATENCY.format(by="event_type", src="(SELECT event_type, value AS v FROM events)"))
def latency_summary(spark, d):
    return M.latency_summary(table(spark, d, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


PHASE_VALUES = [f"floor(l_extendedprice) * {i + 1} % {m}" for i, m in enumerate((5, 50, 9, 4, 200, 300))]
PHASE_SQL = "SELECT config, unnest(['route', 'embed', 'retrieve', 'fuse', 'rerank', 'prefill', 'ttft', 'full_response']) AS phase, unnest([a, b, c, e, f, g, a + b + c + e + f + g, h]) AS v FROM (SELECT l_returnflag AS config, " + ", ".join(f"({p.replace('floor(l_extendedprice)', 'floor(l_extendedprice)::BIGINT')})::DOUBLE AS {n}" for p, n in zip(PHASE_VALUES, "abcefg", strict=True)) + ", CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 10 END AS h FROM lineitem)"


def _phases(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_returnflag").alias("config"), *(F.expr(f"cast({p.replace('floor(l_extendedprice)', 'cast(floor(l_extendedprice) as bigint)')} as double)").alias(n) for p, n in zip(PHASE_VALUES, M.PHASES, strict=True)), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 10).alias("full_response"))


@query("phase_summary", LATENCY.format(by="config, phase", src=f"({PHASE_SQL})"))
def phase_summary(spark, d):
    return M.phase_summary(_phases(spark, d), ["config"]).withColumn("mean", F.round("mean", 6))


@query("resource_summary", "SELECT l_returnflag AS config, round(max(l_extendedprice)) AS rss_max, round(avg(l_extendedprice)) AS rss_mean, round(avg(l_discount), 3) AS cpu_mean, min(CASE WHEN l_linenumber > 2 THEN l_quantity END) AS vram_min FROM lineitem GROUP BY 1")
def resource_summary(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return M.resource_summary(l.select(F.col("l_returnflag").alias("config"), F.col("l_extendedprice").alias("rss_mb"), F.col("l_discount").alias("cpu"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("free_vram_mb")), ["config"])


# Answers: one row for each line; a part's brand is the configuration.
JUDGED = "SELECT p_brand AS config, l_orderkey * 10 + l_linenumber AS query_id, CASE l_linenumber % 4 WHEN 0 THEN 'focused' WHEN 1 THEN 'broad' WHEN 2 THEN 'summary' ELSE 'list' END AS intent, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 13 + 1 END AS rank, CASE WHEN l_linenumber % 6 = 5 THEN NULL ELSE l_partkey % 4 <> 0 END AS parsed, l_discount * 10 AS mean FROM lineitem JOIN part ON p_partkey = l_partkey"


def _judged(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))  # noqa: E741
    intent = F.element_at(F.array(*map(F.lit, ("focused", "broad", "summary", "list"))), F.col("l_linenumber") % 4 + 1)
    return l.select(F.col("p_brand").alias("config"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), intent.alias("intent"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 13 + 1).alias("rank"), F.when(F.col("l_linenumber") % 6 != 5, F.col("l_partkey") % 4 != 0).alias("parsed"), (F.col("l_discount") * 10).alias("mean"))


@query("judge_average", f"WITH j AS ({JUDGED}) SELECT config, round(avg(CASE WHEN parsed THEN mean END), 6) AS judge, round(avg(CASE WHEN parsed THEN 1.0 ELSE 0.0 END), 6) AS parsed_share, count(*) FILTER (parsed IS NULL) AS pending FROM j GROUP BY 1")
def judge_average(spark, d):
    return _rounded(M.judge_average(_judged(spark, d)))


@query("pending_rescore", f"WITH j AS ({JUDGED}) SELECT config, query_id FROM j WHERE parsed IS NULL")
def pending_rescore(spark, d):
    j = _judged(spark, d)
    return M.pending_rescore(j.select("config", "query_id"), j)


@query("parse_judge", "SELECT item_id, item_id % 3 <> 0 AS parsed, CASE WHEN item_id % 3 <> 0 THEN round((least(10, item_id % 14) / 10 + 0.5 + 0.25) / 3, 6) ELSE 0 END AS mean FROM benchmark")
def parse_judge(spark, d):
    n = F.col("item_id")
    raw = F.concat(F.lit("Faithfulness: "), (n % 14).cast("string"), F.lit("\nrelevance = 5"), F.when(n % 3 != 0, "\nCompleteness: 2.5").otherwise("\nno more"))
    return table(spark, d, "benchmark").select("item_id", M.parse_judge(raw).alias("j")).select("item_id", "j.parsed", F.round("j.mean", 6).alias("mean"))


RUNS = f"WITH j AS ({JUDGED}), a AS (SELECT config, avg(CASE WHEN parsed THEN mean END) AS judge, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall_at_5, count(*)::DOUBLE * 3 AS ttft_p50 FROM j GROUP BY 1)"


def _runs(spark, d):
    return _judged(spark, d).groupBy("config").agg(F.avg(F.when(F.col("parsed"), F.col("mean"))).alias("judge"), M.recall_at_k("rank", 5).alias("recall_at_5"), (F.count("*").cast("double") * 3).alias("ttft_p50"))


@query("composite_rank", RUNS + " SELECT config, round(c, 6) AS composite, row_number() OVER (ORDER BY round(c, 9) DESC, config) AS place FROM (SELECT config, 2 * coalesce(judge, 0) + recall_at_5 - 0.5::DOUBLE * ttft_p50 / 1000 AS c FROM a)")
def composite_rank(spark, d):
    return M.composite_rank(_runs(spark, d)).select("config", F.round("composite", 6).alias("composite"), "place")


@query("intent_leaderboard", f"WITH j AS ({JUDGED}) SELECT intent, config, n, round(hit_rate, 6) AS hit_rate, round(judge, 6) AS judge, row_number() OVER (PARTITION BY intent ORDER BY round(judge, 9) DESC NULLS LAST, config) AS place FROM (SELECT intent, config, count(*) AS n, avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(CASE WHEN parsed THEN mean END) AS judge FROM j GROUP BY 1, 2)")
def intent_leaderboard(spark, d):
    return _rounded(M.intent_leaderboard(_judged(spark, d).withColumn("judge", F.when(F.col("parsed"), F.col("mean")))))


@query("rank_bucket_table", f"WITH j AS ({JUDGED}), b AS (SELECT CASE WHEN rank IS NULL THEN 'miss' WHEN rank = 1 THEN '1' WHEN rank <= 5 THEN '2-5' WHEN rank <= 10 THEN '6-10' ELSE '>10' END AS bucket, CASE WHEN parsed THEN mean END AS v FROM j), m AS (SELECT bucket, max(CASE WHEN i = n // 2 THEN v END) AS median FROM (SELECT bucket, v, row_number() OVER (PARTITION BY bucket ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM b WHERE v IS NOT NULL) GROUP BY 1) SELECT f.bucket, count(b.bucket) AS n, count(b.v) AS scored, round(avg(b.v), 6) AS mean, round(any_value(m.median), 6) AS median FROM (SELECT unnest(['miss', '1', '2-5', '6-10', '>10']) AS bucket) f LEFT JOIN b USING (bucket) LEFT JOIN m USING (bucket) GROUP BY 1")
def rank_bucket_table(spark, d):
    return _rounded(M.rank_bucket_table(_judged(spark, d).withColumn("judge", F.when(F.col("parsed"), F.col("mean")))))


@query("judge_coverage", f"WITH j AS ({JUDGED}) SELECT * FROM (SELECT config, count(*) AS n, count(*) FILTER (parsed IS NULL) AS missing, count(*) FILTER (NOT parsed) AS unparsed FROM j GROUP BY 1) WHERE missing > 0 OR unparsed > 0.2 * n")
def judge_coverage(spark, d):
    return M.judge_coverage(_judged(spark, d))


@query("distractor_scaling", "WITH g AS (SELECT query_id, min(vec_id) AS gold FROM (SELECT q.query_id, v.vec_id FROM query_vectors q JOIN vectors v ON v.doc_id = q.query_label AND v.vec_id <> q.query_id) GROUP BY 1), l AS (SELECT unnest([0, 50, 200, 500]) AS stage), c AS (SELECT l.stage, s.query_id, s.vec_id, row_number() OVER (PARTITION BY l.stage, s.query_id ORDER BY round(s.cosine, 9) DESC, s.vec_id) AS rank FROM l CROSS JOIN cosines s WHERE s.vec_id <> s.query_id AND (s.vec_id < l.stage OR s.vec_id IN (SELECT gold FROM g))) SELECT stage, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5 FROM g JOIN c ON c.query_id = g.query_id AND c.vec_id = g.gold GROUP BY 1", "cosines", "vectors", "query_vectors")
def distractor_scaling(spark, d):
    """Each stage compares only the vectors it adds and merges their best five with the best five so far."""
    k, v, q = 5, vectors(spark, d), query_vectors(spark, d)
    gold = written(q.join(v.select("vec_id", F.col("doc_id").alias("query_label")), "query_label").filter("vec_id <> query_id").groupBy("query_id").agg(F.min("vec_id").alias("gold")))
    golds = gold.select(F.col("gold").alias("vec_id")).distinct()
    best, stages, below = None, [], 0
    for stage in (0, 50, 200, 500):
        added = v.join(golds, "vec_id", "left_semi") if best is None else v.filter(F.col("vec_id").between(below, stage - 1)).join(golds, "vec_id", "left_anti")
        found = V.knn_exact(q, added, k + 1).filter("vec_id <> query_id").select("query_id", "vec_id", "cosine")
        found = found if best is None else best.unionByName(found)
        top = written(E.top_per_group(found, ["query_id"], [F.desc(F.round("cosine", 9)), "vec_id"], k))
        best, below = top.select("query_id", "vec_id", "cosine"), max(below, stage)
        hits = gold.join(top.select("query_id", F.col("vec_id").alias("gold"), "rank"), ["query_id", "gold"], "left")
        stages.append(hits.agg(F.lit(stage).alias("stage"), F.count("*").alias("n"), M.recall_at_k("rank", k).alias("recall_at_5")))
    return _rounded(reduce(lambda a, b: a.unionByName(b), stages))


def _segments(spark, d):
    b = table(spark, d, "benchmark")
    hyp = F.array_join(F.filter(F.split("text", " "), lambda _, i: i % 4 != 3), " ")
    return b.select(F.concat(F.lit("en-"), (F.col("item_id") % 3).cast("string")).alias("direction"), F.col("item_id").alias("segment"), hyp.alias("hyp"), F.col("text").alias("ref"), (F.col("item_id") * 7 % 100).cast("double").alias("ms"))


@query("chrf")
def chrf(spark, d):
    return _rounded(M.chrf(_segments(spark, d), ["direction"]))


@query("direction_summary")
def direction_summary(spark, d):
    return M.direction_summary(_segments(spark, d))


# Scores by language and model: mean prices by segment and priority.
SCORES = "SELECT c_mktsegment AS lang, o_orderpriority AS model, round(avg(o_totalprice) / 5000, 4) AS score FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"
MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _scores(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("lang"), F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice") / 5000, 4).alias("score"))


@query("score_matrix", f"WITH s AS ({SCORES}) SELECT lang, " + ", ".join(f"max(score) FILTER (model = '{m}') AS \"{m}\"" for m in MODELS) + ", arg_max(model, score) AS best FROM s GROUP BY lang")
def score_matrix(spark, d):
    return M.score_matrix(_scores(spark, d), MODELS)


@query("baseline_verdicts", f"WITH s AS ({SCORES}) SELECT s.lang, s.model, s.score, b.score AS base, CASE WHEN s.score < 28 THEN 'broken' WHEN b.score - s.score > 0.5 THEN 'fallback' ELSE 'ok' END AS verdict FROM s LEFT JOIN s b ON b.lang = s.lang AND b.model = '5-LOW' WHERE s.model <> '5-LOW'")
def baseline_verdicts(spark, d):
    return M.baseline_verdicts(_scores(spark, d), "5-LOW", 0.5, 28.0)


# Datasets: parts are chunks, lines ask about them.
def _chunks(spark, d):
    p = table(spark, d, "part").filter("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("chunk_id"))
    return p.unionByName(p.filter("chunk_id % 50 = 1"))


def _asked(spark, d):
    l = lines(spark, d)  # noqa: E741
    text = F.when(F.col("l_linenumber") == 6, "  ").otherwise("why?")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question_id"), F.col("l_partkey").alias("chunk_id"), text.alias("question"), F.when(F.col("l_linenumber") == 5, F.array("l_partkey")).otherwise(F.array(F.col("l_partkey"), F.col("l_partkey") + 1)).alias("required"), F.when(F.col("l_linenumber") > 4, "broad").otherwise("focused").alias("intent"), F.col("l_returnflag").alias("theme"))


DATA = "WITH p AS (SELECT p_partkey AS chunk_id FROM part WHERE p_partkey % 6 <> 0), q AS (SELECT l_orderkey * 10 + l_linenumber AS question_id, l_partkey AS chunk_id, CASE WHEN l_linenumber = 5 THEN [l_partkey] ELSE [l_partkey, l_partkey + 1] END AS required, l_linenumber, CASE WHEN l_linenumber > 4 THEN 'broad' ELSE 'focused' END AS intent, l_returnflag AS theme FROM lines)"


@query("assemble_dataset", DATA + " SELECT count(*) FILTER (chunk_id IN (SELECT chunk_id FROM p)) AS kept, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM p)) AS unknown FROM q", "lines")
def assemble_dataset(spark, d):
    return M.assemble_dataset(_asked(spark, d), _chunks(spark, d))[1]


@query("validate_dataset", DATA + " SELECT 'error' AS level, 'duplicate-chunk' AS reason, chunk_id AS id FROM p WHERE chunk_id % 50 = 1 UNION ALL SELECT 'error', 'empty-question', question_id FROM q WHERE l_linenumber = 6 UNION ALL SELECT 'error', 'unknown-required', question_id FROM (SELECT DISTINCT question_id FROM (SELECT question_id, unnest(required) AS c FROM q) WHERE c NOT IN (SELECT chunk_id FROM p)) UNION ALL SELECT 'warning', 'single-required', question_id FROM q WHERE l_linenumber = 5", "lines")
def validate_dataset(spark, d):
    return M.validate_dataset(_chunks(spark, d), _asked(spark, d))


@query("inspect_dataset", DATA + " SELECT intent, theme, count(*) AS n, sum(len(list_filter(required, lambda c: c NOT IN (SELECT chunk_id FROM p))))::BIGINT AS dangling, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM p)) AS missing_chunk FROM q GROUP BY 1, 2".replace("sum(len(list_filter(required, lambda c: c NOT IN (SELECT chunk_id FROM p))))::BIGINT", "sum((SELECT count(*) FROM (SELECT unnest(required) AS c) WHERE c NOT IN (SELECT chunk_id FROM p)))::BIGINT"), "lines")
def inspect_dataset(spark, d):
    out = M.inspect_dataset(_chunks(spark, d), _asked(spark, d))
    return out.withColumn("missing_chunk", F.col("missing_chunk").cast("long"))


@query("question_histogram", DATA + ", n AS (SELECT p.chunk_id, count(q.chunk_id) AS questions FROM p LEFT JOIN q USING (chunk_id) GROUP BY 1) SELECT questions, count(*) AS chunks FROM n GROUP BY 1", "lines")
def question_histogram(spark, d):
    return M.question_histogram(_chunks(spark, d).distinct(), _asked(spark, d))


@query("run_table", RUNS + " SELECT run, 'base' AS dataset, config, composite, row_number() OVER (ORDER BY composite DESC, run, config) AS place FROM (SELECT substring(config, 1, 7) AS run, config, round(2 * coalesce(judge, 0) + recall_at_5 - 0.5::DOUBLE * ttft_p50 / 1000, 6) AS composite FROM a) WHERE run <> 'Brand#1'")
def run_table(spark, d):
    r = _runs(spark, d).withColumn("composite", F.round(M.composite("judge", "recall_at_5", "ttft_p50"), 6))
    runs = r.groupBy(F.substring("config", 1, 7).alias("run")).agg(F.sort_array(F.collect_list(F.struct("config", "composite"))).alias("results"))
    return M.run_table(runs.select("run", F.lit("base").alias("dataset"), F.lit(False).alias("dirty"), (F.col("run") != "Brand#1").alias("complete"), "results"))


@query("pending_segments", "SELECT 'en-' || item_id % 3 AS direction, item_id AS ix FROM benchmark WHERE item_id % 4 <> 1")
def pending_segments(spark, d):
    s = _segments(spark, d).select("direction", F.col("segment").alias("ix"))
    return M.pending_segments(s, s.filter("ix % 4 = 1").unionByName(s.limit(1).select(F.lit(None).alias("direction"), "ix")))


@query("config_grid", "SELECT a.r_name || '_' || b.n_name AS name, a.r_regionkey AS k, CASE WHEN b.n_nationkey % 2 = 0 THEN b.n_nationkey ELSE 3 END AS pool FROM region a CROSS JOIN nation b WHERE b.n_nationkey < 5")
def config_grid(spark, d):
    a = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"), F.lit(3).alias("pool"))
    b = table(spark, d, "nation").filter("n_nationkey < 5").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("pool"))
    return M.config_grid([a, b])


@query("model_cell_matrix", f"WITH s AS ({SCORES}), c AS (SELECT lang AS config, model, format('{{:.3f}}', score) || ' / ' || CASE WHEN model = '2-HIGH' THEN '–' ELSE floor(score * 10)::BIGINT::VARCHAR END AS cell FROM s) SELECT config, " + ", ".join(f"coalesce(max(cell) FILTER (model = '{m}'), '–') AS \"{m}\"" for m in MODELS) + " FROM c GROUP BY config")
def model_cell_matrix(spark, d):
    s = _scores(spark, d).select(F.col("lang").alias("config"), "model", F.col("score").alias("judge"), F.when(F.col("model") != "2-HIGH", F.floor(F.col("score") * 10)).alias("ttft_p50"))
    return M.model_cell_matrix(s, MODELS)
