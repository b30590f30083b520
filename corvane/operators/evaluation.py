"""Retrieval, latency, judge and translation metrics over tables of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_score

CHAR_N, WORD_N, BETA = 6, 2, 2
PHASES = ("route", "embed", "retrieve", "fuse", "rerank", "prefill")
BUCKETS = ("miss", "1", "2-5", "6-10", ">10")


def expected_ranks(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Questions (config, query_id, expected) with the rank of the expected id, null for a miss."""
    r = ranked.select("config", "query_id", F.col("id").alias("expected"), "rank").groupBy("config", "query_id", "expected").agg(F.min("rank").alias("rank"))
    return questions.join(r, ["config", "query_id", "expected"], "left")


def recall_at_k(rank, k: int) -> Column:
    return F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0))


def mrr(rank) -> Column:
    return F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0)))


def ndcg_at_k(rank, k: int) -> Column:
    return F.avg(F.when(F.col(rank) <= k, 1.0 / F.log2(F.col(rank) + 1.0)).otherwise(0.0))


def required_share(retrieved, required, expected, k: int) -> Column:
    """Share of the required ids in the top k; without a set the expected id, for an empty set zero."""
    need = F.coalesce(F.col(required), F.array(F.col(expected)))
    top = F.slice(F.coalesce(F.col(retrieved), F.array().cast("array<bigint>")), 1, k)
    return F.when(F.size(need) == 0, 0.0).otherwise(F.size(F.array_intersect(need, top)) / F.size(F.array_distinct(need)))


def eval_report(questions: DataFrame, ks=(1, 5, 10), required_ks=(5, 10, 12)) -> DataFrame:
    """One row a config from (config, rank, retrieved, required, expected)."""
    parts = [F.count("*").alias("n"), *(recall_at_k("rank", k).alias(f"recall_at_{k}") for k in ks), mrr("rank").alias("mrr"), ndcg_at_k("rank", 10).alias("ndcg_at_10")]
    parts += [F.avg(required_share("retrieved", "required", "expected", k)).alias(f"recall_required_at_{k}") for k in required_ks]
    return questions.groupBy("config").agg(*parts)


#: Bins into which the values of a group are counted before only those at a quantile are ordered.
BINS = 4096


def floor_percentile(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """sorted[min(n - 1, floor(n * q))] for each group.

    Groups may be few and large, so none is ordered whole: counts of ``BINS`` bins between a group's least
    and largest value tell where a quantile lies, and of that bin the distinct values are counted
    and ordered.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("max"), F.avg("_v").alias("mean"))
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in by), F.lit(True))
    joined = rows.alias("r").join(stats.select(*by, "_lo", F.col("max").alias("_hi")).alias("s"), same(rows, stats)).select("r.*", "_lo", "_hi")
    spread = F.col("_hi").cast("double") - F.col("_lo")
    placed = joined.select(*by, "_v", F.when(spread > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_v").cast("double") - F.col("_lo")) / spread * BINS))).otherwise(0).alias("_bin"))
    upto = Window.partitionBy(*by).orderBy("_bin")
    bins = placed.groupBy(*by, "_bin").agg(F.count("*").alias("_k")).withColumn("_before", F.sum("_k").over(upto) - F.col("_k"))
    wanted = stats.select(*by, F.explode(F.array(*(F.struct(F.lit(name).alias("q"), F.least(F.col("n") - 1, F.floor(F.col("n") * q)).alias("i")) for name, q in quantiles.items()))).alias("_w"))
    at = bins.alias("b").join(wanted.alias("w"), same(bins, wanted) & (F.col("_w.i") >= F.col("_before")) & (F.col("_w.i") < F.col("_before") + F.col("_k")))
    at = at.select(*(bins[c] for c in by), "_bin", F.col("_w.q").alias("_q"), (F.col("_w.i") - F.col("_before")).alias("_off"))
    values = placed.groupBy(*by, "_bin", "_v").agg(F.count("*").alias("_k"))
    near = values.join(at, same(values, at) & (values["_bin"] == at["_bin"])).select(*(values[c] for c in by), "_q", "_off", "_v", "_k")
    below = F.sum("_k").over(Window.partitionBy(*by, "_q").orderBy("_v")) - F.col("_k")
    hit = near.withColumn("_below", below).filter((F.col("_off") >= F.col("_below")) & (F.col("_off") < F.col("_below") + F.col("_k")))
    found = hit.groupBy(*by).agg(*(F.max(F.when(F.col("_q") == name, F.col("_v"))).alias(name) for name in quantiles))
    return stats.join(found, same(stats, found)).select(*(stats[c] for c in by), "n", *quantiles, "max", "mean")


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return floor_percentile(df, by, value, {"p50": 0.5, "p95": 0.95})


def phase_summary(df: DataFrame, by: list[str], phases=PHASES, full: str = "full_response") -> DataFrame:
    """Latency of each phase, of their sum (ttft), and of the full response where measured."""
    total = F.aggregate(F.array(*(F.coalesce(F.col(p), F.lit(0.0)) for p in phases)), F.lit(0.0), lambda s, x: s + x)
    wide = df.withColumn("ttft", total)
    names = [*phases, "ttft", full]
    long = wide.select(*by, F.inline(F.array(*(F.struct(F.lit(p).alias("phase"), F.col(p).cast("double").alias("ms")) for p in names))))
    return latency_summary(long, [*by, "phase"], "ms")


def resource_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.max("rss_mb")).alias("rss_max"), F.round(F.avg("rss_mb")).alias("rss_mean"), F.round(F.avg("cpu"), 3).alias("cpu_mean"), F.min("free_vram_mb").alias("vram_min"))


def composite(judge, recall, ttft_ms) -> Column:
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return 2 * z(judge) + z(recall) - 0.5 * z(ttft_ms) / 1000


def composite_rank(df: DataFrame, name: str = "config") -> DataFrame:
    scored = df.withColumn("composite", composite("judge", "recall_at_5", "ttft_p50"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("composite", 9)), name)))


def parse_judge(raw) -> Column:
    """Struct (parsed, faithfulness, relevance, completeness, mean); anything missing gives zeros."""
    a, b, c = (parse_score(raw, n) for n in ("faithfulness", "relevance", "completeness"))
    parsed = a.isNotNull() & b.isNotNull() & c.isNotNull()
    z = lambda x: F.when(parsed, x).otherwise(0.0)
    return F.struct(parsed.alias("parsed"), z(a).alias("faithfulness"), z(b).alias("relevance"), z(c).alias("completeness"), z((a + b + c) / 3).alias("mean"))


def judge_average(df: DataFrame) -> DataFrame:
    """Mean of parsed scores, parsed share and count of unjudged rows by config (judge: null or struct)."""
    return df.groupBy("config").agg(F.avg(F.when(F.col("parsed"), F.col("mean"))).alias("judge"), F.avg(F.when(F.col("parsed"), 1.0).otherwise(0.0)).alias("parsed_share"), F.count_if(F.col("parsed").isNull()).alias("pending"))


def pending_rescore(df: DataFrame, judged: DataFrame) -> DataFrame:
    return df.join(judged.filter("parsed IS NOT NULL"), ["config", "query_id"], "left_anti")


def intent_leaderboard(df: DataFrame) -> DataFrame:
    stats = df.groupBy("intent", "config").agg(F.count("*").alias("n"), F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("judge").alias("judge"))
    order = Window.partitionBy("intent").orderBy(F.desc_nulls_last(F.round("judge", 9)), "config")
    return stats.withColumn("place", F.row_number().over(order))


def rank_bucket(rank) -> Column:
    r = F.col(rank)
    return F.when(r.isNull(), "miss").when(r == 1, "1").when(r <= 5, "2-5").when(r <= 10, "6-10").otherwise(">10")


def rank_bucket_table(df: DataFrame) -> DataFrame:
    """Every bucket with count, scored count, mean and upper median of the judge."""
    marked = df.withColumn("bucket", rank_bucket("rank"))
    counts = marked.groupBy("bucket").agg(F.count("*").alias("n"))
    scores = floor_percentile(marked, ["bucket"], "judge", {"median": 0.5}).select("bucket", F.col("n").alias("scored"), "mean", "median")
    fixed = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(BUCKETS)], "place int, bucket string")
    out = fixed.join(counts, "bucket", "left").join(scores, "bucket", "left")
    return out.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("scored", F.lit(0)).alias("scored"), "mean", "median")


def judge_coverage(df: DataFrame, most: float = 0.2) -> DataFrame:
    """Configs with rows without a judge or with too many unparsed ones."""
    stats = df.groupBy("config").agg(F.count("*").alias("n"), F.count_if(F.col("parsed").isNull()).alias("missing"), F.count_if(~F.coalesce(F.col("parsed"), F.lit(True))).alias("unparsed"))
    return stats.filter((F.col("missing") > 0) | (F.col("unparsed") > most * F.col("n")))


def _gram_rows(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    bare = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?U)\s+", "")
    words = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"(?U)\s+"), lambda w: F.length(w) > 0)
    places = lambda size, n: F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))

    def chars(n):
        return F.transform(places(F.length(bare), n), lambda i: F.struct(F.lit(f"c{n}").alias("kind"), bare.substr(i, F.lit(n)).alias("gram")))

    def runs(n):
        return F.transform(places(F.size(words), n), lambda i: F.struct(F.lit(f"w{n}").alias("kind"), F.array_join(F.slice(words, i, F.lit(n)), " ").alias("gram")))

    lists = [*map(chars, range(1, CHAR_N + 1)), *map(runs, range(1, WORD_N + 1))]
    return df.select(*ids, F.inline(F.concat(*lists)))


def chrf_counts(df: DataFrame, ids: list[str], hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(ids, kind, hyp, ref, both): n-gram counts of each order for every segment."""
    count = lambda c, name: _gram_rows(df, c, ids).groupBy(*ids, "kind", "gram").agg(F.count("*").alias(name))
    both = count(hyp, "h").join(count(ref, "r"), [*ids, "kind", "gram"], "full_outer")
    return both.groupBy(*ids, "kind").agg(F.sum(F.coalesce("h", F.lit(0))).alias("hyp"), F.sum(F.coalesce("r", F.lit(0))).alias("ref"), F.sum(F.least(F.coalesce("h", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("both"))


def chrf_score(counts: DataFrame, by: list[str]) -> DataFrame:
    """chrF++ of counts pooled over ``by``: mean F-score of the eight orders, times 100."""
    pooled = counts.groupBy(*by, "kind").agg(F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"), F.sum("both").alias("both"))
    p, r = F.col("both") / F.greatest("hyp", F.lit(1)), F.col("both") / F.greatest("ref", F.lit(1))
    f = F.when(F.col("both") == 0, 0.0).otherwise((1 + BETA**2) * p * r / (BETA**2 * p + r))
    return pooled.withColumn("f", f).filter("hyp > 0 OR ref > 0").groupBy(*by).agg((100 * F.sum("f") / F.count("*")).alias("chrf"))


def chrf(df: DataFrame, by: list[str], segment: str = "segment", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Corpus chrF++ by group; groups whose segments are all empty score 0."""
    scores = chrf_score(chrf_counts(df, [*by, segment], hyp, ref), by)
    return df.select(*by).distinct().join(scores, by, "left").withColumn("chrf", F.coalesce("chrf", F.lit(0.0)))


def direction_summary(segments: DataFrame) -> DataFrame:
    stats = segments.groupBy("direction").agg(F.count("*").alias("n"), F.round(F.avg("ms")).alias("mean_ms"))
    return stats.join(chrf(segments, ["direction"], "segment"), "direction").withColumn("chrf", F.round("chrf", 2))


def score_matrix(scores: DataFrame, models: list[str]) -> DataFrame:
    """Language by model, with the best model (first in name order on ties)."""
    wide = scores.groupBy("lang").pivot("model", models).agg(F.first("score"))
    best = scores.groupBy("lang").agg(F.min_by("model", F.struct((-F.col("score")).alias("s"), "model")).alias("best"))
    return wide.join(best, "lang")


def baseline_verdicts(scores: DataFrame, baseline: str, margin: float = 3.0, least: float = 30.0) -> DataFrame:
    """Each model against the baseline: broken below ``least``, fallback if the baseline leads by more than ``margin``."""
    base = scores.filter(F.col("model") == baseline).select("lang", F.col("score").alias("base"))
    verdict = F.when(F.col("score") < least, "broken").when(F.col("base") - F.col("score") > margin, "fallback").otherwise("ok")
    return scores.filter(F.col("model") != baseline).join(base, "lang", "left").select("lang", "model", "score", "base", verdict.alias("verdict"))


def assemble_dataset(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions whose chunk exists, counts of kept and unknown)."""
    known = questions.join(chunks.select("chunk_id").distinct().withColumn("_known", F.lit(True)), "chunk_id", "left")
    report = known.agg(F.count_if(F.col("_known").isNotNull()).alias("kept"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    return known.filter("_known").drop("_known"), report


def validate_dataset(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(level, reason, id) of every problem.  questions: question_id, question, required, intent."""
    row = lambda df, level, reason, id: df.select(F.lit(level).alias("level"), F.lit(reason).alias("reason"), F.col(id).alias("id"))
    twice = chunks.groupBy("chunk_id").count().filter("count > 1")
    blank = questions.filter(F.coalesce(F.length(F.trim("question")), F.lit(0)) == 0)
    needed = questions.select("question_id", F.explode("required").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("question_id").distinct()
    thin = questions.filter(F.col("intent").isin("broad", "summary") & (F.size("required") == 1))
    return row(twice, "error", "duplicate-chunk", "chunk_id").unionByName(row(blank, "error", "empty-question", "question_id")).unionByName(row(needed, "error", "unknown-required", "question_id")).unionByName(row(thin, "warning", "single-required", "question_id"))


def inspect_dataset(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions by intent and theme with their dangling references and missing chunks."""
    ids = chunks.select("chunk_id").distinct()
    dangling = questions.select("question_id", F.explode("required").alias("chunk_id")).join(ids, "chunk_id", "left_anti").groupBy("question_id").agg(F.count("*").alias("d"))
    missing = questions.join(ids, "chunk_id", "left_anti").select("question_id", F.lit(1).alias("m"))
    joined = questions.join(dangling, "question_id", "left").join(missing, "question_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy("intent", "theme").agg(F.count("*").alias("n"), zero("d").alias("dangling"), zero("m").alias("missing_chunk"))


def question_histogram(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Number of chunks by number of questions, zero included."""
    n = questions.groupBy("chunk_id").agg(F.count("*").alias("questions"))
    return chunks.select("chunk_id").join(n, "chunk_id", "left").groupBy(F.coalesce("questions", F.lit(0)).alias("questions")).agg(F.count("*").alias("chunks"))


def run_table(runs: DataFrame) -> DataFrame:
    """One row a config of run summaries (run, dataset, dirty, complete, results array)."""
    rows = runs.filter(F.col("complete") & ~F.col("dirty")).select("run", "dataset", F.explode("results").alias("r")).select("run", "dataset", "r.*")
    order = Window.orderBy("dataset", F.desc("composite"), "run", "config")
    return rows.withColumn("place", F.row_number().over(order))


def pending_segments(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments without a readable result (null keys mark unreadable lines)."""
    return segments.join(done.filter("direction IS NOT NULL AND ix IS NOT NULL"), ["direction", "ix"], "left_anti")


def config_grid(axes: list[DataFrame]) -> DataFrame:
    """All combinations of axis tables (name, options...); a later axis overrides earlier options.

    Axes are a handful of user-given option rows; their product is the grid itself.
    """
    out = axes[0]
    for axis in axes[1:]:
        b = axis.select(*(F.col(c).alias(f"_b_{c}") for c in axis.columns))
        columns = list(dict.fromkeys([*out.columns, *axis.columns]))
        pick = lambda c, out=out, axis=axis: F.coalesce(*([F.col(f"_b_{c}")] if c in axis.columns else []), *([F.col(c)] if c in out.columns else []))
        out = out.join(b).select(*(F.concat_ws("_", "name", "_b_name").alias("name") if c == "name" else pick(c).alias(c) for c in columns))
    return out


def model_cell_matrix(df: DataFrame, models: list[str]) -> DataFrame:
    """Config by model: judge and time to first token as text, a dash where missing."""
    cell = F.concat(F.coalesce(F.format_number("judge", 3), F.lit("–")), F.lit(" / "), F.coalesce(F.col("ttft_p50").cast("long").cast("string"), F.lit("–")))
    return df.withColumn("cell", cell).groupBy("config").pivot("model", models).agg(F.first("cell")).fillna("–", models)
