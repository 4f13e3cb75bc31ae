"""Experiment and statistics queries over the test tables, each with its DuckDB twin."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import matrix as X
from quillgraph.operators import statistics as S
from quillgraph.plans import views as V
from quillgraph.sources import files, models, sessions

R = lambda c, n=6: F.round(c, n)
W = f"WITH {V.RUNS_SQL}"


def _matrix(s, d):
    return X.matrix(V.run_sessions(s, d), V.STRATEGIES, V.RETAINED, V.THRESHOLDS, V.REPS)


def matrix(s, d):
    return _matrix(s, d).select("run_id", "ord")


def matrix_slice(s, d):
    return X.part_of(_matrix(s, d), 2, 5).select("run_id", "ord")


def _results(s, d):
    return _matrix(s, d).where("ord % 3 = 0").select("run_id", F.when(F.col("ord") % 2 == 0, "error").alias("status"))


def resume_antijoin(s, d):
    return X.still_to_run(_matrix(s, d), _results(s, d)).select("run_id")


def coverage_gate(s, d):
    return S.coverage_gate(_matrix(s, d), _results(s, d), "run_id", 0.3).select("planned", "done", R("coverage").alias("coverage"), "passed")


def strategy_summary(s, d):
    r = V.runs(s, d).select("strategy", "judge_score", (F.col("tokens_in") / (F.col("tokens_out") + 1)).alias("compression_ratio"), F.col("tokens_in").alias("latency_ms"), T.cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out")).alias("cost_usd"))
    out = X.strategy_summary(r)
    return out.select("strategy", "runs", *(R(c).alias(c) for c in ("quality", "compression", "latency_ms")), R("cost_usd", 9).alias("cost_usd"))


def cost_rollup(s, d):
    return X.cost_rollup(V.runs(s, d)).select("model", "calls", R("cost_usd").alias("cost_usd"))


def scheduler_phases(s, d):
    e = V.table(s, d, "events")
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("done")
    reg = e.select((F.col("user_id") % 5).alias("experiment"), F.col("event_id").alias("run_id"), status.alias("status"), (F.col("event_id") % 5).alias("attempts"))
    return X.phases(reg, max_concurrent=1000000)


def failure_gate(s, d):
    return S.failure_gate(V.runs(s, d), ["strategy"], F.col("judge_score").isNull(), 0.2).select("strategy", "n", R("failure_rate").alias("failure_rate"), "stopped")


def pearson(s, d):
    return V.runs(s, d).groupBy("strategy").agg(R(S.pearson("judge_score", "human_score")).alias("r"))


def pearson_flat(s, d):
    return V.runs(s, d).withColumn("flat", F.lit(1.0)).groupBy("strategy").agg(R(S.pearson("judge_score", "flat")).alias("r"))


def spearman_ordinal(s, d):
    return S.spearman(V.runs(s, d), "judge_score", "human_score", "event_id", "ordinal", ["strategy"]).select("strategy", R("rho").alias("rho"), "n")


def spearman_min(s, d):
    return S.spearman(V.runs(s, d), "judge_score", "human_score", "event_id", "min", ["strategy"]).select("strategy", R("rho").alias("rho"), "n")


def ols_slope(s, d):
    return V.runs(s, d).groupBy("strategy").agg(R(S.slope("judge_score", "event_id"), 9).alias("slope"))


def attractor(s, d):
    out = V.runs(s, d).groupBy("strategy").agg(S.attractor("judge_score", "human_score").alias("a"))
    return out.select("strategy", R("a.strength").alias("strength"), R("a.position").alias("position"))


def mean_sd(s, d):
    return S.describe(V.runs(s, d), "judge_score", ["strategy"]).select("strategy", "n", *(R(c).alias(c) for c in ("mean", "sd", "least", "most")))


def mean_abs_delta(s, d):
    return V.runs(s, d).groupBy("strategy").agg(R(S.mean_abs_delta("judge_score", "human_score")).alias("delta"), R(S.at_least(3, F.avg("judge_score"))).alias("mean"))


def ratings_by_position(s, d):
    """The n-th scored run of a strategy beside the n-th of another: a join on explicit ordinals."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("strategy").orderBy("event_id"))
    r = V.runs(s, d).where("judge_score is not null").withColumn("n", nth)
    a, b = r.where("strategy = 's3'").select("n", F.col("judge_score").alias("a")), r.where("strategy = 's9'").select("n", F.col("judge_score").alias("b"))
    return a.join(b, "n").select("n", R("a").alias("a"), R("b").alias("b"))


def dimension_means(s, d):
    return S.dimension_means(V.runs(s, d), ["judge_score", "human_score", "tokens_out"]).select("dimension", R("mean").alias("mean"), "n")


def row_means(s, d):
    return V.runs(s, d).select("event_id", R(S.row_mean("judge_score", "human_score")).alias("mean"), R(S.row_mean("human_score") / 7 * 4 + 1).alias("scaled"))


def cohens_d(s, d):
    return S.cohens_d(V.runs(s, d), "judge_score", "strategy", "s3", "s9").select("a", "b", "na", "nb", R("d").alias("d"))


def kruskal_wallis(s, d):
    return S.kruskal_wallis(V.runs(s, d), "judge_score", "strategy").select(R("h", 4).alias("h"), "df")


def holm_bonferroni(s, d):
    p = V.runs(s, d).where("judge_score is not null").groupBy((F.col("user_id") % 12).alias("test")).agg((F.avg("judge_score") / 5000).alias("p"))
    return S.holm(p, "p", "test").select("test", R("p").alias("p"), R("p_holm").alias("p_holm"))


def bootstrap_ci(s, d):
    return S.bootstrap_ci(V.runs(s, d), "judge_score", ["strategy"], "event_id", 100).select("strategy", R("lo").alias("lo"), R("hi").alias("hi"), "reps")


def permutation_test(s, d):
    out = S.permutation_test(V.runs(s, d), "judge_score", "strategy", "s3", "s9", "event_id", 100)
    return out.select(R("difference").alias("difference"), R("p").alias("p"), "reps")


def enough_runs(s, d):
    """Means of groups that have three runs or more; smaller groups have none."""
    r = V.runs(s, d).groupBy("user_id")
    return r.agg(F.count("*").alias("n"), R(S.at_least(3, F.avg("judge_score"))).alias("mean"))


def some_and_every(s, d):
    """By user: whether some event and whether every event is an error."""
    bad = F.col("event_type") == "error"
    return V.table(s, d, "events").groupBy("user_id").agg(*S.some_and_every(bad))


def sessions_prefixed(s, d):
    m = sessions.with_prefix(V.messages(s, d), ["1", "25"])
    return m.groupBy("session_id").agg(F.count("*").alias("n"))


def json_lines(s, d):
    return files.as_json(V.table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def report_table(s, d):
    return files.as_table(V.table(s, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


def time_argument(s, d):
    """Events since three days before the time of reading, the argument read when the plan is built."""
    since = T.parse_time("3d", V.AS_OF_MS)
    return V.table(s, d, "events").where(F.unix_millis("ts") >= since).groupBy("event_type").agg(F.count("*").alias("n"))


def packed_vectors(s, d):
    """Vectors packed as 32-bit floats and back."""
    back = models.unpack_float32(models.pack_float32(V.vectors(s, d).select("id", "embedding")).drop("embedding"), "blob")
    return back.select("id", F.size("embedding").alias("size"), R(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def vendi_score(s, d):
    """How many different vectors each label has in effect."""
    return S.vendi_score(V.vectors(s, d), "type").select("type", "n", R("vendi", 4).alias("vendi"))


def mean_pairwise_distance(s, d):
    return S.mean_pairwise_distance(V.vectors(s, d), "type").select("type", "n", R("mean_distance").alias("mean_distance"))


_MATRIX = f"""m AS (
    SELECT session, strategy, retained, threshold, rep, session || '-' || strategy || '-R' || retained || '-T' || threshold || '-r' || rep AS run_id,
           row_number() OVER (ORDER BY session, strategy, retained, threshold, rep) - 1 AS ord
    FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session FROM conversations), (SELECT unnest({V.STRATEGIES!r}) AS strategy),
         (SELECT unnest({V.RETAINED!r}) AS retained), (SELECT unnest({V.THRESHOLDS!r}) AS threshold), (SELECT unnest(range(1, {V.REPS} + 1)) AS rep))"""
_COST = "(tokens_in * CASE model WHEN 'sonnet' THEN 3.0 WHEN 'haiku' THEN 0.8 WHEN 'gemini-flash' THEN 0.15 ELSE 0 END + tokens_out * CASE model WHEN 'sonnet' THEN 15.0 WHEN 'haiku' THEN 4.0 WHEN 'gemini-flash' THEN 0.6 ELSE 0 END) / 1e6"
# cumulative Poisson(1) shares of 0 to 6
_POISSON, _share, _sum = "", math.exp(-1.0), 0.0
for _k in range(7):
    _sum += _share
    _POISSON += f"WHEN u < {_sum!r}::DOUBLE THEN {_k} "
    _share /= _k + 1
_RANKED = "SELECT strategy, round(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT strategy, {f}() OVER (PARTITION BY strategy ORDER BY judge_score{o}) AS x, {f}() OVER (PARTITION BY strategy ORDER BY human_score{o}) AS y FROM runs WHERE judge_score IS NOT NULL) GROUP BY strategy"
QUERIES = {
    "matrix": (matrix, f"WITH {_MATRIX} SELECT run_id, CAST(ord AS INT) AS ord FROM m"),
    "matrix_slice": (matrix_slice, f"WITH {_MATRIX}, k AS (SELECT ceil(count(*) / 5.0) AS size FROM m) SELECT run_id, CAST(ord AS INT) AS ord FROM m, k WHERE ord >= size AND ord < 2 * size"),
    "resume_antijoin": (resume_antijoin, f"WITH {_MATRIX} SELECT run_id FROM m WHERE NOT (ord % 3 = 0 AND ord % 2 <> 0)"),
    "coverage_gate": (coverage_gate, f"WITH {_MATRIX} SELECT count(*) AS planned, count(*) FILTER (ord % 3 = 0) AS done, round(count(*) FILTER (ord % 3 = 0) / count(*), 6) AS coverage, count(*) FILTER (ord % 3 = 0) / count(*) >= 0.3 AS passed FROM m"),
    "strategy_summary": (strategy_summary, f"{W} SELECT strategy, count(*) AS runs, round(avg(judge_score), 6) AS quality, round(avg(tokens_in / (tokens_out + 1)), 6) AS compression, round(avg(tokens_in), 6) AS latency_ms, round(avg({_COST}), 9) AS cost_usd FROM runs WHERE judge_score IS NOT NULL GROUP BY strategy"),
    "cost_rollup": (cost_rollup, f"{W} SELECT model, count(*) AS calls, round(sum({_COST}), 6) AS cost_usd FROM runs GROUP BY model"),
    "scheduler_phases": (scheduler_phases, """WITH r AS (SELECT user_id % 5 AS experiment, event_id AS run_id, event_type, event_id % 5 AS attempts FROM events),
        y AS (SELECT experiment, run_id, row_number() OVER (PARTITION BY experiment ORDER BY run_id) AS turn FROM r WHERE event_type = 'click' OR (event_type = 'error' AND attempts < 3)),
        p AS (SELECT experiment, run_id, row_number() OVER (ORDER BY turn, experiment) AS place FROM y)
        SELECT experiment, run_id, CAST(place AS INT) AS place FROM p WHERE place <= 1000000 - (SELECT count(*) FROM r WHERE event_type = 'signup')"""),
    "failure_gate": (failure_gate, f"{W} SELECT strategy, count(*) AS n, round(count(*) FILTER (judge_score IS NULL) / count(*), 6) AS failure_rate, count(*) FILTER (judge_score IS NULL) / count(*) > 0.2 AS stopped FROM runs GROUP BY strategy"),
    "pearson": (pearson, f"{W} SELECT strategy, round(corr(judge_score, human_score), 6) AS r FROM runs GROUP BY strategy"),
    "pearson_flat": (pearson_flat, f"{W} SELECT DISTINCT strategy, CAST(0.0 AS DOUBLE) AS r FROM runs"),
    "spearman_ordinal": (spearman_ordinal, f"{W} {_RANKED.format(f='row_number', o=', event_id')}"),
    "spearman_min": (spearman_min, f"{W} {_RANKED.format(f='rank', o='')}"),
    "ols_slope": (ols_slope, f"{W} SELECT strategy, round(regr_slope(judge_score, event_id), 9) AS slope FROM runs GROUP BY strategy"),
    "attractor": (attractor, f"{W} SELECT strategy, round(1 - regr_slope(judge_score, human_score), 6) AS strength, round(regr_intercept(judge_score, human_score) / (1 - regr_slope(judge_score, human_score)), 6) AS position FROM runs GROUP BY strategy"),
    "mean_sd": (mean_sd, f"{W} SELECT strategy, count(judge_score) AS n, round(avg(judge_score), 6) AS mean, round(stddev_pop(judge_score), 6) AS sd, round(min(judge_score), 6) AS least, round(max(judge_score), 6) AS most FROM runs GROUP BY strategy"),
    "mean_abs_delta": (mean_abs_delta, f"{W} SELECT strategy, round(avg(abs(judge_score - human_score)), 6) AS delta, round(avg(judge_score), 6) AS mean FROM runs GROUP BY strategy"),
    "ratings_by_position": (ratings_by_position, f"""{W}, r AS (SELECT strategy, judge_score, row_number() OVER (PARTITION BY strategy ORDER BY event_id) AS n FROM runs WHERE judge_score IS NOT NULL)
        SELECT CAST(a.n AS INT) AS n, round(a.judge_score, 6) AS a, round(b.judge_score, 6) AS b FROM r a JOIN r b ON a.n = b.n WHERE a.strategy = 's3' AND b.strategy = 's9'"""),
    "dimension_means": (dimension_means, f"""{W} SELECT 'judge_score' AS dimension, round(avg(judge_score), 6) AS mean, count(judge_score) AS n FROM runs UNION ALL SELECT 'human_score', round(avg(human_score), 6), count(*) FROM runs
        UNION ALL SELECT 'tokens_out', round(avg(tokens_out), 6), count(*) FROM runs"""),
    "row_means": (row_means, f"{W} SELECT event_id, round(CASE WHEN judge_score IS NULL THEN human_score ELSE (judge_score + human_score) / 2 END, 6) AS mean, round(human_score / 7 * 4 + 1, 6) AS scaled FROM runs"),
    "cohens_d": (cohens_d, f"""{W}, s AS (SELECT count(judge_score) FILTER (strategy = 's3') AS na, count(judge_score) FILTER (strategy = 's9') AS nb, avg(judge_score) FILTER (strategy = 's3') AS ma, avg(judge_score) FILTER (strategy = 's9') AS mb,
        var_samp(judge_score) FILTER (strategy = 's3') AS va, var_samp(judge_score) FILTER (strategy = 's9') AS vb FROM runs)
        SELECT 's3' AS a, 's9' AS b, na, nb, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM s"""),
    "kruskal_wallis": (kruskal_wallis, f"""{W}, k AS (SELECT strategy, judge_score, rank() OVER (ORDER BY judge_score) + (count(*) OVER (PARTITION BY judge_score) - 1) / 2.0 AS r FROM runs WHERE judge_score IS NOT NULL),
        g AS (SELECT strategy, count(*) AS n, sum(r) AS r FROM k GROUP BY strategy), t AS (SELECT sum(n * n * n - n) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY judge_score)), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM k)
        SELECT round((12 / (c.n * (c.n + 1)) * (SELECT sum(r * r / n) FROM g) - 3 * (c.n + 1)) / (1 - t.t / (c.n * c.n * c.n - c.n)), 4) AS h, (SELECT count(*) - 1 FROM g) AS df FROM c, t"""),
    "holm_bonferroni": (holm_bonferroni, f"""{W}, p AS (SELECT user_id % 12 AS test, avg(judge_score) / 5000 AS p FROM runs WHERE judge_score IS NOT NULL GROUP BY 1),
        q AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1)) AS s FROM p)
        SELECT test, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM q"""),
    "bootstrap_ci": (bootstrap_ci, f"""{W}, u AS (SELECT strategy, judge_score, rep, CAST('0x' || substr(md5(event_id || ':' || rep || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM runs, (SELECT unnest(range(1, 101)) AS rep) WHERE judge_score IS NOT NULL),
        m AS (SELECT strategy, rep, sum(w * judge_score) / nullif(sum(w), 0) AS m FROM (SELECT *, CASE {_POISSON} ELSE 7 END AS w FROM u) GROUP BY strategy, rep)
        SELECT strategy, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, count(m) AS reps FROM m GROUP BY strategy"""),
    "permutation_test": (permutation_test, f"""{W}, r AS (SELECT event_id, judge_score AS v, strategy = 's3' AS in_a FROM runs WHERE strategy IN ('s3', 's9') AND judge_score IS NOT NULL),
        k AS (SELECT avg(v) FILTER (in_a) - avg(v) FILTER (NOT in_a) AS seen, count(*) FILTER (in_a) AS na FROM r),
        e AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY CAST('0x' || substr(md5(event_id || ':' || rep || ':42'), 1, 15) AS BIGINT), event_id) <= na AS pa FROM r, k, (SELECT unnest(range(1, 101)) AS rep)),
        x AS (SELECT rep, abs(avg(v) FILTER (pa) - avg(v) FILTER (NOT pa)) AS d FROM e GROUP BY rep)
        SELECT round(any_value(seen), 6) AS difference, round((count(*) FILTER (d >= abs(seen) - 1e-12) + 1) / (count(*) + 1), 6) AS p, count(*) AS reps FROM x, k"""),
    "enough_runs": (enough_runs, f"{W} SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(avg(judge_score), 6) END AS mean FROM runs GROUP BY user_id"),
    "some_and_every": (some_and_every, "SELECT user_id, bool_or(event_type = 'error') AS some, bool_and(event_type = 'error') AS every FROM events GROUP BY user_id"),
    "sessions_prefixed": (sessions_prefixed, "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n FROM conversations WHERE CAST(conv_id AS VARCHAR) LIKE '1%' OR CAST(conv_id AS VARCHAR) LIKE '25%' GROUP BY 1"),
    "json_lines": (json_lines, """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation"""),
    "report_table": (report_table, """SELECT 0 AS n, 'n_nationkey  n_name' AS line UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), rpad(CAST(n_nationkey AS VARCHAR), 11, ' ') || '  ' || n_name FROM nation"""),
    "time_argument": (time_argument, f"SELECT event_type, count(*) AS n FROM events WHERE epoch_us(ts) // 1000 >= {V.AS_OF_MS} - 3 * 86400000 GROUP BY 1"),
    "packed_vectors": (packed_vectors, "SELECT vec_id AS id, CAST(len(embedding) AS INT) AS size, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings"),
    "vendi_score": (vendi_score, None),
    "mean_pairwise_distance": (mean_pairwise_distance, f"""WITH {V.VECTORS_SQL}, k AS (SELECT type, count(*) AS n FROM vectors GROUP BY type)
        SELECT k.type, k.n, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS mean_distance FROM k JOIN vectors a ON a.type = k.type JOIN vectors b ON b.type = k.type AND a.id < b.id GROUP BY k.type, k.n"""),
}
