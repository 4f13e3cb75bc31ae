"""Experiment matrices: every combination, slices for workers, what is left to run, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import cost_usd, run_id


def matrix(sessions: DataFrame, strategies: list[str], retained: list[int], thresholds: list[int], reps: int, model: str | None = None) -> DataFrame:
    """One row a combination with its ``run_id`` and 0-based ``ord``; lists are literals, so no join is made.

    Only sessions are ranked; a cell's place follows from its session's and those of its values.
    """
    each = sessions.select(F.col("session_id").cast("string").alias("session")).withColumn("ord", F.row_number().over(Window.orderBy("session")) - 1)
    for name, values in (("strategy", strategies), ("retained", retained), ("threshold", thresholds), ("rep", list(range(1, reps + 1)))):
        each = each.select("*", F.posexplode(F.array(*map(F.lit, sorted(values)))).alias("_at", name)).withColumn("ord", F.col("ord") * len(values) + F.col("_at")).drop("_at")
    s = lambda c: F.col(c).cast("string")
    cell = run_id(F.col("session"), F.col("strategy"), s("retained"), s("threshold"), F.lit(model), s("rep"))
    return each.select("session", "strategy", "retained", "threshold", "rep", cell.alias("run_id"), "ord")


def part_of(cells: DataFrame, i: int, n: int) -> DataFrame:
    """Slice ``i`` of ``n``, from 1: runs of ceil(size / n) cells in order."""
    size = cells.agg(F.ceil(F.count("*") / n).alias("_size"))  # one row
    return cells.join(F.broadcast(size)).where((F.col("ord") >= (i - 1) * F.col("_size")) & (F.col("ord") < i * F.col("_size"))).drop("_size")


def still_to_run(cells: DataFrame, results: DataFrame) -> DataFrame:
    """Cells without a result; error rows do not count as one."""
    done = results.where("status is null or status <> 'error'") if "status" in results.columns else results
    return cells.join(done.select("run_id"), "run_id", "left_anti")


def strategy_summary(results: DataFrame) -> DataFrame:
    """Means of the scored runs by strategy."""
    scored = results.where(F.col("judge_score").isNotNull())
    return scored.groupBy("strategy").agg(
        F.count("*").alias("runs"), F.avg("judge_score").alias("quality"), F.avg("compression_ratio").alias("compression"), F.avg("latency_ms").alias("latency_ms"), F.avg("cost_usd").alias("cost_usd")
    )


def cost_rollup(calls: DataFrame) -> DataFrame:
    """Cost by model over calls ``(model, tokens_in, tokens_out)``; unknown models cost 0."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum(cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))).alias("cost_usd"))


def phases(registry: DataFrame, max_retries: int = 3, max_concurrent: int = 8) -> DataFrame:
    """What a scheduler starts next: queued runs, round-robin over experiments, within the free places.

    ``registry`` has ``(experiment, run_id, status, attempts)``; runs that failed too often are ``dead``.
    """
    state = F.when((F.col("status") == "failed") & (F.col("attempts") >= max_retries), "dead").when(F.col("status").isin("queued", "failed"), "ready").otherwise(F.col("status"))
    rows = registry.withColumn("state", state)
    free = max(0, max_concurrent - rows.where(F.col("state") == "running").count())
    turn = F.row_number().over(Window.partitionBy("experiment").orderBy("run_id"))
    first = rows.where("state = 'ready'").withColumn("turn", turn).orderBy("turn", "experiment").limit(free)  # only these are ranked
    return first.withColumn("place", F.row_number().over(Window.orderBy("turn", "experiment"))).select("experiment", "run_id", "place")


def write_phase(results: DataFrame, path: str, phase: str) -> None:
    """A phase's results as JSON in a folder of its own, with a one-row summary beside them; an earlier run of the phase is replaced."""
    results.write.mode("overwrite").json(f"{path}/{phase}-results")
    numeric = [f.name for f in results.schema.fields if f.dataType.typeName() in ("integer", "long", "float", "double")]
    summary = results.agg(F.count("*").alias("results"), *(F.avg(c).alias(f"mean_{c}") for c in numeric)).withColumn("phase", F.lit(phase))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/{phase}-summary")


def write_runs(results: DataFrame, path: str) -> None:
    """One folder a strategy, as JSON; earlier results stay."""
    results.write.mode("append").partitionBy("strategy").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results with a fixed schema; unreadable files and rows are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(path)
