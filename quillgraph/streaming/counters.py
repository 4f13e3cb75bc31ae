"""Access counters of a stream: a run of counts a batch, merged by size, so that a batch writes about what it brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans import commits
from quillgraph.plans.lineage import remove
from quillgraph.streaming.events import access_counts

#: Runs of a level that are merged into one of the next; folders by key that a run is dealt to.
FAN, BUCKETS = 8, 16


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("user_id").agg(
        F.sum("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"),
        F.sum("helpful_count").alias("helpful_count"), F.sum("harmful_count").alias("harmful_count"),
    )


def _write(counts: DataFrame, path: str) -> None:
    """A run, dealt to folders by key, one file each, so that a lookup reads one folder of each run."""
    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int"))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _state(spark: SparkSession, folder: str) -> dict:
    known = commits.versions(spark, f"{folder}/log")
    return commits.entry(spark, f"{folder}/log", known[-1]) if known else {"version": 0, "batch": -1, "runs": [], "retired": []}


def _read(spark: SparkSession, folder: str, runs: list[dict]) -> DataFrame:
    columns = ["user_id", "access_count", "last_accessed", "helpful_count", "harmful_count"]
    return spark.read.parquet(*(f"{folder}/{r['name']}/bucket=*" for r in runs)).select(*columns)


def read_counts(spark: SparkSession, folder: str) -> DataFrame | None:
    """The counters as of the last batch; None before the first."""
    runs = _state(spark, folder)["runs"]
    return _summed(_read(spark, folder, runs)) if runs else None


def counts_of(spark: SparkSession, folder: str, user_id) -> DataFrame | None:
    """One node's counters, from one folder of each run."""
    state = _state(spark, folder)
    if not state["runs"]:
        return None
    kind = _read(spark, folder, state["runs"][:1]).schema["user_id"].dataType
    key = F.lit(user_id).cast(kind)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).first()[0]
    parts = [spark.read.option("basePath", f"{folder}/{r['name']}").parquet(f"{folder}/{r['name']}").where(F.col("bucket") == bucket).drop("bucket") for r in state["runs"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _summed(out.where(F.col("user_id") == key))


def counter(spark: SparkSession, folder: str, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that counts accesses under ``folder``.

    A batch becomes a run of its own. When a level has ``fan`` runs, they become one of the next level, so
    a row is written again once a level, and levels grow with the logarithm of the batches. The list of
    runs is a version of the folder's log: a batch counts when that is written, once. A batch that is
    run again after that is known by its number and skipped; one that was stopped before writes the
    same run again. Runs that were merged away stay until the next batch, for readers of the version before.
    An empty batch is a version without a run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        state = _state(session, folder)
        if batch_id <= state["batch"]:
            return
        runs, retired = list(state["runs"]), []
        new = access_counts(batch)
        name = f"run-{batch_id}"
        _write(new, f"{folder}/{name}")
        if session.read.option("recursiveFileLookup", "true").schema("user_id string").parquet(f"{folder}/{name}").isEmpty():
            retired.append(name)
        else:
            runs.append({"name": name, "level": 0, "lo": batch_id, "hi": batch_id})
        for level in range(64):
            same = [r for r in runs if r["level"] == level]
            if len(same) < fan:
                break
            lo, hi = same[0]["lo"], same[-1]["hi"]
            together = {"name": f"run-{lo}-{hi}-{level + 1}", "level": level + 1, "lo": lo, "hi": hi}
            _write(_summed(_read(session, folder, same)), f"{folder}/{together['name']}")
            retired += [r["name"] for r in same]
            runs = [together if r is same[0] else r for r in runs if r is same[0] or r not in same]
        version = commits.commit(session, f"{folder}/log", state["version"], {"batch": batch_id, "runs": runs, "retired": retired})
        for old in state["retired"]:
            remove(session, f"{folder}/{old}")
        if version > 2:
            remove(session, f"{folder}/log/{version - 2:020d}.json")

    return write
