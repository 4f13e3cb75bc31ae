"""Files around a store: detail texts, staged notes, reports, summaries, workspace counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.plans.lineage import exists


def write_details(details: DataFrame, folder: str) -> None:
    """Long texts ``(id, detail)`` beside the graph, as a table; a later text of an id is one more row."""
    details.where("detail is not null").select(F.col("id").cast("string").alias("id"), "detail").write.mode("append").parquet(folder)


def with_detail_flag(nodes: DataFrame, folder: str) -> DataFrame:
    """Adds ``has_detail``: whether a detail text was written; a folder that isn't there has none."""
    spark = nodes.sparkSession
    known = spark.read.parquet(folder).select("id") if exists(spark, folder) else spark.createDataFrame([], "id string")
    return nodes.join(known.distinct().withColumn("has_detail", F.lit(True)), "id", "left").withColumn("has_detail", F.coalesce("has_detail", F.lit(False)))


def read_details(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """``(id, detail)`` of the given ids, texts whole whatever lines they have."""
    return spark.read.parquet(folder).join(ids.select("id"), "id", "left_semi").select("id", "detail")


def unreviewed(spark: SparkSession, path: str) -> DataFrame:
    """How many staged rows of a JSON lines file are not reviewed."""
    staged = spark.read.schema("id string, reviewed boolean").json(path)
    return staged.agg(F.count_if(~F.coalesce("reviewed", F.lit(False))).alias("unreviewed"), F.count("*").alias("staged"))


def workspace_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by extension under ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return files.groupBy(kind.alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def json_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``(file, entries)``: how many entries each JSON file under ``path`` has, of an array or an object; null if it is neither."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    entries = F.coalesce(F.json_array_length("value"), F.size(F.json_object_keys("value")))
    return whole.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), entries.alias("entries"))


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one line of JSON, for a sink of lines; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))


def as_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(n, line)``: rows as lines of equally wide columns below a line of names, in the order of ``by``; for reports that people read."""
    text = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns), F.struct(*by).alias("_by"))
    widths = text.agg(*(F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c))).alias(f"_{c}") for c in rows.columns))  # one row
    line = lambda cell: F.rtrim(F.concat_ws("  ", *(F.rpad(cell(c), F.col(f"_{c}"), F.lit(" ")) for c in rows.columns)))
    head = widths.select(F.lit(0).alias("n"), line(F.lit).alias("line"))
    place = F.row_number().over(Window.orderBy("_by"))  # a report is short
    return head.unionAll(text.join(F.broadcast(widths)).select(place.alias("n"), line(F.col).alias("line")))


def write_report(text: DataFrame, path: str) -> None:
    """A one-row text as a Markdown file."""
    text.select("text").coalesce(1).write.mode("overwrite").text(path)


def write_batch_summary(results: DataFrame, path: str, at: str) -> None:
    """All results, cached ones too, as JSON lines, and one line with their number and total cost, named by time."""
    results.write.mode("overwrite").json(f"{path}/batch-results-{at}")
    summary = results.agg(F.count("*").alias("results"), F.sum("cost_usd").alias("total_cost")).withColumn("timestamp", F.lit(at))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/batch-summary-{at}")
