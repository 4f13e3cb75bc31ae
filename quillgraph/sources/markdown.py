"""Notes in Markdown as node tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import slugify

NODES = "id string, type string, name string, content string, source string, tags array<string>, status string, created_at long"


def sections(spark: SparkSession, path: str) -> DataFrame:
    """``(file, section, line_no, line)``: lines below each second-level heading."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(F.split("value", r"(?m)^## ")).alias("at", "part"))
    lines = text.where("at > 0").select("file", "at", F.posexplode(F.split("part", r"\r?\n")).alias("line_no", "line"))
    title = F.first(F.when(F.col("line_no") == 0, F.trim("line")), ignorenulls=True).over(Window.partitionBy("file", "at"))
    return lines.withColumn("section", title).where("line_no > 0").select("file", "at", "section", "line_no", "line")


def lessons(spark: SparkSession, path: str) -> DataFrame:
    """``- **Title.** body (source)`` bullets as lesson nodes."""
    found = sections(spark, path).withColumn("title", F.regexp_extract("line", r"^- \*\*(.+?)\.?\*\*", 1)).where("title <> ''")
    body = F.trim(F.regexp_replace("line", r"^- \*\*.+?\*\*\s*", ""))
    return found.select(
        F.concat(F.lit("lesson-"), slugify(F.col("title"), 50, trim=False)).alias("id"), F.lit("lesson").alias("type"), F.col("title").alias("name"),
        F.regexp_replace(body, r"\s*\([^()]*\)\s*$", "").alias("content"), F.nullif(F.regexp_extract(body, r"\(([^()]*)\)\s*$", 1), F.lit("")).alias("source"),
        F.array(slugify(F.col("section"), 40, trim=False)).alias("tags"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("created_at"),
    )


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Sections with checkboxes as task nodes: done if every box is ticked; struck text loses its marks."""
    boxes = sections(spark, path).where(F.col("line").rlike(r"^- \["))
    text = F.regexp_replace(F.regexp_replace("line", r"^- \[[ xX]\]\s*", ""), "~~", "")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), "; ")
    done = F.bool_and(F.col("line").rlike(r"^- \[[xX]\]"))
    got = boxes.groupBy("file", "at", "section").agg(lines.alias("content"), done.alias("done"))
    return got.select(
        F.concat(F.lit("task-"), slugify(F.col("section"), 50, trim=False)).alias("id"), F.lit("task").alias("type"), F.col("section").alias("name"),
        F.substring("content", 1, 200).alias("content"), F.col("file").alias("source"), F.array().cast("array<string>").alias("tags"),
        F.when(F.col("done"), "done").otherwise("active").alias("status"), F.lit(None).cast("long").alias("created_at"),
    )


def daily_logs(spark: SparkSession, path: str, as_of: str, days: int = 7) -> DataFrame:
    """Bullets of files named by date, of the last ``days``; entries under ten characters only take up a number."""
    # older files are not even listed; dates to come count as recent
    first = dt.date.fromisoformat(as_of[:10]) - dt.timedelta(days=days)
    names = [str(first + dt.timedelta(days=i)) for i in range(days + 1)] + [f"{y}-*" for y in range(first.year + 1, first.year + 3)] + [f"{first.year}-{m:02d}-*" for m in range(first.month, 13)]
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{{{','.join(names)}}}.md").withColumn("date", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.md$", 1))
    recent = files.where((F.col("date") != "") & (F.try_to_date("date") >= F.date_sub(F.to_date(F.lit(as_of)), days)))
    bullets = F.transform(F.filter(F.split("value", r"\r?\n"), lambda s: F.startswith(s, F.lit("- "))), lambda s: F.trim(F.substring(s, F.lit(3), F.length(s))))
    each = recent.select("date", F.posexplode(bullets).alias("n", "text")).where(F.length("text") >= 10)
    at = F.unix_millis(F.to_timestamp("date")) + F.col("n") * 60000
    return each.select(
        F.concat(F.lit("event-"), "date", F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("id"), F.lit("event").alias("type"), F.substring("text", 1, 60).alias("name"),
        F.col("text").alias("content"), F.concat("date", F.lit(".md")).alias("source"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("status"), at.alias("created_at"),
    )


def import_all(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The rows of every loader that works, and ``(source, error)`` for those that don't."""
    good, errors = spark.createDataFrame([], NODES), []
    for name, load in loaders.items():
        try:
            part = load()
            part.limit(1).count()
            good = good.unionByName(part, allowMissingColumns=True)
        except Exception as e:  # a broken source must not stop the others; it is reported
            errors.append((name, str(e).splitlines()[0][:300]))
    return good, spark.createDataFrame(errors, "source string, error string")


def literal_nodes(spark: SparkSession, rows: list[tuple], as_of_ms: int) -> DataFrame:
    """Nodes written out in code: ``(id, type, name, content)`` tuples as a node table, created at one time."""
    given = spark.createDataFrame(rows, "id string, type string, name string, content string")
    empty = {"source": F.lit("literal"), "tags": F.array().cast("array<string>"), "status": F.lit(None).cast("string"), "created_at": F.lit(as_of_ms).cast("long")}
    return given.withColumns(empty)


def literal_edges(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Relations written out in code: ``(source, target, type, weight)`` tuples, the last of a key counts."""
    last = {r[:3]: r for r in rows}
    return spark.createDataFrame(list(last.values()), "source string, target string, type string, weight double")
