"""Session transcripts: JSON lines with typed entries and content blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "struct<type:string,text:string,name:string,toolName:string,arguments:variant,input:variant,content:variant,output:string,thinking:string>"
ENTRY = "type string, timestamp string, message struct<role:string,content:variant,toolName:string,timestamp:string,summary:string>"


def blocks(content: Column) -> Column:
    """A message's content as an array of blocks; a plain string is one text block."""
    as_text = F.try_variant_get(content, "$", "string")
    as_blocks = F.from_json(F.to_json(content), f"array<{BLOCK}>")
    one = F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), as_text.alias("text")))), f"array<{BLOCK}>")
    return F.when(F.schema_of_variant(content) == "STRING", one).otherwise(as_blocks)


def block_text(found: Column, summary: Column) -> Column:
    """Text blocks joined by line ends, else the summary, else empty."""
    texts = F.filter(found, lambda b: (b["type"] == "text") & b["text"].isNotNull())
    joined = F.array_join(F.transform(texts, lambda b: b["text"]), "\n")
    return F.coalesce(F.nullif(joined, F.lit("")), summary, F.lit(""))


def serialize(found: Column) -> Column:
    """Blocks as text for a judge: calls with up to 500 characters of arguments, results with up to 300."""

    def line(b: Column) -> Column:
        args = F.substring(F.coalesce(F.to_json(F.coalesce(b["arguments"], b["input"])), F.lit("{}")), 1, 500)
        result = F.coalesce(F.try_variant_get(b["content"], "$", "string"), b["output"], b["text"], F.lit(""))
        return (
            F.when(b["type"] == "text", b["text"])
            .when(b["type"].isin("toolCall", "tool_use"), F.concat(F.lit("[tool: "), F.coalesce(b["name"], b["toolName"], F.lit("?")), F.lit("] "), args))
            .when(b["type"].isin("toolResult", "tool_result"), F.concat(F.lit("[result] "), F.substring(result, 1, 300)))
        )

    return F.array_join(F.filter(F.transform(found, line), lambda x: x.isNotNull()), "\n")


def token_estimate(text: Column, found: Column) -> Column:
    """ceil(text / 4) + ceil(call arguments / 4) and ceil(thinking / 4) of each block + 10."""
    size = lambda v: F.ceil(F.coalesce(F.length(F.to_json(v)), F.lit(0)) / 4)

    def extra(b: Column) -> Column:
        call = F.when(b["type"].isin("toolCall", "tool_use"), size(F.coalesce(b["arguments"], b["input"]))).otherwise(0)
        return call + F.when(b["type"] == "thinking", F.ceil(F.coalesce(F.length(b["thinking"]), F.lit(0)) / 4)).otherwise(0)

    more = F.aggregate(F.coalesce(found, F.array().cast(f"array<{BLOCK}>")), F.lit(0).cast("long"), lambda s, b: s + extra(b).cast("long"))
    return (F.ceil(F.length(text) / 4) + more + 10).cast("long")


def parse(lines: DataFrame) -> DataFrame:
    """Messages ``(session_id, idx, role, content, tool_name, ts, tokens)`` from ``(session_id, line_no, line)``.

    Blank and malformed lines and entries that are no messages are skipped; ``idx`` counts messages
    from 0 in the order of lines.
    """
    entry = lines.where(F.trim("line") != "").withColumn("e", F.from_json("line", ENTRY)).where("e.type = 'message' and e.message.role is not null")
    found = entry.withColumn("b", blocks(F.col("e.message.content"))).withColumn("content", block_text(F.col("b"), F.col("e.message.summary")))
    idx = F.row_number().over(Window.partitionBy("session_id").orderBy("line_no")) - 1
    call = F.filter("b", lambda b: b["type"].isin("toolCall", "tool_use"))
    name = F.coalesce("e.message.toolName", F.coalesce(F.try_element_at(call, F.lit(1))["name"], F.try_element_at(call, F.lit(1))["toolName"]))
    return found.select(
        "session_id", idx.cast("long").alias("idx"), F.col("e.message.role").alias("role"), "content", name.alias("tool_name"),
        F.coalesce("e.message.timestamp", "e.timestamp").alias("ts"), token_estimate(F.col("content"), F.col("b")).alias("tokens"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """All ``.jsonl`` files under ``path``; a session is a file, and its lines keep their order."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.jsonl", recursiveFileLookup=True)
    named = files.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.jsonl$", "").alias("session_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return parse(named)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(id, type, notes)`` from a JSON array of sessions or an object with ``sessions``."""
    item = "struct<id:string,type:string,notes:string>"
    whole = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json("value", f"struct<sessions:array<{item}>>")["sessions"], F.from_json("value", f"array<{item}>"))
    return whole.select(F.explode(both).alias("s")).select("s.*")


def with_prefix(rows: DataFrame, prefixes: list[str], session: str = "session_id") -> DataFrame:
    """Rows whose session's name starts with any of the prefixes; no prefixes keep all."""
    if not prefixes:
        return rows
    return rows.where(reduce(Column.__or__, (F.col(session).cast("string").startswith(p) for p in prefixes)))
