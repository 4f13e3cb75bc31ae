"""Windows over message transcripts ``(session_id, idx, role, content, tokens)``. Order is data: ``idx``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered():
    return Window.partitionBy("session_id").orderBy("idx")


def running_tokens(messages: DataFrame) -> DataFrame:
    """Adds ``upto``, the tokens of a session up to and with each message."""
    return messages.withColumn("upto", F.sum("tokens").over(_ordered().rowsBetween(Window.unboundedPreceding, 0)))


def snapshots(messages: DataFrame, shares: list[float], context_window: int = 150000) -> DataFrame:
    """``(session_id, share, idx, tokens)``: the first message at which each share of the window is reached."""
    limits = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.lit(s * context_window).alias("limit")) for s in shares)))
    crossed = running_tokens(messages).withColumn("t", limits).where(F.col("upto") >= F.col("t.limit"))
    return crossed.groupBy("session_id", F.col("t.share").alias("share")).agg(F.min("idx").alias("idx"), F.min("upto").alias("tokens"))


def threshold_cut(messages: DataFrame, threshold: int) -> DataFrame:
    """The messages before the one that reaches ``threshold``; all of a session that never does."""
    return running_tokens(messages).where(F.col("upto") < threshold).drop("upto")


def tail_budget(messages: DataFrame, budget: int) -> DataFrame:
    """The longest run of last messages within ``budget`` tokens."""
    back = Window.partitionBy("session_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("_back", F.sum("tokens").over(back)).where(F.col("_back") <= budget).drop("_back")


def exchange_boundary(messages: DataFrame, n: int) -> DataFrame:
    """``(session_id, keep_from)``: the index of the n-th user message from the end, 0 if there are fewer."""
    back = Window.partitionBy("session_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    users = messages.withColumn("_u", F.count_if(F.col("role") == "user").over(back))
    found = F.max(F.when((F.col("role") == "user") & (F.col("_u") == n), F.col("idx")))
    return users.groupBy("session_id").agg(F.coalesce(found, F.lit(0)).cast("long").alias("keep_from"))


def exchange_boundary_capped(messages: DataFrame, n: int, budget: int) -> DataFrame:
    """As ``exchange_boundary``, but no earlier than after the message whose tokens pass ``budget``, counted from the end."""
    back = Window.partitionBy("session_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    over = messages.withColumn("_t", F.sum("tokens").over(back)).where(F.col("_t") > budget)
    cut = over.groupBy("session_id").agg((F.max("idx") + 1).alias("cut"))
    both = exchange_boundary(messages, n).join(cut, "session_id", "left")
    return both.select("session_id", F.greatest("keep_from", F.coalesce("cut", F.lit(0))).cast("long").alias("keep_from"))


def next_user_assistant(messages: DataFrame) -> DataFrame:
    """For each message: the next user message after it and the next assistant message after that one."""
    after = _ordered().rowsBetween(1, Window.unboundedFollowing)
    turn = messages.withColumn("next_assistant", F.first(F.when(F.col("role") == "assistant", F.col("idx")), ignorenulls=True).over(after))
    pair = F.when(F.col("role") == "user", F.struct(F.col("idx").alias("user_idx"), F.col("next_assistant").alias("assistant_idx")))
    out = turn.withColumn("_p", F.first(pair, ignorenulls=True).over(after))
    return out.select("session_id", "idx", F.col("_p.user_idx").alias("user_idx"), F.col("_p.assistant_idx").alias("assistant_idx"))


def collapse_tool_pairs(messages: DataFrame, is_call=None, longest: int = 500) -> DataFrame:
    """A tool call takes up the result that follows it; the result's row goes, and the rest is numbered anew."""
    call = is_call if is_call is not None else (F.col("role") == "assistant") & F.col("tool_name").isNotNull()
    w = _ordered()
    out = messages.withColumns({"_call": call, "_next_role": F.lead("role").over(w), "_next": F.lead("content").over(w)})
    out = out.withColumn("_eaten", (F.col("role") == "toolResult") & F.coalesce(F.lag("_call").over(w), F.lit(False)))
    joined = F.concat("content", F.lit("\n[result] "), F.substring("_next", 1, longest))
    out = out.withColumn("content", F.when(F.col("_call") & (F.col("_next_role") == "toolResult"), joined).otherwise(F.col("content")))
    out = out.where(~F.col("_eaten"))
    return renumber(out.drop("_call", "_next_role", "_next", "_eaten"))


def renumber(messages: DataFrame) -> DataFrame:
    return messages.withColumn("idx", (F.row_number().over(_ordered()) - 1).cast("long"))


def expand_ranges(ranges: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages with the ``label`` of the range ``(session_id, label, start, end)`` that holds them, ends inclusive."""
    each = ranges.withColumn("idx", F.explode(F.sequence("start", "end"))).select("session_id", "label", "idx")
    return messages.join(each, ["session_id", "idx"])


def joined_text(messages: DataFrame, role: str | None = None) -> DataFrame:
    """Each session's contents in order, as ``[role]: content`` paragraphs, or plain for one ``role``."""
    kept = messages.where(F.col("role") == role) if role else messages
    line = F.col("content") if role else F.concat(F.lit("["), "role", F.lit("]: "), "content")
    parts = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return kept.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("text"))


def totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


def compression(original: DataFrame, folded: DataFrame) -> DataFrame:
    """Tokens of every row before over tokens of every row after, at least 1."""
    a, b = totals(original).select("session_id", F.col("tokens").alias("before")), totals(folded).select("session_id", F.col("tokens").alias("after"))
    return a.join(b, "session_id").withColumn("ratio", F.col("before") / F.greatest("after", F.lit(1)))
