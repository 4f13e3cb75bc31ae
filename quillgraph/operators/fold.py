"""Folding transcripts: strategies, models and judges by name, and the stateful replay.

A strategy takes a session's messages (dicts, in order) and options and returns ``(folded, plan)``.
Models and judges are functions behind small registries; those that come along work offline and
deterministically, so that plans can be tested without a remote service.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

# The role of a summary, how its rows and a collapsed result are told, and how much of a long text a model is shown.
SUMMARY_ROLE = "compactionSummary"
TOPIC_ROW = "[topic: {name}] {summary}"
STATUS_ROW = "[{status}-topic] {name}: {summary}"
PENDING_ROW = "[pending-action] User requested: {request}\nAssistant state: {state}"
RESULT_ROW = "{call}\n[result] {result}"
RESULT_SHOWN, TEXT_LIMIT, TEXT_SHOWN, TEXT_MARK = 500, 2000, 1500, "...[truncated]"

MESSAGE_SCHEMA = "session_id string, idx long, role string, content string, tokens long"


def tokens_of(text: str) -> int:
    return math.ceil(len(text) / 4) + 10


def summary_row(text: str) -> dict:
    return {"role": SUMMARY_ROLE, "content": text, "tokens": tokens_of(text)}


# --- models -----------------------------------------------------------------------------------------------------------


def extractive_model(system: str, user: str) -> dict:
    """An offline stand-in: the first sentence of every message that it is shown, as JSON topics and groups."""
    lines = re.findall(r"(?m)^\[(\d+)\] ([^:\n]*): (.*)$", user)
    first = lambda t: re.split(r"(?<=[.!?])\s", t.strip(), maxsplit=1)[0][:120]
    n = len(lines)
    half = max(1, n // 2)
    summary = lambda part: " ".join(first(t) for _, _, t in part)[:600]
    asked = next((t for _, role, t in reversed(lines) if role == "user"), "unknown")
    said = next((t for _, role, t in reversed(lines) if role == "assistant"), "unknown")
    reply = {
        "topics": [
            {"name": "earlier", "range": [0, half - 1], "status": "completed", "summary": summary(lines[:half])},
            {"name": "current", "range": [half, max(half, n - 1)], "status": "active", "summary": summary(lines[half:])},
        ],
        "groups": [{"range": [0, half - 1], "summary": summary(lines[:half])}, {"range": [half, max(half, n - 1)], "summary": summary(lines[half:])}],
        "pendingAction": {"lastUserRequest": first(asked), "assistantState": first(said)},
    }
    text = json.dumps(reply)
    return {"text": text, "tokens_in": math.ceil((len(system) + len(user)) / 4), "tokens_out": math.ceil(len(text) / 4)}


def dry_run_model(system: str, user: str) -> dict:
    """Calls nothing: tells the sizes, counts the input and 100 tokens out."""
    return {"text": f"[dry-run] {len(system)} system chars, {len(user)} user chars", "tokens_in": math.ceil((len(system) + len(user)) / 4), "tokens_out": 100}


MODELS: dict[str, Callable[[str, str], dict]] = {"extractive": extractive_model, "dry-run": dry_run_model}


def extract_json(text: str):
    """JSON from a reply: as it is, without code fences, from the widest braces or brackets; else None."""
    bare = re.sub(r"(?m)^```[a-z]*\s*|```\s*$", "", text or "").strip()
    for part in (bare, *(m[0] for p in (r"\{.*\}", r"\[.*\]") if (m := re.search(p, bare, re.S)))):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


# --- strategies -------------------------------------------------------------------------------------------------------


def keep_from(messages: list[dict], n: int, budget: int | None) -> int:
    """Where the verbatim tail starts: the n-th user message from the end, or sooner where a budget is passed."""
    seen, total = 0, 0
    for i in range(len(messages) - 1, -1, -1):
        total += messages[i]["tokens"]
        if budget and total > budget:
            return i + 1
        seen += messages[i]["role"] == "user"
        if messages[i]["role"] == "user" and seen == n:
            return i
    return 0


def _shown(messages: list[dict], cut: Callable[[dict], str]) -> str:
    return "\n".join(f"[{i}] {m['role']}: {cut(m)}".replace("\n", " ") for i, m in enumerate(messages))


def _clip(text: str, size: int, keep: int, end: str) -> str:
    return text if len(text) <= size else text[:keep] + end


def _noop(messages: list[dict], reason: str) -> tuple[list[dict], dict]:
    return messages, {"action": "noop", "reason": reason, "tokens_in": 0, "tokens_out": 0}


def _used(plan: dict, reply: dict) -> dict:
    return plan | {"tokens_in": reply["tokens_in"], "tokens_out": reply["tokens_out"]}


def topic_segmentation(messages: list[dict], model, min_topic: int = 3, **_) -> tuple[list[dict], dict]:
    """Completed topics become one summary row each, the active topic stays word for word."""
    if len(messages) < 2 * min_topic:
        return _noop(messages, "too few messages")
    reply = model("Find the topics; summarise the completed ones. JSON.", _shown(messages, lambda m: _clip(m["content"], 200, 150, "...")))
    found = extract_json(reply["text"])
    if not isinstance(found, dict) or "topics" not in found:
        return messages, _used({"action": "parse-error"}, reply)
    out: list[dict] = []
    for t in found["topics"]:
        if t["status"] == "active":
            out += messages[t["range"][0] : min(t["range"][1], len(messages) - 1) + 1]
        else:
            out.append(summary_row(TOPIC_ROW.format(name=t["name"], summary=t["summary"])))
    return out, _used({"action": "topic-segmentation", "topics": len(found["topics"])}, reply)


def unified(messages: list[dict], model, keep_recent: int = 5, max_keep_tokens: int | None = None, **_) -> tuple[list[dict], dict]:
    """Everything before the tail, tool output included, becomes grouped summaries."""
    at = keep_from(messages, keep_recent, max_keep_tokens)
    if at <= 2:
        return _noop(messages, "too few messages")

    def cut(m: dict) -> str:
        size, text = (2000 if m["role"] == "toolResult" else 300), m["content"]
        return text if len(text) <= size else f"{text[: int(size * 0.7)]}\n...[{len(text)} chars]...\n{text[-int(size * 0.2) :]}"

    reply = model("Group related messages and summarise each group. JSON.", _shown(messages[:at], cut))
    found = extract_json(reply["text"])
    groups = found["groups"] if isinstance(found, dict) and "groups" in found else [{"range": [0, at - 1], "summary": reply["text"]}]
    rows = [{"role": "compactionSummary", "content": f"[fold:{g['range'][0]}-{g['range'][1]}] {g['summary']}", "tokens": tokens_of(g["summary"])} for g in groups]
    return rows + messages[at:], _used({"action": "unified-folding", "groups": len(groups), "summarized": at, "kept": len(messages) - at}, reply)


def collapse_pairs(messages: list[dict]) -> list[dict]:
    """A tool call and the result after it as one row."""
    out: list[dict] = []
    for m in messages:
        if m["role"] == "toolResult" and out and out[-1]["role"] == "assistant" and out[-1].get("tool_name"):
            text = RESULT_ROW.format(call=out[-1]["content"], result=m["content"][:RESULT_SHOWN])
            out[-1] = out[-1] | {"content": text, "tokens": tokens_of(text)}
        else:
            out.append(m)
    return out


def topic_constrained(messages: list[dict], model, keep_recent: int = 5, max_keep_tokens: int | None = None, budget_cap: int | None = None, previous: str | None = None, **_) -> tuple[list[dict], dict]:
    """Topic summaries within a quarter of the input's tokens, the pending action, then the tail.

    ``budget_cap`` bounds the budget whatever the input, and ``previous`` is an earlier summary to
    carry on, so that repeated folds do not grow.
    """
    at = keep_from(messages, keep_recent, max_keep_tokens)
    if at <= 2:
        return _noop(messages, "too few messages")
    size = sum(m["tokens"] for m in messages[:at])
    budget = min(math.floor(size * 0.25 + 0.5), budget_cap or math.inf)
    shown = _shown(collapse_pairs(messages[:at]), lambda m: _clip(m["content"], TEXT_LIMIT, TEXT_SHOWN, TEXT_MARK))
    reply = model(f"Segment into topics and compress to {budget} tokens. JSON.", (f"Previous summary: {previous}\n" if previous else "") + shown)
    found = extract_json(reply["text"])
    if not isinstance(found, dict) or not isinstance(found.get("topics"), list):
        return messages, _used({"action": "parse-error"}, reply)
    rows = [summary_row(STATUS_ROW.format(status="active" if t["status"] == "active" else "completed", name=t["name"], summary=t["summary"])) for t in found["topics"]]
    if found.get("pendingAction"):
        p = found["pendingAction"]
        rows.append(summary_row(PENDING_ROW.format(request=p.get("lastUserRequest") or "unknown", state=p.get("assistantState") or "unknown")))
    done = sum(t["status"] == "completed" for t in found["topics"])
    plan = {"action": "topic-constrained", "topics": len(found["topics"]), "completed": done, "active": sum(t["status"] == "active" for t in found["topics"]), "budget": budget}
    return rows + messages[at:], _used(plan, reply)


def topic_bounded(messages: list[dict], model, **options) -> tuple[list[dict], dict]:
    return topic_constrained(messages, model, budget_cap=10000, **options)


STRATEGIES = {"s3": topic_segmentation, "s5": unified, "s9": topic_constrained, "s9-v3": topic_bounded}


# --- judges -----------------------------------------------------------------------------------------------------------


def overlap_judge(summary: str, original: str) -> float:
    """An offline stand-in for a rating of 1 to 5: how many of the original's long words the summary has."""
    words = lambda t: {w for w in re.findall(r"\w+", t.lower()) if len(w) > 4}
    there = words(original)
    return 1.0 + 4.0 * (len(there & words(summary)) / len(there) if there else 0.0)


JUDGES = {"overlap": overlap_judge}


def evaluate(context: list[dict], user: str, original: str, responder=None, judge=overlap_judge) -> dict:
    """How well a folded context serves the next request: an answer is made from it and held against the original one.

    ``responder`` takes ``(system, user)`` as a model does; the stand-in answers with the context's words.
    """
    shown = "\n".join(f"[{m['role']}]: {m['content']}" for m in context)
    answer = responder(shown, user)["text"] if responder else shown
    kept, asked = judge(answer, original), judge(shown, user)
    scores = {"retention": (kept - 1) / 4, "relevance": (asked - 1) / 4, "mean": ((kept - 1) / 4 + (asked - 1) / 4) / 2}
    return scores | {"normalised": scores["mean"] * 4 + 1}


# --- running them on Spark --------------------------------------------------------------------------------------------


def _messages(group: pd.DataFrame) -> list[dict]:
    group = group.sort_values("idx")
    names = [c for c in ("role", "content", "tokens", "tool_name") if c in group]
    return [dict(zip(names, row, strict=True)) for row in group[names].itertuples(index=False)]


def fold_sessions(messages: DataFrame, strategy: str, model: str = "extractive", **options) -> DataFrame:
    """Folded rows of every session, with the plan as JSON on each row. One session is one group, as it must be in order."""
    fold, call = STRATEGIES[strategy], MODELS[model]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, plan = fold(_messages(group), call, **options)
        session = group["session_id"].iloc[0]
        return pd.DataFrame([(session, i, m["role"], m["content"], m["tokens"], json.dumps(plan, sort_keys=True)) for i, m in enumerate(rows)], columns=["session_id", "idx", "role", "content", "tokens", "plan"])

    return messages.groupBy("session_id").applyInPandas(run, MESSAGE_SCHEMA + ", plan string")


def evaluate_folds(messages: DataFrame, budget: int, strategy: str = "s5", model: str = "extractive", **options) -> DataFrame:
    """For each session cut before ``budget`` tokens and folded: scores on the next user message and the answer to it."""
    fold, call = STRATEGIES[strategy], MODELS[model]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, session, total, at = _messages(group), group["session_id"].iloc[0], 0, None
        for i, m in enumerate(rows):
            total += m["tokens"]
            if total >= budget:
                at = i
                break
        found = []
        if at is not None:
            user = next((i for i in range(at, len(rows)) if rows[i]["role"] == "user"), None)
            answer = next((i for i in range(user + 1, len(rows)) if rows[i]["role"] == "assistant"), None) if user is not None else None
            if answer is not None:
                folded, _ = fold(rows[:at], call, **options)
                s = evaluate(folded, rows[user]["content"], rows[answer]["content"])
                found.append((session, at, s["retention"], s["relevance"], s["mean"], s["normalised"]))
        return pd.DataFrame(found, columns=["session_id", "cut", "retention", "relevance", "mean", "normalised"])

    return messages.groupBy("session_id").applyInPandas(run, "session_id string, cut long, retention double, relevance double, mean double, normalised double")


def replay_session(rows: list[dict], threshold: int, fold, call, carried: tuple[list[dict], int] | None = None, carry: bool = False, **options):
    """Append message after message; a buffer of ``threshold`` tokens or more is replaced by its fold.

    With ``carry`` each fold is told the summary that the buffer holds from the fold before.
    Yields ``(turn, before, after, tokens_in, tokens_out)`` and leaves the buffer in ``carried``.
    """
    buffer, turn = carried or ([], 0)
    for m in rows:
        buffer.append(m)
        before = sum(x["tokens"] for x in buffer)
        if before >= threshold:
            if carry:
                options["previous"] = "\n".join(x["content"] for x in buffer if x["role"] == SUMMARY_ROLE) or None
            folded, plan = fold(list(buffer), call, **options)
            buffer[:] = folded
            yield turn, before, sum(x["tokens"] for x in folded), plan["tokens_in"], plan["tokens_out"]
        turn += 1


FOLD_SCHEMA = "session_id string, turn long, before long, after long, tokens_in long, tokens_out long"


def replay(messages: DataFrame, threshold: int, strategy: str = "s5", model: str = "extractive", **options) -> DataFrame:
    """Every fold point of every session; state goes on from fold to fold, so a session is one ordered group."""
    fold, call = STRATEGIES[strategy], MODELS[model]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        session = group["session_id"].iloc[0]
        points = replay_session(_messages(group), threshold, fold, call, ([], 0), **options)
        return pd.DataFrame([(session, *p) for p in points], columns=["session_id", "turn", "before", "after", "tokens_in", "tokens_out"])

    return messages.groupBy("session_id").applyInPandas(run, FOLD_SCHEMA)


def replay_summary(points: DataFrame) -> DataFrame:
    """By session: folds, mean compression, tokens after the last fold, and cost at 1e-5 in and 3e-5 out."""
    from pyspark.sql import functions as F

    return points.groupBy("session_id").agg(
        F.count("*").alias("folds"), F.avg(F.col("before") / F.greatest("after", F.lit(1))).alias("mean_compression"), F.max_by("after", "turn").alias("steady_tokens"),
        F.sum(F.col("tokens_in") * 0.00001 + F.col("tokens_out") * 0.00003).alias("cost_usd"),
    )
