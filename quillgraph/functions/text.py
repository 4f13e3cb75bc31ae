"""String functions of the graph and transcript operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword search leaves out of a query.
KEYWORD_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need must "
    "i me my we our you your he she it they them what which who whom this that these those am not no nor so if or and but for of "
    "at by to in on with from up about into through during before after above below between how why when where there here then than "
    "very just also more much some any all each does make makes made get got go went come came happen happened work works worked"
).split()

# Words that query phrasing leaves out.
PHRASING_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for "
    "on with at by from as into through during before after above below between out off over under again further then once here there when "
    "where why how all each every both few more most other some such no nor not only own same so than too very just because but and "
    "or if while about what which who whom this that these those am it its my your his her our their i you he she we they me him us them"
).split()

# US dollars for a million tokens in and out.
PRICING = {
    "gemini-flash": (0.15, 0.60),
    "gemini-3-flash": (0.10, 0.40),
    "gemini-pro": (1.25, 10.00),
    "sonnet": (3.00, 15.00),
    "haiku": (0.80, 4.00),
    "kimi": (0.60, 2.00),
}


def slugify(text: Column, size: int = 60, trim: bool = True) -> Column:
    """Lower case, other characters as one dash; a dash at either end goes before the cut, if ``trim``."""
    out = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(out, "^-|-$", "") if trim else out, 1, size)


def normalise_name(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def truncate_at_word(text: Column, size: int = 150) -> Column:
    """A text over ``size`` loses the word that the cut would break and gets an ellipsis."""
    return F.when(F.length(text) > size, F.concat(F.regexp_replace(F.substring(text, 1, size), r"\s+\S*\z", ""), F.lit("…"))).otherwise(text)


def first_sentence(text: Column, size: int = 150) -> Column:
    """Up to the first sentence end on the first line, else the first ``size`` characters with an ellipsis."""
    text = F.coalesce(text, F.lit(""))
    found = F.trim(F.regexp_extract(text, r"^.*?[.!?](?:\s|\z)", 0))
    return F.when(found != "", found).when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 1), F.lit("…")))


def tokens_ceil(text: Column, extra: int = 10) -> Column:
    """Four characters a token, rounded up, and a fixed cost for a message."""
    return (F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) + extra).cast("long")


def tokens_round(text: Column) -> Column:
    """Four characters a token, half rounded up; message cost and tool calls not counted."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4 + 0.5).cast("long")


def preview_short(text: Column) -> Column:
    return F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 150), F.lit("..."))).otherwise(text)


def preview_head_tail(text: Column, is_tool: Column) -> Column:
    """70 % of the limit from the head and 20 % from the tail; 2000 characters for tool results, else 300."""

    def cut(limit: int) -> Column:
        head, tail = F.substring(text, 1, limit * 7 // 10), F.substring(text, -(limit * 2 // 10), limit * 2 // 10)
        return F.when(F.length(text) > limit, F.concat(head, F.lit("\n...["), F.length(text).cast("string"), F.lit(" chars]...\n"), tail)).otherwise(text)

    return F.when(is_tool, cut(2000)).otherwise(cut(300))


def preview_truncated(text: Column) -> Column:
    return F.when(F.length(text) > 2000, F.concat(F.substring(text, 1, 1500), F.lit("...[truncated]"))).otherwise(text)


def brace_match(text: Column) -> Column:
    """From the first opening brace to the last closing one; empty if there are none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def extract_json(text: Column) -> Column:
    """A reply's JSON as a variant: without code fences, else the widest braces, else the widest brackets, else null."""
    bare = F.trim(F.regexp_replace(text, r"(?m)^```[a-z]*\s*|```\s*$", ""))
    found = [F.try_parse_json(bare)]
    found += [F.try_parse_json(F.nullif(F.regexp_extract(bare, p, 0), F.lit(""))) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.coalesce(*found)


def parse_edge_spec(spec: Column) -> Column:
    """``target:type[:context]``; the context may hold colons."""
    parts = F.split(spec, ":", 3)
    return F.struct(
        parts[0].alias("target"), F.try_element_at(parts, F.lit(2)).alias("type"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")).alias("context")
    )


def query_tokens(query: Column) -> Column:
    """Keyword search tokens: marks as blanks, lower case, two characters or more, no stop words."""
    bare = F.lower(F.regexp_replace(query, r"""['"*(){}\[\]^~\\:]""", " "))
    return F.filter(F.split(bare, r"\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(*KEYWORD_STOP_WORDS))


def phrasings(query: Column) -> Column:
    """The query, its content words, and those in reverse order; at most three, none twice."""
    words = F.split(F.regexp_replace(F.lower(query), r"[^\w\s-]", ""), r"\s+")
    kept = F.filter(words, lambda w: ~w.isin(*PHRASING_STOP_WORDS) & (F.length(w) > 1))
    plain = F.array_join(kept, " ")
    none = F.array().cast("array<string>")
    more = F.when((F.size(kept) >= 2) & (plain != F.lower(F.trim(query))), F.array(plain)).otherwise(none)
    back = F.when(F.size(kept) >= 3, F.array(F.array_join(F.reverse(kept), " "))).otherwise(none)
    return F.array_distinct(F.concat(F.array(query), more, back))


def content_words(text: Column, longer_than: int = 4) -> Column:
    """The different lower-cased words of more than ``longer_than`` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > longer_than))


def js_round(value: Column, digits: int = 0) -> Column:
    """Half rounds towards positive infinity."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """By the price list; unknown models cost 0."""
    rate = lambda at: F.coalesce(F.try_element_at(F.create_map(*(x for m, p in PRICING.items() for x in (F.lit(m), F.lit(p[at])))), model), F.lit(0.0))
    return (tokens_in * rate(0) + tokens_out * rate(1)) / 1e6


def run_id(session: Column, strategy: Column, retained: Column, threshold: Column, model: Column, rep: Column) -> Column:
    """``session8-strategy-R<retained>-T<threshold>[-model]-r<rep>``."""
    return F.concat_ws("-", F.substring(session, 1, 8), strategy, F.concat(F.lit("R"), retained), F.concat(F.lit("T"), threshold), model, F.concat(F.lit("r"), rep))


def event_id(date: Column, at_ms: Column) -> Column:
    """``event-<date>-<last four digits of the time in ms>``."""
    return F.concat(F.lit("event-"), date, F.lit("-"), F.right(at_ms.cast("string"), F.lit(4)))


def hours_since(now_ms: Column, last_accessed: Column, created: Column) -> Column:
    """Hours from the last access, or from creation if there is none (0 counts as none)."""
    return (now_ms - F.coalesce(F.nullif(last_accessed, F.lit(0)), created)) / 3600000.0


def iso_date(at_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(at_ms), "yyyy-MM-dd")


def parse_time(value: str | None, now_ms: int) -> int | None:
    """``6h``, ``3d``, ``2w`` before now, or an ISO date or time, as ms; read once when a plan is built."""
    import datetime as dt
    import re

    if not value:
        return None
    if m := re.fullmatch(r"(\d+)([hdw])", value):
        return now_ms - int(m[1]) * {"h": 3600000, "d": 86400000, "w": 604800000}[m[2]]
    at = dt.datetime.fromisoformat(value)
    return int((at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000)
