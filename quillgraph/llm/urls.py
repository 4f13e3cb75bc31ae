"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything that touches rows is a DataFrame or SQL expression. Features are cut into a few bins, so
the labelled URLs collapse to counts by bin tuple, which are all the training needs; the trees are
fitted to those counts on the driver and scored as a SQL expression.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.lineage import cut

#: Upper ends of each feature's bins; a value above the last is in one more bin.
CUTS = {
    "length": (30, 38, 46, 60),
    "depth": (0, 1, 2, 3),
    "digit_ratio": (0.02, 0.06, 0.10, 0.15),
    "entropy": (3.6, 3.9, 4.2),
    "params": (0, 1, 2),
    "labels": (2, 3),
    "hyphens": (0, 1),
    "suffix_rate": (0.1, 0.35, 0.65, 0.9),
}
#: Unlabelled hosts' suffixes count as this many labelled URLs at the overall rate.
PRIOR = 4.0


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path, both empty if the url is null or has no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, pattern, 2)


def match_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> Column:
    """A struct ``(rule, verdict)`` of the longest rule that fits, else null.

    ``rules`` are (host/path, verdict). A rule fits its host and all subdomains if the path starts
    with the rule's. A host's suffixes look their rules up in a literal map, so the work for a row
    grows with its host's labels and not with the number of rules.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append((slash + rest, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entry = lambda start, rule, verdict: F.struct(F.lit(start).alias("start"), F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
    table = F.create_map(*(x for name, found in sorted(by_host.items()) for x in (F.lit(name), F.array(*(entry(*r) for r in found)))))
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    none = F.array().cast("array<struct<start:string,size:int,rule:string,verdict:string>>")
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), none)))
    fits = F.filter(found, lambda r: F.startswith(F.col(path), r["start"]))
    return F.try_element_at(F.array_sort(F.transform(fits, lambda r: F.struct((-r["size"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))), F.lit(1))


def suffix_of(host: str = "host") -> Column:
    """The last two labels of a host."""
    return F.substring_index(F.col(host), ".", -2)


def _entropy(text: Column) -> Column:
    """Bits a character of the lower-cased text; characters besides letters, digits and common marks count as one."""
    low, n = F.lower(text), F.greatest(F.length(text), F.lit(1))
    known = string.ascii_lowercase + string.digits + "/.:-_?=&#%"
    counts = [F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in known]
    counts.append(F.length(F.translate(low, known, "")))
    total = F.lit(0.0)
    for c in counts:
        total = total + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(F.lit(0.0))
    return total


def features(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features of a url; ``host`` and ``path`` must be there. Null urls are empty ones."""
    text = F.coalesce(F.col(url), F.lit(""))
    size = F.length(text)
    digits = size - F.length(F.translate(text, string.digits, ""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "length": size.cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "digit_ratio": digits / F.greatest(size, F.lit(1)),
            "entropy": _entropy(text),
            "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "labels": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))).cast("double"),
            "hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
            "suffix": suffix_of(),
        }
    )


def _bin(name: str) -> Column:
    out = F.lit(len(CUTS[name]))
    for i, top in reversed(list(enumerate(CUTS[name]))):
        out = F.when(F.col(name) <= top, i).otherwise(out)
    return out.cast("int")


def boost(counts: list[tuple[tuple[int, ...], float, float]], trees: int = 24, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> tuple[float, list]:
    """Logistic gradient-boosted trees on counts ``(bins, negatives, positives)``.

    Returns the prior log-odds and trees: a leaf is a number, a split ``(feature, bin, low, high)``
    sends bins up to ``bin`` low.
    """
    rows = [(b, neg + pos, pos) for b, neg, pos in counts]
    n, pos = sum(r[1] for r in rows), sum(r[2] for r in rows)
    prior = math.log((pos + 0.5) / (n - pos + 1.0))  # nothing known: allow
    if not rows or pos == 0 or pos == n:
        return prior, []
    score, out = [prior] * len(rows), []

    def grow(at: list[int], left: int, grad: list[float], hess: list[float]):
        g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
        best = (1e-6, None)
        for f in range(len(rows[0][0]) if left else 0):
            by: dict[int, list[float]] = {}
            for i in at:
                s = by.setdefault(rows[i][0][f], [0.0, 0.0])
                s[0] += grad[i]
                s[1] += hess[i]
            gl = hl = 0.0
            for b in sorted(by)[:-1]:
                gl, hl = gl + by[b][0], hl + by[b][1]
                gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, b))
        if best[1] is None:
            step = rate * g / (h + l2)
            for i in at:
                score[i] += step
            return step
        f, b = best[1]
        return (f, b, grow([i for i in at if rows[i][0][f] <= b], left - 1, grad, hess), grow([i for i in at if rows[i][0][f] > b], left - 1, grad, hess))

    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        out.append(grow(list(range(len(rows))), depth, [r[2] - r[1] * q for r, q in zip(rows, p, strict=True)], [r[1] * q * (1 - q) for r, q in zip(rows, p, strict=True)]))
    return prior, out


def _as_sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, b, low, high = tree
    return f"CASE WHEN bin_{names[f]} <= {b} THEN {_as_sql(low, names)} ELSE {_as_sql(high, names)} END"


def _prepared(pages: DataFrame, rules: list[tuple[str, str]], url: str, key: str) -> DataFrame:
    """Host, path, what the rules say (``rule``, ``given``) and the binned features but the suffix share, once for all that follows."""
    host, path = host_and_path(url)
    base = pages.select(F.col(key), F.col(url).alias("url")).withColumns({"host": host, "path": path}).withColumn("found", match_rule(rules))
    base = features(base, "url").withColumns({"rule": F.col("found.rule"), "given": F.col("found.verdict")}).drop("found")
    return cut(base.withColumns({f"bin_{n}": _bin(n) for n in CUTS if n != "suffix_rate"}).drop(*(n for n in CUTS if n != "suffix_rate")))


def _scored(base: DataFrame, trains: Column) -> DataFrame:
    """``base`` with ``score``, the trees' probability of ``block``, fitted to the ruled rows that ``trains`` holds for.

    A row's suffix share is that of its suffix's other hosts, so no row sees its own verdict or that
    of a page beside it.
    """
    blocked = (F.col("given") == "block").cast("double")
    known = base.where(F.col("given").isNotNull() & trains)
    overall = known.agg(F.avg(blocked).alias("r")).first()["r"]
    overall = 0.0 if overall is None else overall
    by_host = known.groupBy("suffix", "host").agg(F.sum(blocked).alias("own_b"), F.count("*").alias("own_n"))
    by_suffix = by_host.groupBy("suffix").agg(F.sum("own_b").alias("all_b"), F.sum("own_n").alias("all_n"))
    ready = base.join(by_suffix, "suffix", "left").join(by_host, ["suffix", "host"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    rate = (none("all_b") - none("own_b") + PRIOR * overall) / (none("all_n") - none("own_n") + PRIOR)
    ready = ready.withColumn("suffix_rate", rate).withColumn("bin_suffix_rate", _bin("suffix_rate"))
    names = list(CUTS)
    bins = [f"bin_{n}" for n in names]
    counted = ready.where(F.col("given").isNotNull() & trains).groupBy(*bins).agg(F.count("*").alias("n"), F.sum(blocked).alias("b")).orderBy(*bins)
    rows = [(tuple(r[b] for b in bins), r["n"] - r["b"], r["b"]) for r in counted.collect()]  # at most `most_rows()`
    prior, trees = boost(rows)
    logit = F.expr(" + ".join([f"{prior!r}D", *(f"({_as_sql(t, names)})" for t in trees)]))
    return ready.withColumn("score", 1 / (1 + F.exp(-logit)))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id") -> DataFrame:
    """``(key, host, path, rule, verdict, score)`` for every row.

    URLs that a rule fits get its verdict and are the labelled URLs; all of them train the trees, as
    counts by bins. The rest get ``block`` if the trees' probability of it is 0.5 or more. Suffix
    statistics are the share of blocked URLs among the other hosts of a suffix, smoothed towards the
    overall share. Null and empty urls, and urls without ``://``, have empty host and path and are
    judged by the trees; without labelled URLs, or with one label only, the prior decides; rows that
    repeat come out each time; an empty table gives none; other columns are ignored.
    """
    ready = _scored(_prepared(pages, rules, url, key), F.lit(True))
    verdict = F.coalesce("given", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return ready.select(key, "host", "path", "rule", verdict.alias("verdict"), "score")


def held_out_quality(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id", folds: int = 5) -> DataFrame:
    """``(given, said, n)``: of the ruled URLs of every ``folds``-th host, by a hash, what trees say that never saw these hosts."""
    held = F.pmod(F.xxhash64("host"), F.lit(folds)) == 0
    ready = _scored(_prepared(pages, rules, url, key), ~held).where(F.col("given").isNotNull() & held)
    return ready.groupBy("given", F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("said")).agg(F.count("*").alias("n"))


def most_rows() -> int:
    """The number of bin tuples there can be, whatever the input: what training may collect at most."""
    return math.prod(len(c) + 1 for c in CUTS.values())

