"""Toxic spans and document scores by a linear-chain conditional random field.

Two tags, clean and toxic. A word's features are itself and its first letters; features that tell
toxic documents from clean ones in the labelled sample have weights, all others none. Labels mark
documents, so tokens are labelled in two rounds: first the words of toxic documents that such
features point to, then those that the field so fitted marks among them. Forward-backward marginals
over the whole document give each word's probability of being toxic; their maximum, and their sum
beyond what a document without any such word has, put through a fitted logistic, give the
document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import free_name, raw_text, slices
from quillgraph.plans.lineage import Scratch, cut

WORDS = re.compile(r"[^\W\d_]+")
#: Labelled documents of each class that training reads at most.
SAMPLE = 1500
#: Words on either side of a labelled token that a training window has, and the windows used at most.
SIDE, WINDOWS = 6, 6000
#: A feature is in the model if so many toxic documents have it, and this share of them, and its log-odds are at least this; the strongest so many are.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, FEATURES = 3, 0.005, 2.5, 50_000
#: Words whose weights a worker remembers.
REMEMBERED = 64_000
#: Words after which a stretch without weights is at rest, to the last digit or nearly.
REST = 256


def features(word: str) -> list[str]:
    """A lower-cased word's features: itself and its first four to six letters."""
    out = ["w:" + word]
    out += [f"p{n}:{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return out


class Crf:
    """Weights of a fitted field; plain numbers, so that it is cheap to send to executors."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, start: np.ndarray):
        self.weights, self.bias, self.trans, self.start = weights, bias, trans, start
        self.calibration = (0.0, 0.0, 0.0)

    def word_score(self, word: str) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features(word))

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """P(toxic) of each word; ``scores`` are the words' log-odds without the bias."""
        n = len(scores)
        if n == 0:
            return np.zeros(0)
        step = np.exp(self.trans)
        a, b, c, d = (float(v) for v in step.ravel())
        e = np.exp(np.clip(scores + self.bias, -30, 30)).tolist()
        x, y = math.exp(self.start[0]), math.exp(self.start[1]) * e[0]
        x, y = x / (x + y), y / (x + y)
        forward = [(x, y)]
        for t in range(1, n):
            x, y = x * a + y * c, (x * b + y * d) * e[t]
            s = x + y
            x, y = x / s, y / s
            forward.append((x, y))
        x = y = 0.5
        backward = [(x, y)]
        for t in range(n - 1, 0, -1):
            y2 = y * e[t]
            x, y = a * x + b * y2, c * x + d * y2
            s = x + y
            x, y = x / s, y / s
            backward.append((x, y))
        both = np.array(forward) * np.array(backward[::-1])
        return both[:, 1] / both.sum(axis=1)

    def at_rest(self) -> tuple[float, float]:
        """Of a long document without weighted words: P(toxic) in its middle, and the largest one anywhere."""
        p = self.marginals(np.zeros(2 * REST))
        return float(p[REST]), float(p.max())


class Scores(dict):
    def __init__(self, model: Crf):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = self.model.word_score(word)
        return value


class Judge:
    """What one worker needs to judge texts."""

    def __init__(self, model: Crf):
        self.model, self.known = model, Scores(model)
        self.rest, self.most = model.at_rest()

    def evidence(self, words: list[str]) -> tuple[float, float, list[tuple[int, float]]]:
        """Expected toxic words beyond those of a text without any, the largest marginal, and the words over one half.

        The field is summed over the whole text. Without a weighted word nothing is to be summed: the
        marginals are those at rest.
        """
        scores = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        if not scores.any():
            return 0.0, self.most if words else 0.0, []
        p = self.model.marginals(scores)
        return max(0.0, float((p - self.rest).sum())), float(p.max()), [(int(i), float(p[i])) for i in np.flatnonzero(p > 0.5)]

    def text(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        """The score of a text, and its toxic words."""
        total, most, hits = self.evidence(words_of(text))
        return score(self.model, total, most), hits


def words_of(text: str) -> list[str]:
    """Lower-cased words; the text itself is cut, since lower-casing may change its length."""
    return [w.lower() for w in WORDS.findall(text)]


def score(model: Crf, total: float, most: float) -> float:
    a, b, c = model.calibration
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * most + c * math.log1p(total)))))


def odds_of(seen: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Log-odds of the features, given as ``(feature, toxic documents, clean documents)``, that tell the classes apart."""
    odds = {}
    for f, c1, c0 in seen:
        if c1 >= max(LEAST_DOCS, LEAST_SHARE * n1) and c0 * 8 <= c1:
            value = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))
            if value >= LEAST_ODDS:
                odds[f] = value
    return {f: odds[f] for f in sorted(odds, key=lambda f: (-odds[f], f))[:FEATURES]}


Window = tuple[list[str], list[int]]


def windows_of(words: list[str], toxic: bool, index, rng: np.random.Generator) -> list[Window]:
    """Every marked word of a toxic document with its neighbours, and three places of a clean one."""
    marks = [int(toxic and any(f in index for f in features(w))) for w in words]
    at = np.flatnonzero(marks).tolist() if toxic else rng.integers(0, max(1, len(words)), 3).tolist()
    return [(words[max(0, i - SIDE) : i + SIDE + 1], marks[max(0, i - SIDE) : i + SIDE + 1]) for i in at]


def train(windows: list[Window], index: dict[str, int]) -> Crf:
    """The field fitted to the windows, then once more to the tags that it gives marked words."""
    theta = _ascend(windows, index, None)
    model = _model(theta, index)
    again = []
    for words, marks in windows:
        if any(marks):
            p = model.marginals(np.array([model.word_score(w) for w in words]))
            best = max(p[i] for i, m in enumerate(marks) if m)
            marks = [int(m and (p[i] > 0.5 or p[i] == best)) for i, m in enumerate(marks)]
        again.append((words, marks))
    return _model(_ascend(again, index, theta), index)


def _model(theta: np.ndarray, index: dict[str, int]) -> Crf:
    n = len(index)
    return Crf({f: float(theta[i]) for f, i in index.items()}, float(theta[n + 1]), theta[n + 2 : n + 6].reshape(2, 2), theta[n + 6 :])


def _ascend(windows: list[Window], index: dict[str, int], theta: np.ndarray | None, rounds: int = 120) -> np.ndarray:
    """Gradient ascent on the windows' conditional log-likelihood, by forward-backward sums, with a small ridge."""
    n, size = len(index), len(windows)
    span, most = 2 * SIDE + 1, 4
    feats, tags, mask = np.full((size, span, most), n), np.zeros((size, span), int), np.zeros((size, span), bool)
    for r, (words, marks) in enumerate(windows):
        for t, w in enumerate(words):
            own = [index[f] for f in features(w) if f in index][:most]
            feats[r, t, : len(own)] = own
        tags[r, : len(words)], mask[r, : len(words)] = marks, True
    theta = np.zeros(n + 1 + 1 + 4 + 2) if theta is None else theta  # weights, padding, bias, transitions, start
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, rounds + 1 if size else 1):
        w, bias, trans, start = theta[: n + 1].copy(), theta[n + 1], theta[n + 2 : n + 6].reshape(2, 2), theta[n + 6 :]
        w[n] = 0
        emit = np.zeros((size, span, 2))
        emit[:, :, 1] = np.where(mask, w[feats].sum(axis=2) + bias, 0)
        step = np.exp(trans)
        e = np.exp(np.clip(emit, -30, 30))
        alpha, beta = np.zeros((size, span, 2)), np.ones((size, span, 2))
        alpha[:, 0] = np.exp(start) * e[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, span):
            go = (alpha[:, t - 1] @ step) * e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], go / go.sum(axis=1, keepdims=True), alpha[:, t - 1])
        for t in range(span - 1, 0, -1):
            back = (beta[:, t] * e[:, t]) @ step.T
            beta[:, t - 1] = np.where(mask[:, t, None], back / back.sum(axis=1, keepdims=True), beta[:, t])
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        grad = np.zeros_like(theta)
        diff = np.where(mask, tags - post[:, :, 1], 0)
        grad[: n + 1] = np.bincount(feats.ravel(), weights=np.repeat(diff.ravel(), most), minlength=n + 1)
        grad[n] = 0
        grad[n + 1] = diff.sum()
        pair = np.zeros((2, 2))
        for t in range(1, span):
            joint = alpha[:, t - 1, :, None] * step[None] * (e[:, t] * beta[:, t])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            joint[~mask[:, t]] = 0
            pair -= joint.sum(axis=0)
            ok = mask[:, t]
            np.add.at(pair, (tags[ok, t - 1], tags[ok, t]), 1)
        grad[n + 2 : n + 6] = pair.ravel()
        first = np.array([(tags[:, 0] == 0).sum(), (tags[:, 0] == 1).sum()]) - post[:, 0].sum(axis=0)
        grad[n + 6 :] = first
        grad = grad / max(size, 1) - 1e-3 * theta
        moment, second = 0.9 * moment + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta + 0.15 * (moment / (1 - 0.9**it)) / (np.sqrt(second / (1 - 0.999**it)) + 1e-8)
    return theta


def calibrated(model: Crf, rows: list[tuple[float, float, int]]) -> Crf:
    """The model with its logistic fitted to ``(total, largest marginal, toxic)`` of the sample's documents."""
    model.calibration = _logistic(np.array([(1.0, most, math.log1p(total), float(toxic)) for total, most, toxic in rows] or [(1.0, 0.0, 0.0, 0.0)]))
    return model


def fit(toxic: list[str], clean: list[str], seed: int = 7) -> Crf:
    """The field and its calibration, fitted to texts of either class in this process; ``learn`` does so on a table."""
    docs, rng = [(words_of(t), k) for k, texts in ((1, toxic), (0, clean)) for t in texts], np.random.default_rng(seed)
    seen = Counter((f, k) for words, k in docs for f in {f for w in set(words) for f in features(w)})
    odds = odds_of([(f, seen[f, 1], seen[f, 0]) for f in {f for f, k in seen if k}], len(toxic), len(clean))
    index = {f: i for i, f in enumerate(sorted(odds))}
    windows = [w for words, k in docs for w in windows_of(words, bool(k), index, rng)]
    if len(windows) > WINDOWS:
        windows = [windows[i] for i in rng.permutation(len(windows))[:WINDOWS]]
    model = train(windows, index)
    judge = Judge(model)
    return calibrated(model, [(*judge.evidence(words)[:2], k) for words, k in docs])


def _logistic(rows: np.ndarray) -> tuple[float, float, float]:
    """A damped Newton fit with a small ridge; each class has half the weight."""
    x, y = rows[:, :3], rows[:, 3]
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-3 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -5, 5)
    return tuple(float(b) for b in beta)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept for testing: crc32 of its key as text is a multiple of five. Rows without a key are."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``sample`` toxic and as many clean training documents, by a hash of their id.

    Ids labelled both ways train neither class; of several texts of an id the one of least hash trains.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most and toxic in (0, 1)")
    pick = lambda k: usable.where(F.col("toxic") == k).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = cut(pick(1).unionAll(pick(0)))  # a bounded number of ids, so broadcast
    got = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return got.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))


def training_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts of the sample's toxic and clean documents, for ``fit``; ``learn`` leaves them on the executors."""
    rows = _sample(docs, labels, sample).orderBy("doc_id").collect()
    return [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Crf:
    """The field and its calibration, fitted to a bounded sample of the labelled training documents.

    Only rows whose crc32 of the id as text is not a multiple of five train. Features are counted,
    windows cut and documents summed where the texts are; ``FEATURES`` counts, ``WINDOWS`` windows
    and two numbers a sampled document come to the driver. No labels make a field that marks nothing.
    """
    with Scratch(docs.sparkSession) as scratch:
        taken = scratch.keep(_sample(docs, labels, sample).repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id"))
        raw = taken.select("doc_id", "toxic", raw_text().alias("raw"))
        sizes = {r["toxic"]: r["count"] for r in taken.groupBy("toxic").count().collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

        def own_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 32):
                toxic, found = [], []
                for k, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    own = {f for w in set(words_of(x.as_py().decode("utf-8", "replace"))) for f in features(w)}
                    found += own
                    toxic += [k] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(found, pa.string())], ["toxic", "feature"])

        counted = raw.mapInArrow(own_features, "toxic int, feature string").groupBy("feature").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
        value = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
        telling = counted.where((F.col("c1") >= max(LEAST_DOCS, LEAST_SHARE * n1)) & (F.col("c0") * 8 <= F.col("c1")) & (value >= LEAST_ODDS - 1e-9))
        rows = telling.orderBy(F.round(value, 9).desc(), "feature").limit(FEATURES).collect()
        odds = odds_of([(r["feature"], r["c1"], r["c0"]) for r in rows], n1, n0)
        index = {f: i for i, f in enumerate(sorted(odds))}
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(index))

        def own_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 32):
                words, marks = [], []
                for k, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    text = x.as_py().decode("utf-8", "replace")
                    for w, m in windows_of(words_of(text), k == 1, sent.value, np.random.default_rng([seed, zlib.crc32(text.encode())])):
                        words.append(w)
                        marks.append(m)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32()))], ["words", "marks"])

        windows = raw.mapInArrow(own_windows, "words array<string>, marks array<int>")
        windows = windows.orderBy(F.xxhash64("words", "marks"), "words").limit(WINDOWS).collect()
        model = train([(list(r["words"]), list(r["marks"])) for r in windows], index)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = Judge(model)
            for batch in slices(batches, 32):
                found = [judge.evidence(words_of(x.as_py().decode("utf-8", "replace")))[:2] for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.float64()), pa.array([m for _, m in found], pa.float64()), batch.column(1)], ["total", "most", "toxic"])

        rows = raw.mapInArrow(sums, "total double, most double, toxic int").collect()
        return calibrated(model, sorted((r["total"], r["most"], r["toxic"]) for r in rows))


def judge(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """``(key, score, predicted, spans)`` for every row; spans are ``(start, end, probability)`` in code points of the text.

    Null, empty and wordless texts have no evidence and get the lowest score. Texts are read whole.
    Rows that repeat come out each time; an empty table gives none; other columns are ignored.
    """
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(model)
        for batch in slices(batches):
            scores, spans = [], []
            for x in batch.column(1):
                body = x.as_py().decode("utf-8", "replace")
                value, hits = own.text(body)
                scores.append(value)
                found = []
                if with_spans and hits:
                    wanted = dict(hits)
                    for i, m in enumerate(WORDS.finditer(body)):
                        if i in wanted:
                            found.append({"start": m.start(), "end": m.end(), "probability": wanted[i]})
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, span_type)],
                [key, "score", "predicted", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, raw_text(text).alias("raw")).mapInArrow(
        run, f"{key} {kind}, score double, predicted int, spans array<struct<start:bigint,end:bigint,probability:double>>"
    )


def clean(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with their columns, in one narrow pass.

    Null, empty and wordless texts stay; rows without a key and repeated rows are judged like any
    other; an empty table gives none; columns of any name are kept.
    """
    raw = free_name(docs, "_raw_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(model)
        for batch in slices(batches):
            keep = [own.text(x.as_py().decode("utf-8", "replace"))[0] < 0.5 for x in batch.column(batch.num_columns - 1)]
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(raw, raw_text(text)).mapInArrow(run, docs.schema)
