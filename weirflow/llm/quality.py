"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

The model is logistic over two kinds of features of the whole text: statistics (shares of letter cases, digits
and marks, lengths, repetition) and hashed trigrams of character shapes. It learns from trusted positives
(labels.quality = 1) and unlabelled documents only; negatives are never read. The class prior, the share of
positives in unlabelled text, is estimated by best-bin estimation (Garg et al., "Mixture proportion estimation
and PU learning", 2021): a first classifier of positives against unlabelled scores all documents that it hasn't learned from and
that aren't held out, and counts of scores decide. The risk is that of Kiryo et al. ("Positive-unlabeled learning with
non-negative risk estimator", 2017).

The fit reads a bounded sample: `most_positive` and `most_unlabelled` documents are expected in it, those whose keyed hash of the id
is below a threshold, and more are cut off. The prior and the scores are of every text in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the labelled and unlabelled samples that the fit reads.
MOST_POSITIVE, MOST_UNLABELLED = 6_000, 12_000
CUT = 0.3
#: Texts that have their features in memory at once, and bytes of them.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20
#: Counts of scores are by steps of this width of the margin.
STEP = 0.02
SHAPES, STATS = 512, 20
_CLASSES = 40
_LETTER, _UPPER, _DIGIT, _SPACE, _LINE = 0, 1, 2, 3, 4


def _shape_table() -> np.ndarray:
    """The shape of each byte of UTF-8: letters, digits and blanks fold together, marks keep a shape each."""
    shape = np.zeros(256, "int64")
    marks = 0
    for b in range(128):
        c = chr(b)
        if c.isupper():
            shape[b] = _UPPER
        elif c.isdigit():
            shape[b] = _DIGIT
        elif c == "\n":
            shape[b] = _LINE
        elif c.isspace() or b < 32 or b == 127:
            shape[b] = _SPACE
        elif not c.isalpha():
            shape[b] = 5 + marks
            marks += 1
    assert 5 + marks <= _CLASSES
    return shape


_SHAPE = _shape_table()


def features(text: str | None) -> np.ndarray:
    """The feature row of one text, all in about 0 to 1; an empty one has only the bias."""
    out = np.zeros(STATS + SHAPES, "float32")
    out[0] = 1
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), "uint8")
    if not len(raw):
        return out
    shape = _SHAPE[raw]
    n = len(shape)
    count = np.bincount(shape, minlength=_CLASSES)
    letters = count[_LETTER] + count[_UPPER]
    blank = (shape == _SPACE) | (shape == _LINE)
    ends = np.flatnonzero(np.append(~blank[:-1] & blank[1:], not blank[-1]))
    words = max(1, len(ends))
    runs = (shape[1:] == shape[:-1]) & (shape[1:] >= 5)
    out[1] = count[_UPPER] / max(1, letters)
    out[2] = letters / n
    out[3] = count[_DIGIT] / n
    out[4] = count[5:].sum() / n
    out[5] = min(1.0, count[5:].sum() / words)
    out[6] = min(1.0, n / words / 20)
    out[7] = min(1.0, words / max(1, count[_LINE] + 1) / 200)
    out[8] = count[_LINE] / n * 10
    out[9] = runs.sum() / n
    out[10] = min(1.0, np.log1p(n) / 12)
    out[11] = min(1.0, words / 20)
    tokens = text.split()
    parts = [tokens[i : i + 400] for i in range(0, len(tokens), 400)]  # a share of distinct words that doesn't fall with length
    out[12] = np.mean([len(set(x)) / len(x) for x in parts]) if parts else 0
    lines = text.split("\n")
    out[13] = len(set(lines)) / len(lines)
    out[14] = (raw >= 128).sum() / n
    end = shape[ends] if len(ends) else shape[:0]
    out[15] = (end >= 5).mean() if len(end) else 0
    out[16] = max(count[5:]) / max(1, count[5:].sum())
    out[17] = (count[_UPPER] / max(1, letters)) > 0.5
    out[18] = min(1.0, 5 * runs.sum() / words)
    out[19] = min(1.0, max(map(len, tokens), default=0) / 60)
    if n >= 3:
        code = (shape[:-2] * _CLASSES + shape[1:-1]) * _CLASSES + shape[2:]
        grams = np.bincount((code * 2654435761 >> 7) % SHAPES, minlength=SHAPES)
        out[STATS:] = np.sqrt(grams / (n - 2))
    return out


@dataclass(frozen=True)
class Model:
    """Weights over the features; prior is the estimated share of positives."""

    weights: np.ndarray
    prior: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        rows = np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, STATS + SHAPES), "float32")
        return np.clip(rows @ self.weights, -30, 30)

    def score(self, texts: pd.Series) -> pd.Series:
        return pd.Series(_sigmoid(self.margins(list(texts))), dtype="float64")


def _descend(gradient, width: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def first_classifier(positive: np.ndarray, unlabelled: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Weights of positives against unlabelled rows."""

    def gradient(w: np.ndarray) -> np.ndarray:
        return -(positive.T @ _sigmoid(-(positive @ w))) / len(positive) + unlabelled.T @ _sigmoid(unlabelled @ w) / len(unlabelled) + 2 * penalty * w

    return _descend(gradient, positive.shape[1], steps=200)


def best_bin(positive: np.ndarray, margins: np.ndarray, counts: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from margins of positives and counts of unlabelled rows by margin, in order.

    Of all thresholds the one whose upper confidence bound of (share of unlabelled at or above it) / (share of positives at or
    above it) is least decides.
    """
    if not len(positive) or not counts.sum():
        return 0.5
    p, n = np.sort(positive), counts.sum()
    at = np.unique(p)
    above = np.append(np.cumsum(counts[::-1])[::-1], 0)
    share_p = 1 - np.searchsorted(p, at, "left") / len(p)
    share_u = above[np.searchsorted(margins, at, "left")] / n
    width = np.sqrt(np.log(4 / delta) / 2 / n) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    best = np.argmin((share_u + width) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, penalty: float = 1e-4, delta: float = 0.1) -> float:
    """Best-bin estimate from rows in memory: every other one trains the first classifier, the rest is counted."""
    w = first_classifier(positive[::2], unlabelled[::2], penalty)
    u = np.sort(unlabelled[1::2] @ w)
    return best_bin(positive[1::2] @ w, u, np.ones(len(u)), delta)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, penalty: float = 1e-5) -> Model:
    """Minimise prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)]) + penalty * |w|^2."""
    prior = estimate_prior(positive, unlabelled) if prior is None else prior

    def gradient(w: np.ndarray) -> np.ndarray:
        fp, fu = positive @ w, unlabelled @ w
        toward = -(positive.T @ _sigmoid(-fp)) / len(fp)  # of E_P[loss(f)]
        away_p, away_u = positive.T @ _sigmoid(fp) / len(fp), unlabelled.T @ _sigmoid(fu) / len(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        rest = away_u - prior * away_p
        return prior * toward + (rest if negative >= 0 else -rest) + 2 * penalty * w

    return Model(_descend(gradient, positive.shape[1]), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id counts as an empty text, whose checksum is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """SLICE_ROWS texts of about SLICE_BYTES at most, or one."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES, "right"))
        end = min(max(start + 1, end), start + SLICE_ROWS)
        yield texts.slice(start, end - start)
        start = end


def _by_slices(kind: str, each) -> Column:
    """An Arrow UDF that maps a list of texts to an array, a slice at a time."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([each(part.to_pylist()) for part in _slices(texts)]) if len(texts) else each([])

    return run


def _chosen(seed: int, share: float) -> Column:
    """A keyed hash of the id is below that share of its range."""
    return F.xxhash64("doc_id", F.lit(seed)) < F.lit(int(share * 2**64) - 2**63 if share < 1 else 2**63 - 1)


def _first_half() -> Column:
    """Rows that the first classifier learns from, if they are in the sample."""
    return F.xxhash64("doc_id", F.lit(3)) % 2 == 0


def _sample(rows: DataFrame, seed: int, share: float, most: int) -> tuple[DataFrame, float]:
    """Rows whose ids are chosen, and the share of ids: halved until there are twice `most` rows at most, as few ids may have many rows."""
    while share > 2**-60:
        chosen = rows.where(_chosen(seed, share))
        if chosen.count() <= 2 * most:
            return chosen, share
        share /= 2
    return rows.limit(0), 0.0


def _matrix(rows: DataFrame, seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows, which are of the first half) of a sample's rows, in order of the hash they were chosen by and features; `most` at most."""
    packed = _by_slices("binary", lambda texts: pa.array([features(t).tobytes() for t in texts], pa.binary()))
    got = rows.select(F.xxhash64("doc_id", F.lit(seed)).alias("by"), "doc_id", _first_half().alias("half"), packed("text").alias("x")).toArrow()
    got = got.sort_by([(c, "ascending") for c in ("by", "doc_id", "x")]).slice(0, most).combine_chunks()
    if not len(got):
        return np.zeros((0, STATS + SHAPES)), np.zeros(0, bool)
    x = got["x"].chunk(0)
    first = np.frombuffer(x.buffers()[1], "int32")[x.offset]  # features lie one row after the other
    x = np.frombuffer(x.buffers()[2], "float32", len(got) * (STATS + SHAPES), int(first)).reshape(len(got), -1).astype("float64")
    return x, got["half"].to_numpy().astype(bool)


def _margin_counts(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins in order, rows with each) over all rows, from one aggregation: 60 / STEP values at most."""
    shared = rows.sparkSession.sparkContext.broadcast(Model(weights, 0.5))
    step = _by_slices("int", lambda texts: pa.array(np.floor(shared.value.margins(texts) / STEP).astype("int32")))
    got = sorted(tuple(r) for r in rows.select(step("text").alias("step")).groupBy("step").count().collect())
    return np.array([s * STEP for s, _ in got]), np.array([n for _, n in got], "int64")


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """The model of these documents and labels; without positives or documents to learn from, one that scores 0.5."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    known, _ = _sample(trusted, 1, most_positive / max(1, trusted.count()), most_positive)
    chosen, _ = _sample(docs.join(F.broadcast(known), "doc_id", "left_semi"), 1, 1.0, most_positive)
    positive, first_p = _matrix(chosen, 1, most_positive)
    chosen, share = _sample(docs, 2, most_unlabelled / max(1, docs.count()), most_unlabelled)
    unlabelled, first_u = _matrix(chosen, 2, most_unlabelled)
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(np.zeros(STATS + SHAPES), 0.5)
    if not (first_p.any() and first_u.any()):
        return fit_pu(positive, unlabelled, 0.5)
    w = first_classifier(positive[first_p], unlabelled[first_u])
    margins, counts = _margin_counts(docs.where(~(_chosen(2, share) & _first_half())), w)
    prior = best_bin(np.floor(np.clip(positive[~first_p] @ w, -30, 30) / STEP) * STEP, margins, counts)
    return fit_pu(positive, unlabelled, prior)


def score_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The score of a text, as a column; the model's few kilobytes go to executors by broadcast."""
    shared = spark.sparkContext.broadcast(model)
    scored = _by_slices("double", lambda texts: pa.array(_sigmoid(shared.value.margins(texts)), pa.float64()))
    return scored(F.col(f"`{text}`").cast("string"))


def score_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of the bias alone. Rows that repeat an id are each scored by their own
    text. Labels of ids that aren't among the documents, null labels and repeated labels do no harm.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns, whatever their names.

    Null and empty texts go by the score of the bias alone; repeated rows share their fate; an empty table stays empty.
    """
    model = fit(docs, labels)
    return docs.where(score_column(docs.sparkSession, model) >= CUT)
