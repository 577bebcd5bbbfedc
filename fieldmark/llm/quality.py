"""Operator 11, quality: a regularised quadratic discriminant over document statistics.

Every text becomes ``len(NAMES)`` transformed statistics (logarithms of sizes,
arcsines of shares), in Arrow batches over whole texts.  Counts, sums and outer
products of the statistics are all that a class's mean and covariance need, so
tasks sum them over all labelled rows and the driver adds up a few small
matrices; no row is sampled.  Each class covariance is shrunk towards the pooled
one by ``pool`` and then towards a multiple of the identity by the share of
oracle-approximating shrinkage, which follows from the matrix itself.  A score
is the difference of the classes' Mahalanobis log-densities, by inverses of the
Cholesky factors that the model keeps, put on a logistic scale that is fitted on
a histogram of the differences (``BINS`` bins for each class).

Defined results: null, empty and blank texts get the score of their statistics
(all zero); with one class or no labels at all every score is the smoothed share
of label 1; null labels do not count, a document labelled several times counts
once, as 1 if any of its labels is; rows with a null id have no label; repeated
rows are scored each and count each; extra columns pass through, but for
``statistics``, ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

NAMES = [
    "log_bytes", "log_words", "log_lines", "upper", "digits", "stops", "symbols", "high_bytes", "blanks", "doubled_symbols",
    "word_bytes", "distinct_words", "top_word", "repeated_words", "distinct_pairs", "distinct_lines", "byte_entropy",
]
THRESHOLD = 0.7
#: Share of the pooled covariance in each class's own; bins of the logistic scale's histogram, evenly over asinh of the difference.
POOL, BINS, REACH = 0.6, 600, 15.0

_KINDS = np.zeros((256, 6))  # upper-case, digits, full stops and commas, other ASCII symbols, high bytes, blanks
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = ["A" <= _c <= "Z", "0" <= _c <= "9", _c in ".,", 32 < _b < 127 and not _c.isalnum() and _c not in ".,", _b > 127, _c in " \t\n\r\x0b\x0c"]
_SYMBOL = _KINDS[:, 3].astype(bool)


def statistics(raw: bytes | None) -> list[float]:
    """The transformed statistics of one whole text."""
    words = raw.split() if raw else []
    if not words:
        return [0.0] * len(NAMES)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = counts @ _KINDS
    n, n_words, solid = len(raw), len(words), len(raw) - kinds[5]
    met, lines = Counter(words), [x for x in raw.split(b"\n") if x]
    doubled = np.count_nonzero((data[1:] == data[:-1]) & _SYMBOL[data[1:]])
    pairs = len(set(zip(words, words[1:], strict=False)))
    share = counts[counts > 0] / n
    shares = np.arcsin(np.sqrt(np.clip([kinds[0] / solid, kinds[1] / solid, kinds[2] / solid, kinds[3] / solid, kinds[4] / solid, kinds[5] / n, doubled / solid], 0, 1)))
    repeats = sum(map(eq, words, words[1:]))
    return [
        np.log1p(n), np.log1p(n_words), np.log1p(len(lines)), *shares, np.log(solid / n_words), np.log(len(met)) / max(np.log(n_words), 1), np.arcsin(np.sqrt(max(met.values()) / n_words)),
        np.arcsin(np.sqrt(repeats / n_words)), np.arcsin(np.sqrt((pairs + 1) / n_words)) if n_words > 1 else np.pi / 2, np.arcsin(np.sqrt(len(set(lines)) / len(lines))), float(-(share * np.log2(share)).sum()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``statistics``."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "statistics")]
    names, inner = [f.name for f in kept], "__raw"
    while inner in names:
        inner += "_"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(inner)]
            flat = pa.array(np.array(rows, float).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], [*names, "statistics"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "statistics array<double>"])
    return docs.select(*[F.col(f"`{n}`") for n in names], F.col("text").cast("binary").alias(inner)).mapInArrow(measure, schema)


def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task, for each label: count, sums and outer products."""
    size = len(NAMES) + 1
    total = {0: np.zeros((size, size)), 1: np.zeros((size, size))}
    for batch in frames:
        x = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, size - 1)
        x = np.concatenate([np.ones((len(x), 1)), x], 1)
        y = batch.column("label").to_numpy()
        for k in total:
            total[k] += x[y == k].T @ x[y == k]
    yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "moments": pa.array([t.ravel().tolist() for t in total.values()])})


def shrunk(cov: np.ndarray, n: float) -> np.ndarray:
    """Oracle-approximating shrinkage of a covariance of ``n`` rows towards a multiple of the identity."""
    p = len(cov)
    mean, square = np.trace(cov) / p, (cov * cov).sum()
    below = (n + 1 - 2 / p) * (square - p * mean * mean)
    share = 1.0 if below <= 0 else min(1.0, ((1 - 2 / p) * square + (p * mean) ** 2) / below)
    return (1 - share) * cov + share * max(mean, 1e-9) * np.eye(p)


class Discriminant:
    """Means and inverse Cholesky factors of both classes, and the logistic scale."""

    def __init__(self, moments: dict[int, np.ndarray], pool: float = POOL):
        n = {k: m[0, 0] for k, m in moments.items()}
        self.share = (n[1] + 1) / (n[0] + n[1] + 2)
        self.scale = (0.0, float(np.log(self.share / (1 - self.share))))  # slope and offset
        self.sound = min(n.values()) >= 2
        if not self.sound:
            return
        mean = {k: m[0, 1:] / n[k] for k, m in moments.items()}
        own = {k: m[1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
        self.unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))  # statistics are measured in within-class deviations
        self.mean = {k: m / self.unit for k, m in mean.items()}
        across = np.outer(self.unit, self.unit)
        self.factor, self.log_det = {}, {}
        for k in own:
            lower = np.linalg.cholesky(shrunk((1 - pool) * own[k] / across + pool * pooled / across, n[k]))
            self.factor[k], self.log_det[k] = np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum()
        self.scale = (1.0, self.scale[1])

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, for each row."""
        if not self.sound:
            return np.zeros(len(x))
        density = {k: -0.5 * ((((x / self.unit - self.mean[k]) @ f.T) ** 2).sum(1) + self.log_det[k]) for k, f in self.factor.items()}
        return density[1] - density[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * np.arcsinh(self.difference(x)) + self.scale[1], -36, 36)))


def logistic(at: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit the bins' counts best, by Newton steps with a small ridge."""
    w, design = np.zeros(2), np.stack([at, np.ones_like(at)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -36, 36)))
        weight = (ones + zeros) * p * (1 - p)
        step = np.linalg.solve(design.T @ (design * weight[:, None]) + 1e-3 * np.eye(2), design.T @ (ones - (ones + zeros) * p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(measured: DataFrame, labels: DataFrame, column: str = "quality", pool: float = POOL) -> Discriminant:
    """Fits on all rows of ``measured`` (doc_id, statistics) that ``labels`` (doc_id, ``column``) marks 0 or 1."""
    marks = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    joined = staged(measured.select("doc_id", "statistics").join(marks, "doc_id").select("label", "statistics"), "labelled")
    moments = joined.mapInArrow(sums, "label int, moments array<double>")
    total = moments.groupBy("label").agg(*[F.sum(F.get("moments", F.lit(i))).alias(f"m{i}") for i in range((len(NAMES) + 1) ** 2)]).collect()
    side = len(NAMES) + 1
    added = {k: np.zeros((side, side)) for k in (0, 1)} | {r["label"]: np.array(r[1:], float).reshape(side, side) for r in total}
    model = Discriminant(added, pool)
    if model.sound:
        shipped = joined.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # a few matrices

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, count = pickle.loads(shipped.value), np.zeros((2, BINS), int)
            for batch in batches:
                x = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, len(NAMES))
                at = ((np.arcsinh(own.difference(x)) / REACH + 1) / 2 * BINS).clip(0, BINS - 1).astype(int)
                np.add.at(count, (batch.column("label").to_numpy(), at), 1)
            y, b = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"label": pa.array(y, pa.int32()), "bin": pa.array(b, pa.int32()), "n": pa.array(count[y, b], pa.int64())})

        count = np.zeros((2, BINS))
        for r in joined.mapInArrow(bins, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect():
            count[r["label"], r["bin"]] = r["n"]
        model.scale = logistic(((np.arange(BINS) + 0.5) / BINS * 2 - 1) * REACH, count[1], count[0])
    discard(joined)
    return model


def score_documents(measured: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``measured`` with score and predicted (1 from ``threshold`` on) in place of its statistics."""
    kept = [f for f in measured.schema.fields if f.name not in ("statistics", "score", "predicted")]
    names, shipped = [f.name for f in kept], measured.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for batch in batches:
            x = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, len(NAMES))
            scores = own.probability(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double, predicted int"])
    return measured.mapInArrow(score, schema)
