"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the bytes, words and lines of each whole text are mapped to cosines whose inner products approximate a
Gaussian kernel.  Each task sums its part of the normal equations; Spark adds the parts, so the driver gets one small
matrix whatever the number of documents.  Scores are calibrated on labelled rows that the regression has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow.llm.common import pieces, span_hashes, spans_of
from rosterflow.session import written

FEATURES = 256
RIDGE = 1e-3
THRESHOLD = 0.7
# Cells of the raw score from -0.5 to 1.5 in which labels are counted for calibration.
CELLS = 2000
_STATS = 16


def _class_table() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for kind, members in enumerate(([*range(97, 123)], [*range(65, 91)], [*range(48, 58)], [32, 9, 13], [10],
                                    [*range(128, 256)], [33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]), 1):
        kinds[members] = kind
    return kinds


_KIND = _class_table()


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(owner[new], minlength=n)


def text_statistics(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """One row of statistics for each text; an empty text has zeros."""
    n, size = len(borders) - 1, np.diff(borders).astype(float)
    kind = _KIND[data]
    cell = np.repeat(np.arange(0, 8 * n, 8), np.diff(borders)) + kind
    shares = list((np.bincount(cell, minlength=8 * n).reshape(n, 8) / np.maximum(size, 1)[:, None]).T)
    blank = (kind == 4) | (kind == 5)
    starts, ends, owner = spans_of(~blank, borders)
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    length = (ends - starts).astype(float)
    hashes = span_hashes(data, starts, ends)
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))) if len(owner) else hashes > 0
    mean = np.bincount(owner, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(owner, length ** 2, n) / words - mean ** 2, 0))
    short = np.bincount(owner, ends - starts == 1, n) / words
    odd = np.bincount(owner, kind[ends - 1] == 0, n) / words if len(owner) else np.zeros(n)
    loud = np.bincount(owner, (kind[starts] == 2) & (kind[np.minimum(starts + 1, len(data) - 1)] == 2), n) / words \
        if len(owner) else np.zeros(n)
    line_starts, line_ends, line_owner = spans_of(kind != 5, borders)
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    line_kinds = _distinct(line_owner, span_hashes(data, line_starts, line_ends), n)
    return np.stack([
        np.log1p(size), *shares[:4], shares[5], shares[6], shares[7], np.log1p(mean), np.log1p(spread), short, odd, loud,
        _distinct(owner, hashes, n) / words, np.bincount(owner, same, n) / words, line_kinds / lines], 1)


def statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, renamed to c0, c1 and so on, and the statistics of ``text`` (null: empty) as ``stats``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    own = docs.toDF(*names)

    def measure(batches):
        for batch, data, borders in pieces(batches, text):
            stats = text_statistics(data, borders)
            column = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), _STATS).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, column], names=[*names, "stats"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(measure, f"{kinds}, stats array<double>")


@dataclass
class Model:
    """``points`` and ``values``: raw scores and the calibrated scores there."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(_STATS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(_STATS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    points: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def features(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(0)
        waves = draw.normal(0, 1 / np.sqrt(_STATS), (_STATS, FEATURES))
        phase = draw.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(x @ waves + phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.points, self.values)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out.  A null id is in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _stats_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, _STATS)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    size = FEATURES + 2

    def add(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = np.hstack([model.features(_stats_of(batch, 0)), batch.column(1).to_numpy()[:, None]])
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["cell", "value"])

    got = rows.select("stats", "label").mapInArrow(add, "cell long, value double").groupBy("cell").agg(
        F.sum("value").alias("value")).toArrow()
    total = np.zeros(size * size)
    total[got["cell"].to_numpy()] = got["value"].to_numpy()
    total = total.reshape(size, size)
    return total[:-1, :-1], total[:-1, -1]


def isotonic(points: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbours until the means rise; the middle point of each pool and its mean."""
    pools: list[list[float]] = []
    for p, s, c in zip(points, sums, counts):
        pools.append([p * c, s, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p / c for p, _, c in pools]), np.array([s / c for _, s, c in pools])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """``stats``: rows (doc_id, stats); ``labels``: rows (doc_id, quality).  Rows of fold 2 are never used.

    Folds 0 and 1 give the weights, fold 3 the calibration.  Several labels of one document count as their mean,
    null labels not at all; without any label every score is 0.5.
    """
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    rows = written(stats.join(marks, "doc_id").select("stats", "label", fold(F.col("doc_id")).alias("fold"))
                   .where("fold <> 2"), "labelled")
    x = [F.col("stats")[i] for i in range(_STATS)]
    sums = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    model = Model()
    if sums["m0"] is None:
        return model
    model.mean = np.array([sums[f"m{i}"] for i in range(_STATS)])
    model.scale = np.array([sums[f"s{i}"] or 1.0 for i in range(_STATS)])
    squares, products = _normal_equations(rows.where("fold < 2"), model)
    n = squares[-1, -1]
    if not n:
        return model
    penalty = np.eye(len(squares)) * RIDGE * n / FEATURES
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(squares + penalty, products)

    def cells(batches):
        for batch in batches:
            raw = np.clip(model.raw(_stats_of(batch, 0)), -0.5, 1.5)
            yield pa.record_batch([pa.array(np.minimum((raw + 0.5) / 2 * CELLS, CELLS - 1).astype(np.int64)), batch.column(1)],
                                  names=["cell", "label"])

    got = rows.where("fold = 3").select("stats", "label").mapInArrow(cells, "cell long, label double").groupBy("cell").agg(
        F.sum("label").alias("sum"), F.count(F.lit(1)).alias("n")).orderBy("cell").toArrow()
    if got.num_rows:
        middle = (got["cell"].to_numpy() + 0.5) / CELLS * 2 - 0.5
        model.points, model.values = isotonic(middle, got["sum"].to_numpy(), got["n"].to_numpy())
    else:
        model.points, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``stats`` but the statistics, and ``score`` and ``predicted``."""
    names = [c for c in stats.columns if c != "stats"]
    at = stats.columns.index("stats")

    def rate(batches):
        for batch in batches:
            got = np.clip(model.score(_stats_of(batch, at)), 0, 1)
            yield pa.record_batch([*[batch.column(i) for i in range(batch.num_columns) if i != at], pa.array(got),
                                   pa.array((got >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{n}` {stats.schema[n].dataType.simpleString()}" for n in names)
    return stats.mapInArrow(rate, f"{kinds}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs`` (doc_id, text).  A null text is empty."""
    stats = written(statistics(docs.select("doc_id", "text")).select(F.col("c0").alias("doc_id"), "stats"), "statistics")
    rated = score(stats, fit(stats, labels), threshold)
    return rated.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    stats = written(statistics(docs.select("doc_id", "text")).select(F.col("c0").alias("doc_id"), "stats"), "statistics")
    rated = score(statistics(docs), fit(stats, labels), threshold).where("predicted = 1")
    return rated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
