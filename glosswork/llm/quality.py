"""Quality classifier by positive-unlabelled learning.

Each text becomes a *cell*: a few shape measures, cut into bins. One pass over
the corpus writes the cells; counts of trusted positives and of unlabelled text
by cell, over all training documents, are all that the driver gets: at most
``MAX_CELLS`` rows, whatever the corpus. From them it estimates the class prior
and minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic loss, for a model that adds a weight for each bin. The prior is the
smallest ratio of the unlabelled to the positive share among the best-scored
cells that hold enough positives: where no negatives are, that ratio is the
prior itself.

Defined results: null and empty texts have a cell of their own; without any
positive every score is 0.5; repeated rows give a row each; null ids count as
training rows without a label; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, record, slices

#: Upper bounds of the bins of each measure.
BINS = {
    "words": (0, 2, 9, 49), "upper": (0.1, 0.3, 0.6), "symbols": (0.05, 0.15, 0.3, 0.6, 1.5), "bare": (0.05, 0.2, 0.4),
    "stutter": (0.03, 0.1, 0.3, 0.6), "fresh": (0.2, 0.5, 0.8, 0.95), "length": (3.0, 6.5, 7.5, 12.0), "digits": (0.05, 0.2),
}
_SIZES = [len(b) + 1 for b in BINS.values()]
MAX_CELLS = int(np.prod(_SIZES))
#: Positives that the best cells must hold, as a share, to tell of the prior.
PRIOR_SHARE = 0.2
_UPPER, _LETTERS, _DIGITS = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_]+"), re.compile(rb"[0-9]+")
_SYMBOLS = bytes(set(range(33, 127)) - set(b".,;:'\"()-?") - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_CELLS = pa.schema([("doc_id", pa.int64()), ("cell", pa.int32())])


def measures(text: str) -> tuple[float, ...]:
    """The measures of a text, in the order of BINS."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = sum(map(len, _UPPER.findall(text))) if letters else 0
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    bare = sum(len(w) < 3 and not w.isalnum() and w.isascii() for w in words) / n
    stutter = sum(map(bytes.__eq__, words, words[1:])) / n
    fresh = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    digits = sum(map(len, _DIGITS.findall(raw))) / len(raw)
    return n, upper / max(1, letters), symbols / n, bare, stutter, fresh, sum(map(len, words)) / n, digits


def cell(text: str) -> int:
    at = 0
    for value, bounds in zip(measures(text), BINS.values(), strict=True):
        at = at * (len(bounds) + 1) + sum(value > b for b in bounds)
    return at


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        yield record(_CELLS, b.column(0), [cell(x or "") for x in b.column(1).to_pylist()])


def _one_hot(cells: np.ndarray) -> np.ndarray:
    bins = np.stack(np.unravel_index(cells, _SIZES), axis=1)
    starts = np.cumsum([0, *_SIZES[:-1]])
    out = np.zeros((len(cells), sum(_SIZES) + 1))
    np.put_along_axis(out, bins + starts, 1.0, axis=1)
    out[:, -1] = 1.0
    return out


def estimate_prior(scores: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest share ratio over the cells from the best score down that hold PRIOR_SHARE of the positives, with a margin for chance."""
    order = np.argsort(-scores, kind="stable")
    p, u = np.cumsum(positive[order]) / positive.sum(), np.cumsum(unlabelled[order]) / unlabelled.sum()
    last = np.append(np.diff(scores[order]) != 0, True)  # cells of one score come together
    held = last & (p >= PRIOR_SHARE)
    margin = np.sqrt(1 / (4 * positive.sum())) + np.sqrt(1 / (4 * unlabelled.sum()))
    ratio = u[held] / p[held]
    return float(np.clip(ratio[np.argmin((u[held] + margin) / p[held])], 0.05, 0.98))


def train(cells: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, *, rounds: int = 3) -> tuple[np.ndarray, float]:
    """Weights and prior: each round ranks the cells by the model so far, estimates the prior anew and fits again."""
    weights, prior = fit(cells, positive, unlabelled, 0.5), 0.5
    for _ in range(rounds):
        prior = estimate_prior(_one_hot(cells) @ weights, positive, unlabelled)
        weights = fit(cells, positive, unlabelled, prior)
    return weights, prior


def fit(cells: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 1500, rate: float = 0.03, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the bins that minimise the non-negative risk, by Adam."""
    x, p, u = _one_hot(cells), positive / positive.sum(), unlabelled / unlabelled.sum()
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    softplus = lambda z: np.logaddexp(0.0, z)
    for t in range(1, steps + 1):
        z = x @ w
        s = 1 / (1 + np.exp(-z))
        negative_risk = u @ softplus(z) - prior * (p @ softplus(z))
        by_z = (u - prior * p) * s
        # Below zero the negative part has been fitted to noise: step back from it.
        g = x.T @ (prior * p * (s - 1) + by_z if negative_risk >= 0 else -by_z) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def cell_scores(weights: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(_one_hot(cells) @ weights)))


def train_quality(cells: DataFrame, labels: DataFrame, folds: int, held_out_fold: int) -> np.ndarray | None:
    """Weights learned from cells (doc_id, cell, held_out) that aren't held out; None without a positive."""
    trusted = labels.where((F.col("quality") == 1) & (crc_mod("doc_id", folds) != held_out_fold)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("_p", F.lit(1))
    counts = cells.where(~F.col("held_out")).join(trusted, "doc_id", "left").groupBy("cell").agg(F.count(F.lit(1)).alias("u"), F.count("_p").alias("p")).orderBy("cell").toPandas()
    at, p, u = counts["cell"].to_numpy(), counts["p"].to_numpy(float), counts["u"].to_numpy(float)
    return train(at, p, u)[0] if p.sum() else None


def keep_quality(df: DataFrame, labels: DataFrame, *, text: str = "text", least: float = 0.5, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """The rows of df whose text scores least or more, each judged by itself, with all its columns whatever their names."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    cells = rows.mapInArrow(_to_cells, "doc_id long, cell int").withColumn("held_out", crc_mod("doc_id", folds) == held_out_fold)
    found, at = train_quality(cells, labels, folds, held_out_fold), df.columns.index(text)
    weights = df.sparkSession.sparkContext.broadcast(found)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            if weights.value is None:
                yield b if least <= 0.5 else b.slice(0, 0)
                continue
            scores = cell_scores(weights.value, np.array([cell(x or "") for x in b.column(at).to_pylist()]))
            yield b.filter(pa.array(scores >= least))

    return df.mapInArrow(keep, df.schema)


def score_quality(df: DataFrame, labels: DataFrame, *, text: str = "text", folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score for each row of df (doc_id, text); labels: (doc_id, quality)."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    cells = checkpointed(rows.mapInArrow(_to_cells, "doc_id long, cell int").withColumn("held_out", crc_mod("doc_id", folds) == held_out_fold))
    found = train_quality(cells, labels, folds, held_out_fold)
    if found is None:
        return cells.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    weights = spark.sparkContext.broadcast(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record(pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())]), b.column(0), b.column(1), cell_scores(weights.value, b.column(2).to_numpy()))

    return cells.select("doc_id", "held_out", "cell").mapInArrow(score, "doc_id long, held_out boolean, score double")
