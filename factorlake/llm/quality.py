"""Quality scores by ordinal cumulative-link regression on graded ratings.

A document's score is the sum of weights of the hashed features that it holds:
its words, and coarse measures of its shape (repetition, capitals, symbols,
lengths). The weights are shared by all grades, and ordered thresholds cut the
score's line into grades: P(grade <= k) = 1 / (1 + exp(score - threshold k)).
From that come the expected grade and the probability of the tail (grade at
least `keep_grade`), by which documents are kept.

The fit runs on the driver over a bounded sample of labelled rows, whose
features the executors have hashed; scoring runs over whole texts on the
executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import read_table

#: Labelled rows that the fit uses at most, and the number of hashed features.
SAMPLE_ROWS, WIDTH = 10_000, 1 << 18
_PUNCTUATION = b".,;:?\"()"
_LOWER = bytes(range(97, 123))


def _words(text: str) -> tuple[bytes, list[bytes]]:
    raw = text.encode("utf-8", "replace")
    return raw, raw.lower().translate(None, _PUNCTUATION).split()


def shape(raw: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Features of the text as a whole, each one of a few levels, numbered from WIDTH."""
    n, size = max(1, len(words)), max(1, len(raw))
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    odd = size - len(raw.translate(None, b"!#$%&*+/<=>@[\\]^_`{|}~"))
    digits = size - len(raw.translate(None, b"0123456789"))
    level = lambda x, *cuts: sum(x > c for c in cuts)
    levels = (
        level(distinct / n, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7) if n >= 20 else 9,
        level(upper / size, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
        level(odd / size, 0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1),
        level(digits / size, 0.0, 0.01, 0.03, 0.1, 0.3),
        level(size / n, 2, 4, 5, 6, 7, 8, 10, 15),
        level(n, 0, 5, 20, 100, 500, 2000),
    )
    return [WIDTH + 16 * i + x for i, x in enumerate(levels)]


def stems(words: set[bytes]) -> set[bytes]:
    """First five bytes of longer words, which other forms of a word share."""
    return {b"^" + w[:5] for w in words if len(w) > 5}


def features(text: str | None) -> np.ndarray:
    raw, words = _words(text or "")
    distinct = set(words)
    hashed = {zlib.crc32(w) % WIDTH for w in distinct | stems(distinct)}
    return np.array(sorted(hashed) + shape(raw, words, len(distinct)), np.int32)


@dataclass
class Ordinal:
    """Weights (WIDTH hashed words, then shapes) and ascending thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and each threshold k (columns)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = 600, batch: int = 256, rate: float = 0.3, l1: float = 1e-3, seed: int = 7) -> Ordinal:
    """Proximal AdaGrad on the ordinal likelihood, with an L1 penalty that leaves chance words without weight."""
    w, g2 = np.zeros(WIDTH + 128), np.full(WIDTH + 128, 1e-4)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, len(grades)), 1e-3, 1 - 1e-3)
    theta, t2 = np.log(share / (1 - share)), np.full(n_grades - 1, 1e-4)
    sizes, flat = np.array([len(r) for r in rows]), np.concatenate(rows)
    starts = np.cumsum(sizes) - sizes
    seen = np.bincount(flat, minlength=len(w))
    random = np.random.default_rng(seed)
    for _ in range(-(-steps * batch // max(batch, len(rows)))):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            ids = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in some])
            cuts = np.cumsum(sizes[some]) - sizes[some]
            y, s = grades[some], np.add.reduceat(w[ids], cuts)
            # P(y) = F(theta_y - s) - F(theta_{y-1} - s), F the logistic function
            edge = np.concatenate([[-60.0], theta, [60.0]])
            f = 1 / (1 + np.exp(-np.clip(edge[None, :] - s[:, None], -60, 60)))
            d = f * (1 - f)
            row = np.arange(len(y))
            p = np.maximum(f[row, y + 1] - f[row, y], 1e-12)
            ds = (d[row, y + 1] - d[row, y]) / p / len(y)  # gradient of the loss by the score
            grad = np.bincount(ids, np.repeat(ds, sizes[some]), minlength=len(w))
            on = np.flatnonzero(grad)
            on = on[seen[on] >= 5]
            g = grad[on]
            g2[on] += g * g
            step = rate / np.sqrt(g2[on])
            x = w[on] - step * g
            w[on] = np.sign(x) * np.maximum(np.abs(x) - step * l1, 0)
            gt = np.zeros(len(theta))
            for k in range(len(theta)):
                gt[k] = (-(d[:, k + 1] / p)[y == k].sum() + (d[:, k + 1] / p)[y == k + 1].sum()) / len(y)
            t2 += gt * gt
            theta = np.maximum.accumulate(theta - rate / np.sqrt(t2) * gt)
    return Ordinal(w, theta)


def fit_on(docs: DataFrame, labels: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS) -> Ordinal | None:
    """Fit on at most sample_rows rows of labels (doc_id, grade), those with the lowest hashes; None without any.

    Of documents that repeat an id, the one whose text has the lowest hash is fitted on.
    """
    some = labels.where("grade is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("grade").alias("_grade"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample_rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["_id"], "grade": pdf["_grade"], "t": pdf["_t"], "ids": [features(t).tobytes() for t in pdf["_text"]]})

    # at most sample_rows labels go to the executors, and one row for each comes back
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_t")).join(F.broadcast(some), "_id")
    rows = rows.mapInPandas(hashed, "id long, grade int, t long, ids binary")
    rows = rows.groupBy("id", "grade").agg(F.min(F.struct("t", "ids")).alias("x")).select("id", "grade", "x.ids").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["id", "grade"], kind="stable")
    return fit([np.frombuffer(x, np.int32) for x in rows["ids"]], rows["grade"].to_numpy(), n_grades)


def score(docs: DataFrame, model: Ordinal | None, keep_grade: int, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of docs with expected_grade, tail_probability (grade >= keep_grade) and kept (that is at least `least`).

    A null text counts as empty and is judged by its shape alone. Without a
    model (no labelled row), the scores are null and everything is kept.
    Repeated rows are scored each for itself; no rows give no rows. A column of
    docs with a name that is added here is replaced.
    """
    names = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_d"))
    back = [F.col("_d")[c].alias(c) for c in names]
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(*back, none.alias("expected_grade"), none.alias("tail_probability"), F.lit(True).alias("kept"))
    on = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((on.astype(np.int32), model.weights[on], model.thresholds))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        places, values, thresholds = sent.value
        weights = np.zeros(WIDTH + 128)
        weights[places] = values
        # where each word's weight stands; all without weight stand together, where there is none
        by_word = Remembered(lambda w: zlib.crc32(w) % WIDTH if weights[zlib.crc32(w) % WIDTH] else WIDTH + 127)
        own = Ordinal(weights, thresholds)
        for batch in texts:
            s = []
            for t in batch:
                raw, words = _words(t or "")
                distinct = set(words)
                # words that share a hash count once, as in features()
                s.append(float(weights[list(set(map(by_word.__getitem__, distinct | stems(distinct))))].sum() + weights[shape(raw, words, len(distinct))].sum()))
            above = own.above(np.array(s))
            yield pd.DataFrame({"expected_grade": above.sum(axis=1), "tail_probability": above[:, keep_grade - 1]})

    out = rows.withColumn("_q", run(F.col("_d")[text_col]))
    return out.select(*back, "_q.expected_grade", "_q.tail_probability", (F.col("_q.tail_probability") >= least).alias("kept"))


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 low quality, 1 good but toxic, 2 good. A null toxic counts as 0, a null quality as unlabelled."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(toxic == 1, 1).otherwise(2)).cast("int").alias("grade"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_on(docs, grades(read_table(spark, sf_dir, "labels")), 3)
    return score(docs.select("doc_id", "text"), model, keep_grade=2).drop("text")
