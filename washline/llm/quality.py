"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are documents labelled good; unlabelled web text is a sample of all documents.
The risk of a small network f over document statistics is

    pi * E_P[loss(f, +)] + max(0, E_U[loss(f, -)] - pi * E_P[loss(f, -)])

with the class prior pi estimated from the scores of first fits, each on half of the samples: the smallest
ratio of the shares of unlabelled and positive documents above a threshold. For this every document outside
the held-out quarter is scored by the fit that did not see its half, and counted in a histogram. Labels of bad documents are never used. The rows whose gradients are
taken are bounded samples (``max_positive`` labelled ones, ``max_unlabelled`` of the rest, chosen by a hash
of the id); the prior, and with it the balance of the risk, comes from all rows, and every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.common import hash_sample, held_out, scratch_table
from washline.llm.docstats import COUNTS, SHARES, document_counts

THRESHOLD = 0.7
HIDDEN = 16


def features(rows: pd.DataFrame) -> np.ndarray:
    """Shares, and the logarithm of the words, from COUNTS; 0 where a denominator is 0."""
    out = [np.log1p(rows["n_words"].to_numpy(float))]
    for a, b in SHARES.values():
        x, y = rows[a].to_numpy(float), rows[b].to_numpy(float)
        out.append(np.divide(x, y, out=np.zeros_like(x), where=y > 0))
    x = np.stack(out, 1)
    x[:, -2:] = np.log1p(x[:, -2:])  # word length and words per line have long tails
    return x


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_forward(self.weights, self._norm(x))[0]))

    def _norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)


def _forward(w, x):
    h = np.maximum(0, x @ w[0] + w[1])
    return np.clip(h @ w[2] + w[3][0], -30, 30), h


def _fit(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, seed: int) -> list[np.ndarray]:
    """Minimise the non-negative risk (logistic loss) by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    d = xp.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    sig = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, steps + 1):
        p = xp[rng.permutation(len(xp))[:1024]]
        u = xu[rng.permutation(len(xu))[:2048]]
        zp, hp = _forward(w, p)
        zu, hu = _forward(w, u)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if rest >= 0:
            gp = prior * (-sig(-zp) - sig(zp)) / len(p)
            gu = sig(zu) / len(u)
        else:  # the negative part's estimate fell below 0: step back from overfitting it
            gp = prior * sig(zp) / len(p)
            gu = -sig(zu) / len(u)
        grads = [np.zeros_like(a) for a in w]
        for x, h, g in ((p, hp, gp), (u, hu, gu)):
            gh = np.outer(g, w[2]) * (h > 0)
            grads[0] += x.T @ gh
            grads[1] += gh.sum(0)
            grads[2] += h.T @ g
            grads[3] += g.sum()
        for k in range(4):
            g = grads[k] + (1e-4 * w[k] if k in (0, 2) else 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return w


#: Scores are counted in this many equal bins of the score.
BINS = 1000


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of the shares of unlabelled and positive scores above a threshold, from counts of
    scores per bin (in rising order).

    Thresholds leave a twentieth of the positives or more, so that the ratio is not noise.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    p = positive[::-1].cumsum()[::-1] / n_p  # share at or above each bin
    u = unlabelled[::-1].cumsum()[::-1] / n_u
    use = p >= 0.05
    p, u = p[use], u[use]
    error = np.sqrt(u * (1 - u) / n_u) / p + np.sqrt((1 - p) / p / n_p) * u / p
    return float(np.clip((u / p + error / 2).min(), 0.05, 0.98))


def histogram(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((scores * BINS).astype(int), BINS - 1), minlength=BINS)


def _normed(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    x = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else positive
    mean = x.mean(0) if len(x) else np.zeros(positive.shape[1])
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(positive.shape[1])
    return QualityModel(mean, scale, [], 0.5)


def first_fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, seed: int = 3) -> QualityModel:
    """A model under the prior 0.5, whose scores order documents well enough to estimate the prior.

    Without positives or unlabelled rows every score is one half."""
    model = _normed(positive, unlabelled)
    if not len(positive) or not len(unlabelled):
        d = positive.shape[1]
        model.weights = [np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
        return model
    model.weights = _fit(model._norm(positive), model._norm(unlabelled), 0.5, steps // 2, seed)
    return model


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, seed: int = 3) -> QualityModel:
    """The model under a class prior."""
    model = _normed(positive, unlabelled)
    model.prior = prior
    xp, xu = model._norm(positive), model._norm(unlabelled)
    fits = [_fit(xp, xu, prior, steps, seed + k) for k in range(3)]
    # three starts as one network: their hidden units side by side, their outputs averaged
    model.weights = [np.concatenate([w[0] for w in fits], 1), np.concatenate([w[1] for w in fits]),
                     np.concatenate([w[2] for w in fits]) / 3, sum(w[3] for w in fits) / 3]
    return model


def train(counts: DataFrame, labels: DataFrame, max_positive: int = 8_000,
          max_unlabelled: int = 12_000) -> QualityModel:
    """Fit on statistics of documents outside the held-out quarter."""
    open_rows = counts.where(~held_out(F.col("doc_id")))
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_good")).distinct()
    marked = open_rows.join(good, F.col("doc_id") == F.col("_good"), "left").withColumn(
        "_good", F.col("_good").isNotNull())
    total = {r["_good"]: r["n"] for r in marked.groupBy("_good").agg(F.count(F.lit(1)).alias("n")).collect()}
    by = ["doc_id", *COUNTS]
    half = F.pmod(F.xxhash64(*by, F.lit(1)), F.lit(2)).cast("int").alias("_half")
    positive = hash_sample(marked.where("_good"), max_positive, total.get(True, 0), *by).select("*", half).toPandas()
    unlabelled = hash_sample(marked, max_unlabelled, sum(total.values()), *by).select("*", half).toPandas()
    xp, xu = features(positive), features(unlabelled)
    if not len(xp) or not len(xu):
        return first_fit(xp, xu)
    # a first fit on each half of the samples scores the other half of all rows, which it did not see
    firsts = [first_fit(xp[positive["_half"] == h], xu[unlabelled["_half"] == h]) for h in (0, 1)]
    scored = F.when(half == 0, score_column(firsts[1])).otherwise(score_column(firsts[0]))
    at = F.least(F.floor(scored * BINS), F.lit(BINS - 1)).cast("int")
    found = marked.select("_good", at.alias("bin")).groupBy("_good", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = np.zeros((2, BINS))
    for r in found:  # at most two rows per bin
        seen[int(r["_good"]), r["bin"]] += r["n"]
    return fit(xp, xu, estimate_prior(seen[1], seen.sum(0)))


def score_column(model: QualityModel) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(model.score(features(pd.concat(columns, axis=1, keys=COUNTS))))

    return score(*[F.col(c) for c in COUNTS])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, COUNTS, score (0 to 1) and predicted, one row per row of ``docs``.

    Null and empty texts have statistics of 0 and are scored like others. Rows with a null id
    count as not held out. Labels that are null or of unknown documents teach nothing; without
    any positive every score is 0.5.
    """
    counts, _ = scratch_table(document_counts(docs), "counts")
    model = train(counts, labels)
    return counts.withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "score", score_column(model)).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id", "held_out", "score", "predicted")
