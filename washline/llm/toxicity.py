"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

Features are hashed words of the whole text, and their first four and five letters, present or
not. Those tied to the label in the sample (a z-test on their document shares) enter a logistic
regression. Identity terms (groups of people, of one word or several) in labelled texts are swapped for
other terms of the same kind and left out, each on the whole text (what other words of it also
contribute stays), and the squared change of the score is penalised: a mention of a group then
weighs what no mention weighs, so neutral mentions are not false positives.

The sample is bounded (``max_per_label`` labelled documents of each label, chosen by a hash of the id).
Its documents weigh as many as they stand for, so that the score does not depend on the bound.
Features are counted and chosen on the executors; the driver gets the chosen ones of each sampled
document only. Scoring is an Arrow UDF over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.common import drop_scratch, free_name, hash_sample, held_out, scratch_table
from washline.llm.textfeat import code_points, letter_table

THRESHOLD = 0.3
U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_KIND = np.arange(1, 4, dtype=np.uint64) * U(0xD6E8FEB86659FD93)

# Identity terms by kind; terms of a kind are swapped for one another. A parameter of
# ``train``; terms of several words are written with an underscore.
IDENTITY_TERMS = {
    "religion": "christian christians muslim muslims jewish jew jews hindu hindus buddhist buddhists "
                "sikh sikhs atheist atheists catholic catholics protestant protestants",
    "orientation": "gay gays lesbian lesbians bisexual bisexuals straight heterosexual heterosexuals "
                   "homosexual homosexuals queer",
    "gender": "woman women man men female females male males transgender trans nonbinary",
    "origin": "black white asian asians african africans european europeans american americans "
              "mexican mexicans latino latina hispanic arab arabs chinese indian indians "
              "immigrant immigrants refugee refugees foreigner foreigners",
    "age and ability": "old young elderly disabled blind deaf autistic wheelchair_user wheelchair_users",
}


def _letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all letters of the case-folded text, where words start, and their lengths."""
    cp = code_points(text.lower())
    inside = letter_table()[cp]
    at = np.flatnonzero(inside)
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    first = np.searchsorted(at, start)
    return cp[at], first, np.diff(np.append(first, len(at)))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_features(text: str | None) -> np.ndarray:
    """64-bit hashes (words, 3): the word, its first four and its first five letters."""
    if not text:
        return np.zeros((0, 3), U)
    cp, first, length = _letters(text)
    if not len(first):
        return np.zeros((0, 3), U)
    place = np.arange(len(cp)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _P))
    part = (cp.astype(U) + U(1)) * power[place]
    out = np.empty((len(first), 3), U)
    for k, most in enumerate((None, 4, 5)):
        value = part if most is None else np.where(place < most, part, U(0))
        out[:, k] = _spread(np.add.reduceat(value, first) + _KIND[k])
    return out


@dataclass
class IdentityTerms:
    """Identity terms as word hashes, with the features of each and the others of its kind."""

    words: list[np.ndarray]
    features: list[np.ndarray]
    others: list[np.ndarray]

    @staticmethod
    def of(kinds: dict[str, str]) -> IdentityTerms:
        terms = [(kind, word_features(t.replace("_", " "))) for kind, listed in kinds.items() for t in listed.split()]
        return IdentityTerms(
            [f[:, 0] for _, f in terms], [np.unique(f) for _, f in terms],
            [np.array([j for j, (k, _) in enumerate(terms) if k == kind and j != i], int)
             for i, (kind, _) in enumerate(terms)])

    def swaps(self, features: np.ndarray, most: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
        """The counterfactuals of a text with these ``word_features``: for each term in it, left out and in the
        place of ``most`` others, the distinct features that go and those that come."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        heads = np.array([w[0] for w in self.words], U)
        if not len(features) or not np.isin(heads, features[:, 0]).any():
            return out
        for t in np.flatnonzero(np.isin(heads, features[:, 0])):
            words = self.words[t]
            n = len(features) - len(words) + 1
            at = np.flatnonzero(np.logical_and.reduce(
                [features[k:n + k, 0] == w for k, w in enumerate(words)])) if n > 0 else np.zeros(0, int)
            if not len(at):
                continue
            mine = np.zeros(len(features), bool)
            for k in range(len(words)):
                mine[at + k] = True
            rest = np.unique(features[~mine])
            gone = np.setdiff1d(features[mine], rest)
            others = self.others[t]
            chosen = others[np.argsort(_spread(others.astype(U) * _P + U(t)))[:most]]
            out.append((gone, np.zeros(0, U)))
            out += [(np.setdiff1d(gone, self.features[o]), np.setdiff1d(self.features[o], np.concatenate([rest, gone])))
                    for o in chosen]
        return out


@dataclass
class ToxicityModel:
    """Feature hashes in order, their weights, and the intercept."""

    names: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept
        if len(self.names):
            f = word_features(text).ravel()
            at = np.searchsorted(self.names, f)
            at[at == len(self.names)] = 0
            hit = np.unique(at[self.names[at] == f])  # present or not, however often
            z += float(self.weights[hit].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, toxic, clean) of a task's rows (_y, f: distinct hashes): documents that have a feature."""
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy()
        y = np.asarray(batch.column(0).to_pylist(), bool)
        mark = np.repeat(y, batch.column(1).value_lengths().to_numpy())
        names, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
        toxic = np.bincount(inverse, weights=mark, minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(toxic), pa.array(n - toxic)],
                                         names=["f", "toxic", "clean"])


def select_features(rows: DataFrame, min_docs: int = 3, z: float = 5.0,
                    max_features: int = 20_000) -> np.ndarray:
    """Of ``rows`` (_y, f) the features whose share among toxic documents differs from the others'.

    The ``max_features`` with the largest z make up the model at most.
    """
    n = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return np.zeros(0, U)
    total = float(n[True] + n[False])
    share = (F.col("toxic") + F.col("clean")) / total
    spread = F.sqrt(share * (1 - share) * (1 / n[True] + 1 / n[False])) + 1e-12
    strength = F.abs(F.col("toxic") / n[True] - F.col("clean") / n[False]) / spread
    found = (rows.select("_y", "f").mapInArrow(_counts, "f bigint, toxic bigint, clean bigint")
             .groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") + F.col("clean") >= min_docs) & (strength >= z))
             .orderBy(strength.desc(), "f").limit(max_features).select("f").toPandas())
    return np.sort(found["f"].to_numpy(np.int64).view(U))


def _known(names: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The indices in ``names`` of those of ``f`` that are there."""
    at = np.searchsorted(names, f)
    at[at == len(names)] = 0
    return at[names[at] == f]


def fit(names: np.ndarray, rows: list[np.ndarray], y: np.ndarray, fairness: float = 5.0,
        l2: float = 1e-4, steps: int = 1200, swaps: list[list[tuple[np.ndarray, np.ndarray]]] | None = None,
        weight: np.ndarray | None = None) -> ToxicityModel:
    """Fit weights of the features ``names`` (sorted) on distinct hashes per document and labels ``y``.

    ``swaps``: the counterfactuals of each row (``IdentityTerms.swaps``). ``fairness`` weighs their penalty: mean
    over them of (score logit of the document - of its counterfactual)^2.
    ``weight``: how many documents a row stands for, in both means and the intercept (default 1).
    """
    y = np.asarray(y, bool)
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    weight = weight / max(weight.sum(), 1e-12)
    share = float(weight[y].sum())
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = ToxicityModel(names, np.zeros(len(names)), float(np.log(share / (1 - share))))
    if not len(names):
        return model
    index = [_known(names, r) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(i) for i in index])
    index = np.concatenate(index)

    # counterfactuals: rows of feature differences, +1 for what goes, -1 for what comes
    diff_row, diff_at, diff_sign, diff_weight, n = [], [], [], [], 0
    for i, found in enumerate(swaps or []):
        for gone, new in found:
            for sign, f in ((1.0, gone), (-1.0, new)):
                at = _known(names, f)
                diff_row += [n] * len(at)
                diff_at += at.tolist()
                diff_sign += [sign] * len(at)
            diff_weight.append(weight[i])
            n += 1
    diff_row, diff_at = np.array(diff_row, int), np.array(diff_at, int)
    diff_sign, diff_weight = np.array(diff_sign, float), np.array(diff_weight, float)
    diff_weight /= max(diff_weight.sum(), 1e-12)

    # features step by their own curvature, so that rare ones do not lag behind
    count = np.bincount(index, weight[doc], len(names))
    step = 1.0 / (0.25 * count * 20 + l2 + 1e-3)
    if n:
        step = np.minimum(step, 1.0 / (2 * fairness * np.bincount(
            diff_at, diff_weight[diff_row], len(names)) * 6 + 1e-9))
    w, b = model.weights, model.intercept
    target = y.astype(float)
    for _ in range(steps):
        score = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[index], len(rows)), -30, 30)))
        g = (score - target) * weight
        grad = np.bincount(index, g[doc], len(names)) + l2 * w
        if n:
            change = np.bincount(diff_row, diff_sign * w[diff_at], n) * diff_weight
            grad += 2 * fairness * np.bincount(diff_at, diff_sign * change[diff_row], len(names))
        w = w - step * grad
        b -= 0.5 * g.sum()
    model.weights, model.intercept = w, float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, max_per_label: int = 4_000, fairness: float = 5.0,
          identity_terms: dict[str, str] | None = None) -> ToxicityModel:
    """Fit on labelled documents outside the held-out quarter, a bounded sample of each label.

    A drawn document weighs its label's number of documents over the number drawn of it, so both
    labels keep the share they have among all training documents. Null labels and labels of
    documents that are not in ``docs`` teach nothing and take no place in the sample; of rows with one
    id the one with the smallest text hash teaches. Without labels of both kinds the model gives one
    score for every text. ``identity_terms``: kinds and their terms (default ``IDENTITY_TERMS``).
    """
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg((F.max("toxic") == 1).alias("_y")).join(docs.select("doc_id"), "doc_id", "left_semi")
    marked, marked_path = scratch_table(marked, "toxicity-labels")
    total = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = hash_sample(marked.where("_y"), max_per_label, total.get(True, 0), "doc_id").unionByName(
        hash_sample(marked.where(~F.col("_y")), max_per_label, total.get(False, 0), "doc_id"))
    terms = IdentityTerms.of(IDENTITY_TERMS if identity_terms is None else identity_terms)

    @F.pandas_udf("f array<bigint>, swaps array<struct<gone:array<bigint>,new:array<bigint>>>")
    def hashed(text: pd.Series) -> pd.DataFrame:
        found = [word_features(t) for t in text]
        return pd.DataFrame({
            "f": [np.unique(f).view(np.int64) for f in found],
            "swaps": [[{"gone": g.view(np.int64), "new": x.view(np.int64)} for g, x in terms.swaps(f)] for f in found]})

    taught = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_y").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    rows, path = scratch_table(taught.withColumn("_f", hashed("text")).select("doc_id", "_y", "_f.f", "_f.swaps"),
                               "toxicity")
    names = select_features(rows)

    @F.pandas_udf("array<bigint>")
    def known(f: pd.Series) -> pd.Series:
        return pd.Series([np.intersect1d(np.asarray(x, np.int64).view(U), names).view(np.int64) for x in f])

    got = rows.select("doc_id", "_y", known("f").alias("f"), "swaps").toPandas().sort_values("doc_id")
    drop_scratch(docs.sparkSession, path, marked_path)
    y = got["_y"].to_numpy(bool)
    stands_for = {k: n / min(n, max_per_label) for k, n in total.items()}
    words = lambda f: np.asarray(f, np.int64).view(U)
    return fit(names, [words(f) for f in got["f"]], y, fairness=fairness,
               swaps=[[(words(s["gone"]), words(s["new"])) for s in found] for found in got["swaps"]],
               weight=np.array([stands_for[k] for k in y.tolist()], float))


def score_column(model: ToxicityModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with column ``toxicity`` (0 to 1; another free name if there is one already).

    Null, empty and wordless texts get the score of a text without any feature.
    """
    model = train(docs, labels)
    return docs.withColumn(free_name(docs, "toxicity"), score_column(model, F.col("text")))


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         F.col("toxicity").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
