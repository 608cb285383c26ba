"""Language identification by hierarchical discrimination.

A first set of one-versus-rest linear SVMs predicts the language family; within the family,
one-versus-one linear SVMs separate its closely related languages by vote. Features are hashed
letter n-grams (1 to 3) of the whole text. The SVMs (squared hinge, L2) are fitted on a bounded
sample: at most ``per_language`` labelled documents of each language, chosen on the executors by a
hash of id and text. Featurisation runs on the executors; the driver gets the sample's vectors only. Prediction is an
Arrow UDF over the text column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.llm.common import free_name, held_out
from washline.llm.textfeat import hellinger, letter_ngrams

UNDETERMINED = "und"

# Language codes by family. Codes not listed form the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ca ro gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he am mt",
    "indo-aryan": "hi bn mr gu pa ur ne si",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms tl jv su mg",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], "other")


def fit_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Linear SVM (squared hinge) for y in {-1, 1} by accelerated gradient; last weight: intercept.

    Classes weigh the same however unequal their counts are.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1] + 1, np.float64)
    v, rate = w.copy(), 0.25  # rows have length 1, with the intercept at most 2: curvature <= 4
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1].astype(np.float32) + v[-1]))
        g = -2 * share * y * slack
        grad = np.append(x.T @ g.astype(np.float32), g.sum()) + l2 * np.append(v[:-1], 0)
        new = v - rate * grad
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """Weights of the family SVMs (one row each) and of the pairwise SVMs within each family."""

    bits: int
    families: list[str]
    family_weights: np.ndarray
    members: dict[str, list[str]]
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ``und`` and 0 without a letter or a model."""
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.families:
            return langs, scores
        for i, text in enumerate(texts):
            counts = letter_ngrams(text, self.bits)
            if counts is None:
                continue
            x = np.append(hellinger(counts), np.float32(1))
            margin = self.family_weights @ x
            best = int(margin.argmax())
            soft = np.exp(4 * (margin - margin[best]))
            score = float(1 / soft.sum())
            names = self.members[self.families[best]]
            votes, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
            for a, b in combinations(names, 2):
                m = float(self.pair_weights[a, b] @ x)
                votes[a if m >= 0 else b] += 1
                sure[a] += 1 / (1 + np.exp(-4 * m))
                sure[b] += 1 / (1 + np.exp(4 * m))
            lang = max(names, key=lambda n: (votes[n], sure[n], n))
            if len(names) > 1:
                score *= sure[lang] / (len(names) - 1)
            langs[i], scores[i] = lang, score
        return langs, scores


def fit(labelled: DataFrame, bits: int = 12, per_language: int = 800) -> LanguageModel:
    """Fit on ``labelled`` (doc_id, text, lang): at most ``per_language`` texts of each language.

    Rows with a null lang, or whose text is null or has no letter, teach nothing. Without any
    rows the model predicts ``und`` everywhere.
    """
    rows = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .collect()}  # one row per language
    digest = F.xxhash64(F.col("text"))
    draw = F.pmod(F.xxhash64("doc_id", digest), F.lit(1 << 30))
    # an eighth more than the bound is drawn by hash, so that the cut per language moves little
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, (1.125 * per_language + 16) / n) * (1 << 30))))
                         for k, n in sorted(counts.items())], F.lit(0)) if counts else F.lit(0)

    @F.pandas_udf("array<int>")
    def sparse(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            c = letter_ngrams(t, bits)
            at = np.flatnonzero(c) if c is not None else np.zeros(0, int)
            out.append(np.stack([at, np.minimum(c[at], 1 << 30)]).ravel().astype(np.int32)
                       if len(at) else np.zeros(0, np.int32))
        return pd.Series(out)

    drawn = rows.where((draw < share) & F.col("text").rlike(r"\p{IsAlphabetic}")).withColumn("_draw", draw).withColumn(
        "_digest", digest)
    # of equal rows Spark keeps no more than the bound before it brings a language's rows together
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "doc_id", "_digest"))
    sample = drawn.withColumn("_n", first).where(F.col("_n") <= per_language)
    got = sample.repartition(8, "_draw").select("lang", "_n", sparse("text").alias("v")).where(
        F.size("v") > 0).toPandas().sort_values(["lang", "_n"])
    x = np.zeros((len(got), 1 << bits), np.float32)
    for i, v in enumerate(got["v"]):
        at, n = np.asarray(v).reshape(2, -1)
        x[i, at] = n
    if len(x):
        x = np.sqrt(x / x.sum(1, keepdims=True))
    y = got["lang"].to_numpy()
    langs = sorted(set(y))
    members: dict[str, list[str]] = {}
    for name in langs:
        members.setdefault(family_of(name), []).append(name)
    families = sorted(members)
    fam = np.array([family_of(name) for name in y])
    family_weights = np.stack([fit_svm(x, np.where(fam == f, 1.0, -1.0)) for f in families]) \
        if len(families) > 1 else np.zeros((len(families), (1 << bits) + 1))
    pairs = {}
    for f in families:
        for a, b in combinations(members[f], 2):
            at = (y == a) | (y == b)
            pairs[a, b] = fit_svm(x[at], np.where(y[at] == a, 1.0, -1.0)).astype(np.float32)
    return LanguageModel(bits, families, family_weights.astype(np.float32), members, pairs)


def predict_udf(model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score> of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = model.predict(list(texts))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with struct column ``language`` (lang_pred, score); other columns stay.

    Null, empty and letterless texts are ``und`` with score 0. A column that is already called
    ``language`` stays; the new one is then ``_language``.
    """
    return docs.withColumn(free_name(docs, "language"), predict_udf(model, F.col("text")))


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents with a language stay; those rejected as ``und`` go."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    name = free_name(docs, "language")
    return identify(docs, model).where(F.col(f"{name}.lang_pred") != UNDETERMINED).drop(name)
