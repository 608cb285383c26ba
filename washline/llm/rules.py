"""Quality rules learned as a decision list by sequential covering.

Each rule is a conjunction of thresholds on document statistics that marks rejects. A rule is grown
on two thirds of a bounded labelled sample, adding the threshold with the highest FOIL gain until it
covers no keeps or nothing gains, then pruned on the other third: final thresholds go as long as that does
not lower (p - n) / (p + n). A rule that is not precise enough on the third, or covers too few rejects
there, ends the search (nothing else does); what a rule covers is taken out before the next is grown. The ordered list becomes one Spark conditional
expression; what no rule matches is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.common import hash_sample, held_out, scratch_table
from washline.llm.docstats import SHARES, document_counts, share

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, or value <= threshold
    threshold: float

    def test(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def expression(self) -> Column:
        value = share(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    support: int  # rejects covered in the pruning third
    precision: float

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.test(x[c.feature]) for c in self.conditions])

    def expression(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expression()
        return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the highest FOIL gain over the rows still covered."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 / (p0 + n0)) if p0 else 0.0
    top: tuple[float, Condition | None] = (0.0, None)
    for name in sorted(x):
        order = np.argsort(x[name], kind="stable")
        v, hit = x[name][order], np.cumsum(bad[order])
        last = np.flatnonzero(np.append(v[1:] != v[:-1], False))  # cuts between unequal values
        if not len(last):
            continue
        rows = last + 1
        for above in (True, False):
            p = p0 - hit[last] if above else hit[last]
            n = (len(v) - rows if above else rows) - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            k = int(gain.argmax())
            if gain[k] > top[0] + 1e-9:
                cut = float(v[last[k]] + v[last[k] + 1]) / 2
                top = (float(gain[k]), Condition(name, above, cut))
    return top


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.97, min_support: int = 3,
          seed: int = 5) -> list[Rule]:
    """Sequential covering over feature columns ``x`` and reject labels ``bad``."""
    rng = np.random.default_rng(seed)
    grow = rng.random(len(bad)) < 2 / 3
    alive = np.ones(len(bad), bool)
    rules: list[Rule] = []
    pick = lambda m: {k: v[m] for k, v in x.items()}
    while (alive & grow & bad).any() and (alive & ~grow & bad).any():
        inside = alive & grow
        conditions: list[Condition] = []
        while (inside & ~bad).any():
            _, c = _best(pick(inside), bad[inside])
            if c is None:
                break
            conditions.append(c)
            inside &= c.test(x[c.feature])
        if not conditions:
            break
        third = alive & ~grow

        def worth(cs, third=third):
            m = third & Rule(tuple(cs), 0, 0).matches(x)
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return ((p - n) / (p + n) if p + n else -1.0), int(p), p / max(1, p + n)

        while len(conditions) > 1 and worth(conditions[:-1])[0] >= worth(conditions)[0]:
            conditions.pop()
        _, support, precision = worth(conditions)
        if precision < min_precision or support < min_support:
            break
        rules.append(Rule(tuple(conditions), support, float(precision)))
        alive &= ~rules[-1].matches(x)
    return rules


def learn_from(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[Rule]:
    """Learn from the statistics of documents with a quality label (null labels teach nothing).

    At most ``max_rows`` labelled rows reach the driver, the first by a hash of the id.
    """
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"))
    rows = stats.join(marked, "doc_id").select("_q", "doc_id", *[share(n).alias(n) for n in SHARES])
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rows = hash_sample(rows, max_rows, total, "doc_id", *SHARES).toPandas()
    x = {n: rows[n].to_numpy(float) for n in SHARES}
    return learn(x, rows["_q"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional expression: number of the first match, or null."""
    out = None
    for i, r in enumerate(rules):
        out = F.when(r.expression(), F.lit(i)) if out is None else out.when(r.expression(), F.lit(i))
    return out.otherwise(F.lit(None)) if out is not None else F.lit(None).cast("int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: its counts, base_failed, rule (index of the learned rule it meets) and kept.

    The base rule rejects documents under 50 words and those of whose words over half lie in
    repeated three-word windows; the learned list judges the rest. Null and empty texts have no
    words and fail the base rule. Labels on rows the classifiers hold out are not used. Without
    labels, or with labels of one kind, the list is empty and only the base rule rejects.
    """
    stats, _ = scratch_table(document_counts(docs), "counts")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rules = learn_from(stats.where(~failed), labels.where(~held_out(F.col("doc_id"))))
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def op8_query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                 spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
