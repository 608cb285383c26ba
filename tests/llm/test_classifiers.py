"""Language ID, toxicity, quality and rules: held-out accuracy, statistics by brute force, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from washline.llm import docstats, langid, quality, rules, toxicity
from washline.llm.common import held_out, word_count

MEDIUM, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_held_out_rule(spark):
    got = {r.id: r.h for r in spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(300)}


def test_word_count(spark):
    texts = [None, "", " \t\n\v\f\r", "a b", "a b　c d", "x\x1cy z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [
        len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# --- language ---------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    got = langid.op9_query(spark, MEDIUM).join(
        spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(own) > 200
    assert np.mean([r.lang == r.lang_pred for r in own]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, docs):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"),
                                                   ("le chat est sur la table", "fr"), ("el gato come pan", "es"),
                                                   ("words without a label", None), ("xq zz", "tlh")] * 6)]
    odd = [(900, None), (901, ""), (902, "123 !? 4"), (903, "the " * 50_000), (None, "the dog"), (901, "")]
    model = langid.fit(docs(rows))
    assert model.members["germanic"] == ["de", "en"] and model.members["other"] == ["tlh"]
    out = langid.identify(docs(odd).withColumn("language", F.lit("clash")), model)
    got = sorted((str(r.doc_id), r._language.lang_pred) for r in out.collect())
    assert got == [("900", "und"), ("901", "und"), ("901", "und"), ("902", "und"), ("903", "en"), ("None", "en")]
    assert langid.identify(docs([]), model).count() == 0
    none = langid.fit(docs([(1, "text", None)]))
    assert langid.identify(docs([(1, "text")]), none).first().language.lang_pred == "und"
    kept = langid.keep_identified(docs(rows + [(950, "12", "en"), (951, None, "en")]))
    assert kept.count() == len(rows) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("ids", ["null", "one"])
def test_language_sample_is_bounded_whatever_the_ids(spark, docs, ids, monkeypatch):
    rng = random.Random(1)
    words = {"en": "the cat and dog sat on mat".split(), "fr": "le chat est sur la table et".split()}
    rows = [(None if ids == "null" else 7, " ".join(rng.choice(words[la]) for _ in range(8)), la)
            for i in range(4000) for la in ["en" if i % 4 else "fr"]]
    sizes = []
    real = langid.fit_svm
    monkeypatch.setattr(langid, "fit_svm", lambda x, y, **k: (sizes.append(len(y)), real(x, y, **k))[1])
    model = langid.fit(docs(rows + [(i, "the same", "en") for i in [None] * 3000]), per_language=100)
    assert sizes and max(sizes) == 200  # both families together
    assert model.predict(["the dog and the cat", "le chat et la table"])[0] == ["en", "fr"]


# --- toxicity ---------------------------------------------------------------------------------

def _toxic_rows(biased, groups=("muslim", "jewish")):
    rng = random.Random(3)
    rows, swaps, y = [], [], []
    terms = toxicity.IdentityTerms.of(toxicity.IDENTITY_TERMS)
    plain = ["river", "stone", "light", "garden", "window", "paper", "music", "winter", "story", "bread"]
    for i in range(600):
        words = [rng.choice(plain) for _ in range(12)]
        bad = i % 3 == 0
        if bad and rng.random() < 0.85:  # some toxic texts have no insult, only the group's mention
            words[3] = rng.choice(["idiot", "moron", "scumbag"])
        if bad or rng.random() < biased:
            words[7] = rng.choice(groups)  # the label goes with a mention of a group
        f = toxicity.word_features(" ".join(words))
        rows.append(np.unique(f))
        swaps.append(terms.swaps(f))
        y.append(bad)
    return rows, swaps, np.array(y)


@pytest.mark.parametrize("groups", [("muslim", "jewish"), tuple(toxicity.IDENTITY_TERMS["religion"].split())])
def test_counterfactual_penalty_frees_neutral_mentions(groups):
    """Also where the texts mention all groups of the kind, so that swapping alone would change nothing."""
    rows, swaps, y = _toxic_rows(0.1, groups)
    names = np.unique(np.concatenate(rows))
    plain = toxicity.fit(names, rows, y, fairness=0.0, swaps=swaps)
    fair = toxicity.fit(names, rows, y, swaps=swaps)
    none = lambda m: m.score("the family baked bread")
    for who in ("muslim", "christian", "jewish"):
        assert abs(fair.score(f"the {who} family baked bread") - none(fair)) < 0.05
        assert fair.score(f"the {who} family baked bread") < 0.3
    assert plain.score("the muslim family baked bread") - none(plain) > 0.15
    assert fair.score("what an idiot wrote this paper") > 0.5


def test_swaps_regard_the_whole_text():
    terms = toxicity.IdentityTerms.of({"a": "muslims muslim jews", "b": "wheelchair_user deaf"})
    feature = lambda t: set(np.unique(toxicity.word_features(t)).tolist())
    found = terms.swaps(toxicity.word_features("muslims and muslimah wheelchair user"))
    after = [feature(t) for t in ("and muslimah wheelchair user", "muslim and muslimah wheelchair user",
                                  "jews and muslimah wheelchair user", "muslims and muslimah", "muslims and muslimah deaf")]
    before = feature("muslims and muslimah wheelchair user")
    assert len(found) == 5
    got = [before - set(gone.tolist()) | set(new.tolist()) for gone, new in found]
    assert sorted(map(sorted, got)) == sorted(map(sorted, after))
    assert terms.swaps(toxicity.word_features("the user of a wheelchair")) == [] == terms.swaps(toxicity.word_features(""))


def test_labels_without_documents_take_no_place(spark, docs):
    rows = [(i, "you idiot" if i % 4 == 0 else "fine words") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(20_000)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(rows), labels, max_per_label=40)
    assert model.score("what an idiot") > 0.5 > 0.3 > model.score("fine words")
    # one id on many rows teaches once
    model = toxicity.train(docs(rows + [(3, f"fine {i}") for i in range(300)]), labels, max_per_label=40)
    assert model.score("what an idiot") > 0.5


def test_weighted_rows_fit_like_repeated_rows():
    rng = random.Random(5)
    rows = [np.unique(toxicity.word_features(" ".join(rng.choice("ab cd ef gh idiot moron".split()) for _ in range(3))))
            for _ in range(80)]
    y = np.array([rng.random() < 0.5 for _ in rows])
    names = np.unique(np.concatenate(rows))
    times = np.where(y, 1, 4)
    weighted = toxicity.fit(names, rows, y, weight=times)
    repeated = toxicity.fit(names, [r for r, k in zip(rows, times) for _ in range(k)], np.repeat(y, times))
    assert np.allclose(weighted.weights, repeated.weights) and weighted.intercept == pytest.approx(repeated.intercept)


def test_toxicity_scores_do_not_depend_on_the_bound_of_the_sample(spark, docs):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(1600):
        bad = i % 8 == 0
        word = rng.choice(["idiot", "hello", "maybe"]) if bad else rng.choice(["hello", "hello", "maybe"])
        rows.append((i, f"some {word} text"))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    whole, bounded = (toxicity.train(docs(rows), labels, max_per_label=n) for n in (4000, 140))
    for text in ("nothing known", "some hello text", "some maybe text"):
        assert bounded.score(text) == pytest.approx(whole.score(text), abs=0.06)
    assert whole.score("some maybe text") < 0.3 and bounded.score("some maybe text") < 0.3
    assert whole.score("some idiot text") > 0.5 and bounded.score("some idiot text") > 0.5


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = toxicity.op1_query(spark, MEDIUM).join(labels, "doc_id", "left").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    clean = [r.predicted for r in got if r.held_out and r.toxic == 0]
    assert np.mean(clean) < 0.05
    # a twentieth of the toxic labels stand on texts like the clean ones; of 14 here, 9 can be known from the rest
    assert sum(r.predicted for r in got if r.held_out and r.toxic == 1) >= 9


def test_toxic_documents_are_caught(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    got = toxicity.op1_query(spark, LARGE).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted for r in got if r.toxic == 1]) >= 0.85
    assert np.mean([r.predicted for r in got if r.toxic == 0]) <= 0.01


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, None), (99, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = [(1, "you idiot"), (2, "fine words"), (3, None), (4, ""), (None, "12 !"), (1, "you idiot"), (5, "a " * 50_000)]
    out = toxicity.score_documents(docs(rows).withColumn("toxicity", F.lit(0)), labels).collect()
    assert len(out) == len(rows) and all(0 < r._toxicity < 1 for r in out)
    assert toxicity.score_documents(docs([]), labels).count() == 0
    assert toxicity.score_documents(docs(rows), labels.limit(0)).count() == len(rows)


# --- statistics -------------------------------------------------------------------------------

def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)]


def test_counts_equal_brute_force():
    rng = random.Random(6)
    texts = [None, "", " \n", "a", "a b", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "é b # $$", "\U0001F600 <a|b>",
             "w\x1cw w"] + [
        "".join(rng.choice(["a", "b", "cd", " ", " ", "\n", "#", "\t", "\r", "é"]) for _ in range(rng.randint(1, 400)))
        for _ in range(200)]
    for t in texts:
        assert docstats.counts(t)[:5] == brute_counts(t), repr(t)


# --- quality ----------------------------------------------------------------------------------

def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    got = quality.op10_query(spark, LARGE).join(labels, "doc_id", "left").collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    own = [r for r in got if r.held_out and r.quality is not None]
    assert np.mean([r.predicted for r in own if r.quality == 1]) > 0.95
    assert np.mean([r.predicted for r in own if r.quality == 0]) < 0.2


def test_class_prior_estimate():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    for prior in (0.2, 0.5, 0.9):
        n = int(4000 * prior)
        mixed = np.concatenate([good[:n], bad[:4000 - n]])
        bins = lambda z: quality.histogram(1 / (1 + np.exp(-z)))
        assert quality.estimate_prior(bins(rng.normal(2, 1, 4000)), bins(mixed)) == pytest.approx(prior, abs=0.08)


def test_quality_of_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 50_000), (3, "word " * 50_000)]
    labels = spark.createDataFrame([(1, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs(rows), labels).count() == 5
    assert [r.score for r in quality.score_documents(docs(rows), labels.limit(0)).collect()] == [0.5] * 5
    assert quality.score_documents(docs([]), labels).count() == 0


# --- rules ------------------------------------------------------------------------------------

def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(2)
    x = {"symbol_share": rng.random(3000), "upper_share": rng.random(3000), "mark_share": rng.random(3000)}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["mark_share"] <= 0.3))
    found = rules.learn(x, bad)
    rejected = np.logical_or.reduce([r.matches(x) for r in found])
    assert (rejected & ~bad).sum() <= 0.01 * (~bad).sum() and (rejected & bad).sum() >= 0.97 * bad.sum()
    assert all(r.precision >= 0.97 for r in found) and len(found) <= 6
    assert rules.learn(x, np.zeros(3000, bool)) == [] and rules.learn(x, np.ones(3000, bool)) == []


def test_verdicts_of_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    assert len(got) == 1000
    for r in docs.collect():
        c = brute_counts(r.text)
        g = got[r.doc_id]
        assert [g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words] == c
        assert g.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert g.kept == (not g.base_failed and g.rule is None)
    judged = [(r.quality, got[r.doc_id].kept) for r in labels.collect()
              if r.doc_id in got and not got[r.doc_id].base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.98


def test_rules_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (None, "a b c " * 40), (3, " ".join(map(str, range(60)))), (3, "w " * 20_000)]
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in rules.judge(docs(rows), labels).collect()}
    assert got == {(1, 0): (True, False), (2, 0): (True, False), (None, 120): (True, False),
                   (3, 60): (False, True), (3, 20_000): (True, False)}
    assert rules.judge(docs([]), labels.limit(0)).count() == 0
