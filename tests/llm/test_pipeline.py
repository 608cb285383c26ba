"""The pipeline: each stage against brute force on its own input, and the whole run."""

import corpus_pipeline
from tests.llm.test_neardup import brute_classes
from tests.llm.test_substrings import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SMALL).checkpoint()
        after = docs.collect()
        assert docs.columns == columns
        if name == "language ID":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert all(not any(c.isalpha() for c in r.text or "") for r in before if r.doc_id in gone)
        elif name == "near-duplicates":
            want = set(brute_classes([(r.doc_id, r.text) for r in before]))
            assert sorted(r.doc_id for r in after) == sorted(want)
        elif name == "repeated passages":
            left = {r[0]: r[1] - r[2] for r in brute([(r.doc_id, r.text) for r in before])}
            assert len(after) == len(before)
            # a letter of several bytes of which one goes is dropped whole
            assert all(left[str(r.doc_id)] - 6 * 40 <= len((r.text or "").encode()) <= left[str(r.doc_id)] for r in after)
            assert all(r.n_chars == len(r.text or "") for r in after)
        elif name == "benchmark leaks":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            holds = lambda r: any(i in " ".join((r.text or "").lower().split()) for i in items)
            assert not any(map(holds, after))
            assert {r.doc_id for r in before if not holds(r)} - {r.doc_id for r in after} == set()
        else:
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and after


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "near-duplicates", "repeated passages", "benchmark leaks", "mixing"]
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, a long text, clashing column names, and an empty table."""
    passage = "a passage of well over fifty bytes that stands in two of the texts, word for word, and goes once"
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "12 !?", "en", "a", 5),
            (4, "the river runs " + passage, "en", "a", 1), (5, passage + " and then the mill stands", "en", "b", 1),
            (5, passage + " and then the mill stands", "en", "b", 1), (None, "another text of some words here", "en", None, 1),
            (7, " ".join(f"word{i}" for i in range(30_000)), "en", "b", 1)]
    extra = [(f"x{i}",) * 5 for i in range(len(rows))]
    table = spark.createDataFrame(
        [(*r, *e) for r, e in zip(rows, extra, strict=True)],
        "doc_id long, text string, lang string, source string, n_chars long, "
        "_kept string, _id string, copies string, digest string, language string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "the benchmark item"), (1, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == table.columns
    got = out.collect()
    assert {r.doc_id for r in got} <= {None, 4, 5, 7} and any(r.doc_id == 7 for r in got)
    assert sum(passage in (r.text or "") for r in {r.text: r for r in got}.values()) <= 1
    table.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
