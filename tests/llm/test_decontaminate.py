"""Benchmark decontamination against a plain dynamic programme; recall of planted edits."""

import random

from washline.llm import decontaminate as d


def plain_distance(pattern, text):
    """Smallest edit distance of ``pattern`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_plain():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        got = d.best_match(p, t, len(p))
        assert got[0] == plain_distance(p, t)
        assert d.best_match(p, t, got[0] - 1) is None


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def _cases():
    rng = random.Random(8)
    items = [(i, _words(rng, rng.randint(12, 50))) for i in range(25)] + [(90, "Short Item"), (91, None), (92, " ")]
    rows, expect = [], {}
    for i in range(240):
        text = _words(rng, 60)
        if i % 2 == 0:
            item_id, item = items[rng.randrange(25)]
            e = d.edited(item, rng.randint(0, int(0.1 * len(item))), rng)
            if i % 4 == 0:
                e = e.upper().replace(" ", " \n")
            text = text[:150] + " " + e + " " + text[150:]
            expect[i] = item_id
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, "x" * 4000), (903, items[0][1]), (904, "a short item here"), (None, items[1][1])]
    return items, rows, expect


def test_planted_items_are_found_and_clean_documents_left(spark, docs):
    items, rows, expect = _cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in d.matches(docs(rows), bench).collect()}
    text = dict(rows)
    brute = {(i, k): plain_distance(d.normal(t), d.normal(text[i])) for i, k in expect.items()
             for j, t in items if j == k}
    near = {p for p in brute if brute[p] <= int(0.1 * len(d.normal(dict(items)[p[1]])))}
    assert len(near) > 100 and len(near - set(got)) <= 1  # recall 0.995
    assert all(got[p].distance == brute[p] for p in near & set(got))
    assert set(got) - near == {(903, 0), (904, 90), (None, 1)}
    r = got[904, 90]
    assert (r.matched, r.begin, r.end, r.distance) == ("short item", 2, 12, 0)


def test_stage_and_empty_tables(spark, docs):
    items, rows, _ = _cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.without_matches(docs(rows[-6:]), bench)
    assert {r.doc_id for r in kept.collect()} == {900, 901, 902}
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert d.matches(docs([]), bench).count() == 0
    assert d.without_matches(docs(rows[-6:]), bench.limit(0)).count() == 6


def test_stage_keeps_clean_rows_that_share_an_id_with_contaminated_ones(spark, docs):
    items, _, _ = _cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad, clean = "é " + items[0][1], "clean words that no item holds"
    rows = [(None, bad), (None, bad), (None, clean), (None, None), (7, bad), (7, clean), (7, ""), (8, bad), (9, clean)]
    kept = d.without_matches(docs(rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted(
        (str(i), str(t)) for i, t in rows if t != bad)


def test_long_items_at_the_edit_limit_are_all_found(spark, docs):
    rng = random.Random(3)
    short = [(i, _words(rng, rng.randint(12, 50))) for i in range(60)]
    long = [(100 + i, _words(rng, n)) for i, n in enumerate((150, 300, 600, 900) * 3)]
    rows, near = [], set()
    for i in range(36):
        item_id, item = long[i % len(long)]
        e = d.edited(item, int(0.1 * len(item)), rng)
        rows.append((i, f"{_words(rng, 30)} {e} {_words(rng, 30)}"))
        near.add((i, item_id))
    bench = spark.createDataFrame(short + long, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.matches(docs(rows), bench).collect()} == near


def test_tables_are_set_for_each_length_and_more_than_the_most_means_all_windows():
    rng = random.Random(4)
    short, long = [_words(rng, 12) for _ in range(30)], [_words(rng, 900) for _ in range(3)]
    got = d.tables_for(short + long, 0.1, 0.995)
    assert len(set(got[-3:])) == 1 and got[-1] == 0 and d.tables_for([], 0.1, 0.995) == []
    exact = d.tables_for(["seven", "eight", *long], 0.1, 0.995)
    assert exact[:2] == [1, 1] and exact[2:] == [0, 0, 0]


def test_a_large_benchmark_is_searched_in_slices(spark, docs, monkeypatch):
    items, rows, _ = _cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    pick = [r for r in rows if r[0] in (0, 4, 8, 903, 904)]
    whole = {tuple(r) for r in d.matches(docs(pick), bench).collect()}
    monkeypatch.setattr(d, "SLICE_BYTES", 1500)
    sliced = {tuple(r) for r in d.matches(docs(pick), bench).collect()}
    assert {r for r in sliced if r[2] == 0} == {r for r in whole if r[2] == 0} != set()
    assert len(sliced ^ whole) <= 1  # each slice has tables of its own, with the same recall


def test_items_without_an_id_are_searched(spark, docs):
    items, _, _ = _cases()
    bench = spark.createDataFrame([(None, items[0][1]), (None, items[1][1]), (5, items[2][1])], "item_id long, text string")
    rows = [(1, "x " + items[0][1] + " y"), (2, items[1][1]), (3, items[2][1]), (4, "clean words")]
    assert {(r.doc_id, r.item_id) for r in d.matches(docs(rows), bench).collect()} == {(1, None), (2, None), (3, 5)}
    assert [r.doc_id for r in d.without_matches(docs(rows), bench).collect()] == [4]
