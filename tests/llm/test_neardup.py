"""Near-duplicates against brute force; signatures against exact similarity; components."""

import random
from collections import Counter

import numpy as np
import pytest

from washline.llm import dartminhash as dart
from washline.llm import neardup
from washline.llm.components import components


def _multiset(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _similar(a, b):
    both = sum((a & b).values())
    return bool(a) and bool(b) and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) - 1e-9


def brute_classes(rows):
    """(position -> smallest id of its class) by comparing all texts."""
    sets = [_multiset(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or _similar(sets[i], sets[j]):
                up[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return [ids.get(top(i)) for i in range(len(rows))]


def _corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, n = [], 0
    origin = [word() for _ in range(140)]
    for k in range(60):  # a large group of near copies, many at the edge of the threshold
        w = list(origin)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((n := n + 1, " ".join(w)))
    for k in range(12):
        w = [word() for _ in range(rng.choice([3, 5, 30, 200]))]
        rows += [(n + 1, " ".join(w)), (n + 2, "\n".join(w)), (n + 3, " ".join(w + [word()]))]
        n += 3
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1]), (n + 2, rows[0][1])]
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[-1][1]), (None, "only here and nowhere else at all"),
             (503, "spam ham " * 3000), (504, "spam ham " * 2900)]
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark, docs):
    rows = _corpus()
    got = neardup.classes(docs(rows)).collect()
    text = dict(zip(rows, brute_classes(rows)))
    import hashlib
    expect = sorted((str(d), hashlib.md5((t or "").encode()).hexdigest(), str(c)) for (d, t), c in zip(rows, brute_classes(rows)))
    assert len(text) and sorted((str(r.doc_id), r.key.hex(), str(r.class_id)) for r in got) == expect


def test_keep_first_keeps_one_of_each_class(spark, docs):
    rows = _corpus(9)
    kept = neardup.keep_first(docs(rows)).collect()
    want = {c for c in brute_classes(rows) if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in kept) == sum(c is None for c in set(brute_classes(rows)))


def _copies(word, n=60):
    """A text and two near copies of it."""
    w = [f"{word}{i}" for i in range(n)]
    return [" ".join(w), " ".join([*w, "end"]), " ".join([*w, "last", "end"])]


def test_unlike_classes_that_share_their_smallest_id_each_keep_a_text(spark, docs):
    a, b, c = _copies("ant"), _copies("bee"), _copies("cat")
    rows = [(7, a[0]), (8, a[1]), (9, a[2]), (7, b[0]), (11, b[1]), (7, b[2]), (12, c[0]), (None, c[1])]
    kept = sorted((r.doc_id, r.text) for r in neardup.keep_first(docs(rows)).collect())
    assert kept[0] == (7, a[0]) and kept[1] in {(7, b[0]), (7, b[2])} and kept[2:] == [(12, c[0])]
    got = neardup.classes(docs(rows)).collect()
    assert len({r.root for r in got}) == 3 and {r.class_id for r in got} == {7, 12}


def test_query_tells_classes_of_one_smallest_id_apart(spark, docs, tmp_path):
    a, b = _copies("ant"), _copies("bee")
    docs([(7, a[0]), (8, a[1]), (7, b[0]), (9, b[1]), (None, "by itself")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = neardup.op6_query(spark, str(tmp_path)).collect()
    key = {r.doc_id: r.class_key for r in got if r.doc_id != 7}
    assert sorted((str(r.class_id), r.class_key) for r in got) == sorted(
        [("7", key[8])] * 2 + [("7", key[9])] * 2 + [("None", key[None])]) and len(set(key.values())) == 3


def test_near_copies_without_any_id_keep_one_row(spark, docs):
    a, b = _copies("ant"), _copies("bee")
    rows = [(None, t) for t in [*a, a[0], b[0], b[0], "alone among them all here", None, ""]]
    kept = [r.text for r in neardup.keep_first(docs(rows)).collect()]
    assert len(kept) == 4 and sum(t in a for t in kept) == 1 and kept.count(b[0]) == 1
    assert kept.count("alone among them all here") == 1


def test_empty_table(spark, docs):
    assert neardup.classes(docs([])).count() == 0
    assert neardup.keep_first(docs([])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("n,edits", [(3, 0), (8, 1), (80, 2), (400, 6), (2000, 10)])
def test_signatures_estimate_weighted_similarity(n, edits):
    rng = random.Random(n)
    error = []
    for _ in range(12):
        a = [rng.choice("abcdefgh") for _ in range(n)]
        b = list(a)
        for _ in range(edits):
            b[rng.randrange(n)] = "zz"
        s, _ = dart.signatures([" ".join(a).encode(), " ".join(b).encode()], 256)
        x, y = _multiset(" ".join(a)), _multiset(" ".join(b))
        both = sum((x & y).values())
        error.append((s[0] == s[1]).mean() - both / (sum(x.values()) + sum(y.values()) - both))
    assert abs(np.mean(error)) < 0.04 and max(map(abs, error)) < 0.15


def test_a_signature_does_not_depend_on_its_batch():
    texts = [b"one two three four five six seven", b"", b"a b", b"x " * 5000]
    alone = [dart.signatures([t], 96)[0][0] for t in texts]
    together = dart.signatures(texts[::-1], 96)[0][::-1]
    assert all((a == b).all() for a, b in zip(alone, together, strict=True))


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    df = spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in links], "a string, b string")
    got = {r.node: r.root for r in components(df)[0].collect()}
    expect = {f"{i:04}": "0000" for i in range(1, 41)} | {"0101": "0100", "0102": "0100"}
    assert got == expect
    assert components(df.limit(0))[0].count() == 0
