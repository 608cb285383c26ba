"""INSERT IGNORE under several unique keys against one row at a time."""

import random

import pytest

from washline.operators.sinks import insert_ignore_keys

KEYS = [["user_id"], ["username"], ["email"]]
ROW = "n long, user_id long, username string, email string"


def loop(base, rows):
    held = [{r[i] for r in base if r[i] is not None} for i in (1, 2, 3)]
    out = []
    for r in sorted(rows):
        if all(v is None or v not in h for v, h in zip(r[1:], held, strict=True)):
            out.append(r)
            for v, h in zip(r[1:], held, strict=True):
                h.add(v)
    return out


def run(spark, base, rows):
    got = insert_ignore_keys(spark.createDataFrame(base, ROW), spark.createDataFrame(rows, ROW), KEYS, "n")
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True), (3, True)])
def test_equals_one_row_at_a_time(spark, seed, hot):
    rng = random.Random(seed)

    def row(i):
        return (i, rng.randrange(300), f"u{rng.randrange(250)}",
                "hot@x" if hot and rng.random() < 0.34 else rng.choice([None, f"e{rng.randrange(200)}"]))
    base = [row(-i) for i in range(1, 30)]
    rows = [row(i) for i in range(500)]
    rng.shuffle(rows)
    assert run(spark, base, rows) == loop(base, rows)


def test_a_refused_row_blocks_nobody(spark):
    # 1 takes a; 2 is refused by a and so does not hold b; 3 takes b; 4 waits for 3; 5 has only NULLs beside its id
    rows = [(1, 1, "a", "x"), (2, 2, "a", "b"), (3, 3, "c", "b"), (4, 4, "c", "d"), (5, 5, None, None), (6, 6, None, None),
            (7, 4, "z", None)]
    assert [r[0] for r in run(spark, [], rows)] == [1, 3, 5, 6, 7] == [r[0] for r in loop([], rows)]


def test_chains_and_empty_tables(spark):
    chain = [(i, i, f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(40)]
    assert run(spark, [], chain) == loop([], chain)
    assert run(spark, chain, []) == [] and run(spark, chain, chain) == []
