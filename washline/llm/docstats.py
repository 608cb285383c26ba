"""Statistics of whole texts, for quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.textfeat import code_points, letter_table

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\v\f\r"
#: Counts per document, all long. The first five are the base statistics.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
          "n_upper", "n_digits", "n_marks", "n_bare_words", "n_adjacent", "n_distinct", "longest_word"]
#: Shares the learners see: numerator, denominator.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "bare_share": ("n_bare_words", "n_words"),
    "adjacent_share": ("n_adjacent", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "letter_share": ("n_letters", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


@cache
def _upper_table() -> np.ndarray:
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str | None) -> list[int]:
    """The values of COUNTS for one text; all 0 for null. Linear in the text."""
    if not text:
        return [0] * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    repeated = np.zeros(n, bool)
    if n >= 3:
        pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
        triple = pair[:-1] * len(names) + ids[2:]
        _, inverse, times = np.unique(triple, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        for k in range(3):
            repeated[k:n - 2 + k] |= again
    cp = code_points(text)
    letters = letter_table()[cp]
    bare = {i for w, i in names.items() if not any(c.isalnum() for c in w.decode("utf-8", "replace"))}
    return [n, len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, SYMBOLS)), dup,
            int(repeated.sum()), lines, int(letters.sum()), int(_upper_table()[cp].sum()),
            int(((cp >= 48) & (cp <= 57)).sum()), text.count("!") + text.count("?"),
            int(np.isin(ids, np.fromiter(bare, np.int64, len(bare))).sum()) if bare else 0,
            int((ids[1:] == ids[:-1]).sum()), len(names), max(map(len, words), default=0)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([counts(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in rows.T]],
                                         names=["doc_id", *COUNTS])


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS, one row per row of ``docs`` (doc_id, text, any others)."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def share(name: str) -> Column:
    """A share as an expression over COUNTS; 0 where its denominator is 0."""
    a, b = SHARES[name]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
