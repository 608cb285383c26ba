"""Benchmark decontamination: documents that hold a benchmark item up to a few edits.

A document is contaminated by an item of n characters if some stretch of its text is within edit
distance floor(``rate`` * n) of it, both with case folded and blank runs made one space.

- Item-sized windows. Cut into k + 2 pieces, an item with at most k edits keeps two pieces whole. So
  only windows with two pieces in place (up to k characters of shift) can be within reach; an
  Aho-Corasick pass over each whole text finds them all.
- CGK embedding. A random walk copies a string into three times its length, repeating each character
  a random number of times that depends on it; strings a few edits apart fall into step again, so
  their embeddings differ in few places. Window and item are embedded by the same walk.
- Bit-sampling LSH, repeated. A table samples a few places of the embedding; a window and an item of
  its size are a candidate if they agree at all of a table's places. The number of tables is set
  for each class of item lengths, from walks over all its items randomly edited, so that a pair at
  the largest distance is found with probability at least ``recall``. Where ``MAX_TABLES`` do not
  reach that, and for items above ``LONG`` characters, every window is a candidate.
- Exact verification. Candidates are decided by the bit-parallel edit distance over the window
  and its surroundings.

The benchmark is a small table, searched for in slices of at most ``SLICE_BYTES`` of item text;
a larger one takes several passes over the documents.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm.common import free_name

SLICE_BYTES = 1 << 20
SAMPLES = 3  # places per table
MAX_TABLES = 64
LONG = 4096  # characters of an item above which its windows are verified without embedding
OUT = "doc_id bigint, item_id bigint, distance int, begin bigint, end bigint, matched string"
#: The search's own rows: also the digest of the document's whole text as it came.
FOUND = f"{OUT}, key binary"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def best_match(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` closest to ``pattern``, if within ``limit``.

    Myers' bit-parallel algorithm, the pattern as one wide integer.
    """
    n = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        plus = ((down << 1) & full) | (full & ~(d | up))
        minus = up & d
        if score < best:
            best, end = score, j
    return (best, end) if best <= limit else None


class Walks:
    """``tables`` independent CGK walks, and the places each table samples."""

    SLOTS = 257

    def __init__(self, tables: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.steps = rng.integers(0, 2, (tables, 1024, self.SLOTS), dtype=np.int8)
        self.places = np.sort(rng.random((tables, SAMPLES)), axis=1)

    def keys(self, strings: list[str], n: np.ndarray, tables: int) -> np.ndarray:
        """(tables, strings, SAMPLES): each string's embedding at the places for items of size ``n``."""
        wide = int(max(n.max(), max(map(len, strings)))) if len(n) else 0
        text = np.zeros((len(strings), 3 * wide + 1), np.int64)  # beyond its end a string is blank
        for i, s in enumerate(strings):
            cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
            text[i, :len(cp)] = cp % 256 + 1
        out = np.zeros((tables, len(strings), SAMPLES), np.int64)
        place = (self.places[:tables, None, :] * (2 * n)[None, :, None]).astype(np.int64)
        i = np.zeros((tables, len(strings)), np.int64)
        row, table = np.arange(len(strings))[None, :], np.arange(tables)[:, None]
        for j in range(int(place.max()) + 1 if len(strings) else 0):
            c = text[row, i]
            out = np.where(place == j, c[:, :, None], out)
            i += self.steps[table, j % 1024, c]
        return out

    def agree(self, a: list[str], b: list[str], tables: int) -> np.ndarray:
        """(tables, pairs): does the table send window a and item b of the pair to one bucket?"""
        n = np.array([len(s) for s in b])
        return (self.keys(a, n, tables) == self.keys(b, n, tables)).all(2)


def edited(text: str, edits: int, rng: random.Random) -> str:
    out = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 1 / 3 or not out:
            out.insert(i, rng.choice("abcdefghijklmnopqrstuvwxyz "))
        elif kind < 2 / 3:
            out[min(i, len(out) - 1)] = rng.choice("abcdefghijklmnopqrstuvwxyz ")
        else:
            del out[min(i, len(out) - 1)]
    return "".join(out)


def tables_for(items: list[str], rate: float, recall: float, seed: int = 11) -> list[int]:
    """For each item the tables needed so that, with the largest number of edits, it is found with
    ``recall``; 0 if ``MAX_TABLES`` do not reach that: its windows are all verified.

    Measured over all items of its length class (lengths up to the next power of two).
    """
    rng = random.Random(seed)
    walks = Walks(MAX_TABLES, seed)
    sizes = defaultdict(list)
    for k, s in enumerate(items):
        if len(s) <= LONG:
            sizes[len(s).bit_length()].append(k)
    out = [0] * len(items)
    for own in sizes.values():
        miss = []
        for at in range(0, len(own), 200):
            some = [items[k] for k in own[at:at + 200]]
            other = [(edited(s, int(rate * len(s)), rng) + rng.choice(some))[:len(s)] for s in some]
            miss.append((1 - walks.agree(other, some, MAX_TABLES).mean(0)).clip(0, 1))
        miss = np.concatenate(miss)
        # the mean over items of missing all of so many tables
        enough = next((t for t in range(1, MAX_TABLES + 1) if (miss ** t).mean() <= 1 - recall), 0)
        for k in own:
            out[k] = enough
    return out


class Search:
    """The prepared items of one slice of the benchmark, with the number of tables of each."""

    def __init__(self, items: list[tuple[int, str]], rate: float, tables: list[int]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.limit = np.array([int(rate * len(t)) for t in self.texts], np.int64)
        self.tables = np.array(tables, np.int64)
        self.walks = Walks(max(tables, default=0))
        pieces = defaultdict(list)
        for k, t in enumerate(self.texts):
            p = min(len(t), int(self.limit[k]) + 2)
            for j in range(p):
                a, b = j * len(t) // p, (j + 1) * len(t) // p
                pieces[t[a:b]].append((k, a))
        self.automaton = ahocorasick.Automaton()
        for s, places in pieces.items():
            self.automaton.add_word(s, (len(s), places))
        if pieces:
            self.automaton.make_automaton()
        self.pieces = len(pieces)

    def windows(self, text: str) -> list[tuple[int, int]]:
        """(item, start) of item-sized windows that keep two pieces in place."""
        if not self.pieces:
            return []
        hits = [(k, end + 1 - n - a, a) for end, (n, places) in self.automaton.iter(text)
                for k, a in places]
        if not hits:
            return []
        h = np.array(hits, np.int64)
        single = np.array([len(self.texts[k]) < 2 for k in h[:, 0]])
        if len(h) < 2 and not single.any():
            return []
        h = h[np.lexsort((h[:, 2], h[:, 1], h[:, 0]))]
        near = ((h[1:, 0] == h[:-1, 0]) & (h[1:, 1] - h[:-1, 1] <= self.limit[h[1:, 0]])
                & (h[1:, 2] != h[:-1, 2]))
        ok = np.zeros(len(h), bool)
        ok[1:] |= near
        ok[:-1] |= near
        ok |= np.array([len(self.texts[k]) < 2 for k in h[:, 0]])
        # hits of one item within half its shift count as one window
        grain = np.maximum(1, self.limit[h[ok, 0]] // 2)
        _, first = np.unique(np.stack([h[ok, 0], h[ok, 1] // grain], 1), axis=0, return_index=True)
        return [(int(k), int(s)) for k, s, _ in h[ok][first]]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, begin, end) of the best match of each item in each text."""
        pairs = [(d, k, s) for d, t in enumerate(texts) for k, s in self.windows(t)]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for at in range(0, len(pairs), 512):
            part = pairs[at:at + 512]
            window = [texts[d][max(0, s):max(0, s) + len(self.texts[k])] for d, k, s in part]
            item = [self.texts[k] for _, k, _ in part]
            hit = np.array([a == b for a, b in zip(window, item, strict=True)])
            tables = self.tables[[k for _, k, _ in part]]
            for n in np.unique(tables[~hit]).tolist():
                rest = np.flatnonzero(~hit & (tables == n))
                hit[rest] = n == 0 or self.walks.agree(
                    [window[i] for i in rest], [item[i] for i in rest], n).any(0)
            for i in np.flatnonzero(hit).tolist():
                d, k, s = part[i]
                n, limit = len(item[i]), int(self.limit[k])
                low = max(0, s - 2 * limit)
                if found.get((d, k), (n,))[0] == 0:
                    continue
                if window[i] == item[i]:
                    match = (0, max(0, s), max(0, s) + n)
                else:
                    around = texts[d][low:max(0, s) + n + 2 * limit]
                    got = best_match(item[i], around, limit)
                    if got is None:
                        continue
                    back = best_match(item[i][::-1], around[:got[1]][::-1][:n + limit], got[0])
                    match = (got[0], low + got[1] - back[1], low + got[1])
                if (d, k) not in found or match < found[d, k]:
                    found[d, k] = match
        for (d, k), (distance, begin, end) in found.items():
            yield d, k, distance, begin, end


def _search(items: list[tuple[int, str]], rate: float, tables: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, rate, tables)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                whole, texts, size, begin = [], [], 0, at
                while at < batch.num_rows and (not texts or size < 1 << 21):
                    whole.append(batch.column(1)[at].as_py() or "")
                    texts.append(normal(whole[-1]))
                    size += len(texts[-1])
                    at += 1
                rows = [(batch.column(0)[begin + d].as_py(), search.ids[k], distance, b, e, texts[d][b:e],
                         hashlib.md5(whole[d].encode("utf-8", "surrogatepass")).digest())
                        for d, k, distance, b, e in search.search(texts)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                            pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()),
                            strict=True)],
                        names=["doc_id", "item_id", "distance", "begin", "end", "matched", "key"])
    return run


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, recall: float = 0.995) -> DataFrame:
    """(doc_id, item_id, distance, begin, end, matched): items found in documents.

    One row per document row and item, its closest match; begin, end and matched refer to the
    normalised text. Null or blank texts and items match nothing; items with equal text match
    each by itself, and items without an id like others (their rows have a null item_id); items shorter than 1 / ``rate`` characters must match exactly. Repeated rows
    give repeated results. Empty tables give an empty result.
    """
    return _found(docs, benchmark, rate, recall).drop("key")


def _found(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, recall: float = 0.995) -> DataFrame:
    """``matches`` with ``key``, the digest of the document's whole text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(
        F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where(F.col("text").isNotNull())
    result = None
    for k in range(slices):
        # at most about SLICE_BYTES of items at a time reach the driver and the tasks
        part = sorted(((r["item_id"], normal(r["text"])) for r in items.where(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()),
            key=lambda item: (item[0] is None, item[0] or 0, item[1]))
        part = [(i, t) for i, t in part if t]
        if not part:
            continue
        tables = tables_for([t for _, t in part], rate, recall)
        found = texts.mapInArrow(_search(part, rate, tables), FOUND)
        result = found if result is None else result.unionByName(found)
    return result if result is not None else spark.createDataFrame([], FOUND)


def without_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; all others stay as they are.

    Documents are told apart by id and digest of the text: a contaminated row takes rows of the same
    id (or also without one) and equal text with it, and no others.
    """
    own, id_name, key = free_name(docs, "_key"), free_name(docs, "_hit"), free_name(docs, "_sum")
    found = _found(docs, benchmark).select(F.col("doc_id").alias(id_name), F.col("key").alias(key)).distinct()
    rows = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return rows.join(found, rows["doc_id"].cast("bigint").eqNullSafe(found[id_name])
                     & (rows[own] == found[key]), "left_anti").drop(own)


def op7_query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                   spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "item_id", "distance")
