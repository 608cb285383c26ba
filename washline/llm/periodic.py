"""Periodic runs of words: stretches that repeat one block of words four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least
max(6, 4q) words long, that no neighbouring word extends. Every text is searched whole, with any
period up to a quarter of its words.

Runs with periods under ``DIRECT`` come from scans at each lag. The others come from minimizers, one
scale per power of two. At scale P, for periods in [P, 2P), grams of P/2 words are hashed (the hash of
a gram joins those of its halves, so that each scale costs one step), grams that recur within P/8 are
set aside, and of every P/2 neighbouring gram places those with the least hash are kept. Inside a run
the same windows return one period later, so the same minimum does; places of equal minima that lie
[P, 2P) apart are the seeds. Seeds are extended word by word in both directions, and stretches that
are long enough and have no smaller period are runs.

No run is lost. A run of period q in [P, 2P) is at least 4q long; leaving P/8 grams at either side,
at least q successive windows lie in it together with their shift by q. Were all grams of these set
aside, they would share a period of at most P/8, and with q a smaller one than q. So one window has a
minimum that is not set aside, and its shift has the same. Places of one gram that is not set aside are
over P/8 apart, so each has at most 16 partners: the work is linear per scale.

Documents are searched in groups of some ``GROUP`` words laid end to end with unequal separators; a
longer document is a group of its own (some 100 bytes a word while it is searched). Null and empty
texts, and texts of blanks, have no words and no runs. Repeated rows are separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.common import WORD_PATTERN, free_name

DIRECT = 16
GROUP = 200_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _least(period: int) -> int:
    return max(6, 4 * period)


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Half-open stretches of True with at least ``least`` entries."""
    edge = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _join_grams(h: np.ndarray, half: int) -> np.ndarray:
    """Hashes of grams twice as long from those of ``half`` words."""
    return _mix(h[:-half] * np.uint64(0x94D049BB133111EB) + _mix(h[half:]))


def minimizer_seeds(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places x and distances d in [scale, 2 * scale) of equal minima, from the hashes of grams of
    scale / 2 words."""
    width, near = scale // 2, scale // 8
    none = np.empty(0, np.int64)
    if len(grams) < width + scale:
        return none, none
    key = grams >> np.uint64(1)  # leaves the largest value for grams set aside
    order = np.argsort(key, kind="stable")
    twin = (key[order][1:] == key[order][:-1]) & (np.diff(order) <= near)
    top = np.uint64(np.iinfo(np.uint64).max)
    key[order[:-1][twin]] = top
    key[order[1:][twin]] = top
    least = _window_min(key, width)
    # a place is a minimum of some window around it if the largest of these windows' minima is its own
    wide = np.zeros(len(key) + width - 1, np.uint64)
    wide[width - 1:width - 1 + len(least)] = least
    best = np.uint64(np.iinfo(np.uint64).max) - _window_min(top - wide, width)
    picked = np.flatnonzero((best == key) & (key != top))
    picked = picked[np.argsort(key[picked], kind="stable")]
    name = key[picked]
    places, distances = [none], [none]
    for step in range(1, len(picked)):
        d = picked[step:] - picked[:-step]
        same = name[step:] == name[:-step]
        if not (same & (d < 2 * scale)).any():
            break
        hit = same & (d >= scale) & (d < 2 * scale)
        places.append(picked[:-step][hit])
        distances.append(d[hit])
    return np.concatenate(places), np.concatenate(distances)


def _extend(words: np.ndarray, x: int, q: int) -> tuple[int, int]:
    """The longest stretch around ``x`` of places that equal the place q later."""
    end, step = x, 64
    last = len(words) - q
    while end < last:
        part = words[end:min(end + step, last)] != words[end + q:min(end + step, last) + q]
        if part.any():
            end += int(part.argmax())
            break
        end, step = end + len(part), step * 2
    start, step = x, 64
    while start > 0:
        low = max(0, start - step)
        part = (words[low:start] != words[low + q:start + q])[::-1]
        if part.any():
            start -= int(part.argmax())
            break
        start, step = low, step * 2
    return start, end


def _prime_divisors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + ([q] if q > 1 else [])


def _primitive(words: np.ndarray, start: int, q: int) -> bool:
    """Whether q is the smallest period of a run that starts there (it has 4q words or more)."""
    block = words[start:start + q]
    return not any(np.array_equal(block, words[start + q // p:start + q // p + q]) for p in _prime_divisors(q))


def runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``words`` (numbers), by start, then period.

    ``longest``: no run can be longer than that (default: all words)."""
    words = words.astype(np.int64, copy=False)
    longest = len(words) if longest is None else longest
    found = []
    for q in range(1, min(DIRECT, longest // 4 + 1)):
        for a, b in _stretches(words[q:] == words[:-q], _least(q) - q):
            if q == 1 or _primitive(words, a, q):
                found.append((a, b - a + q, q))
    grams, size, scale = _mix(words.view(np.uint64)), 1, DIRECT
    while 4 * scale <= longest:
        while size < scale // 2:
            grams, size = _join_grams(grams, size), size * 2
        x, d = minimizer_seeds(grams, scale)
        if len(x):
            # a stretch of 3q places reaches scale further to one side of x at least
            wide = _join_grams(grams, size) if len(grams) > size else grams[:0]
            right, left = np.zeros(len(x), bool), np.zeros(len(x), bool)
            ok = x + d < len(wide)
            right[ok] = wide[x[ok]] == wide[x[ok] + d[ok]]
            back = x + size - scale
            ok = (back >= 0) & (back + d < len(wide))
            left[ok] = wide[back[ok]] == wide[back[ok] + d[ok]]
            hit = right | left
            x, d = x[hit], d[hit]
            order = np.lexsort((x, d))
            lag, covered = 0, -1
            for p, q in zip(x[order].tolist(), d[order].tolist(), strict=True):
                if q != lag:
                    lag, covered = q, -1
                if p < covered:
                    continue
                a, b = _extend(words, p, q)
                covered = b
                if b - a >= _least(q) - q and _primitive(words, a, q):
                    found.append((a, b - a + q, q))
        scale *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _search(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of several documents at once."""
    names: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    starts = np.cumsum([0, *[s + 1 for s in sizes]])
    words = np.empty(starts[-1], np.int64)
    for k, t in enumerate(texts):
        words[starts[k]:starts[k + 1] - 1] = [names.setdefault(w, len(names)) for w in t]
        words[starts[k + 1] - 1] = -1 - k
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs(words, max(sizes, default=0)):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[k].append((start - int(starts[k]), length, period))
    return out


def _kept(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that are left when each run keeps its first period, joined by one space."""
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return b" ".join(words)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(carried columns..., text) -> (carried columns..., runs, collapsed)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        column, at = batch.column(batch.num_columns - 1), 0
        while at < batch.num_rows:
            group: list[list[bytes]] = []
            size, first = 0, at
            while at < batch.num_rows and (size < GROUP or not group):
                words = (column[at].as_py() or "").encode("utf-8", "surrogatepass").split()
                if group and size + len(words) > GROUP:
                    break
                group.append(words)
                size, at = size + len(words), at + 1
            found = _search(group)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
            texts = [_kept(w, f).decode("utf-8", "replace") for w, f in zip(group, found, strict=True)]
            part = batch.slice(first, at - first)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(rows, kind), pa.array(texts, pa.string())],
                names=[*batch.schema.names[:-1], "runs", "collapsed"])


def collapse_runs(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns, runs (start, length, period; by start, then
    period) and collapsed, the words that remain when every run keeps its first period, joined by
    one space. Any columns may stand beside the text; those not carried are not read."""
    rows = docs.select(*carry, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_run, ", ".join([*fields, f"runs array<{RUN}>", "collapsed string"]))


def without_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, texts that hold runs replaced by what is left of them."""
    found, rest = free_name(docs, "runs"), free_name(docs, "collapsed")
    keep = tuple(docs.columns)
    out = collapse_runs(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]),
                        f"c{keep.index('text')}", tuple(f"c{i}" for i in range(len(keep))))
    out = out.toDF(*keep, found, rest)
    return out.withColumn("text", F.when(F.size(found) > 0, F.col(rest)).otherwise(F.col("text"))).drop(found, rest)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic tail in one document of ten.

    h is the CRC-32 of the decimal id and g = floor(h / 10). Where h mod 10 is 0, each word i >= a becomes
    word a + (i - a) mod p, with a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)). Rows without an
    id get no tail."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    tail = (chosen.withColumn("_n", n).withColumn("_g", g)
            .withColumn("_a", F.when(F.col("_n") > 0, a))
            .withColumn("_p", F.when(F.col("_n") > 0, p)))

    def source(i: Column) -> Column:
        return F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i)

    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1),
                                    lambda i: F.get(F.col("_w"), source(i))), " ")
    return tail.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_query(spark, sf_dir: str) -> DataFrame:
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = collapse_runs(docs)
    rank = F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"),
                                                  (-r["period"]).alias("q"), r.alias("r")))
    best = F.when(F.size("runs") > 0, F.array_max(rank)["r"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n"))), "")
    return out.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
