"""Periodic runs in texts, by the algorithm of Kolpakov and Kucherov over words.

A run is a longest stretch of words of one smallest period. Its text is factorised by
Lempel and Ziv with a suffix automaton: each factor is the longest prefix of the rest
that occurs before. Runs that touch or cross the start of a factor are found by Main's
algorithm, from longest common extensions in a window that factors bound; those
strictly within a factor are copies of runs within its earlier occurrence.

Only runs of three periods and 24 words are asked for. Every word of such a run lies in
a stretch of 16 words that occurs twice in the text, so texts are cut to the stretches
covered by repeated 16-word windows first, which loses no run and changes none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing

LEAST, PERIODS = 24, 3  # words and periods of a run
_GRAM = 16  # a run of L words and period q repeats L - q >= 2 L / 3 >= 16 of them at distance q
RUNS = "array<struct<start:long,length:long,period:long>>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _automaton(x: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of x: transitions, and where the first occurrence of each state's strings ends."""
    step, link, length, end = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(x):
        cur = len(step)
        step.append({})
        length.append(i + 1)
        end.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(end[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step, end


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start or -1) of each factor: the longest prefix of the rest that also begins before, or a new word."""
    step, end = _automaton(x)
    out, i, n = [], 0, len(x)
    while i < n:
        state, k = 0, i
        while k < n:
            to = step[state].get(x[k])
            if to is None or end[to] >= k:
                break
            state, k = to, k + 1
        out.append((i, k - i, end[state] - (k - i) + 1) if k > i else (i, 1, -1))
        i += max(k - i, 1)
    return out


def _prefixes(s: list) -> np.ndarray:
    """For each position the length of the longest common prefix of s and s from there; the first is 0."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(right - i, 0)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return np.array(z, dtype=np.int64)


def _touching(x: list[int], low: int, b: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches of three periods within x[low:high] that touch or cross b, as far as that window shows them."""
    t, v = x[low:b], x[b:high]
    back, nt, nv = t[::-1], len(t), len(v)
    most = (nt + nv) // PERIODS
    if nv:  # those with a period to the right of b
        p = np.arange(1, min(nv, most) + 1)
        right = np.append(_prefixes(v), 0)[p]
        left = _prefixes([*back, None, *v[::-1], *back])[nt + 1 + nv - p]
        ok = (left + right >= (PERIODS - 1) * p) & (left + p + right >= LEAST)
        for q, a, c in zip(p[ok].tolist(), left[ok].tolist(), right[ok].tolist()):
            yield b - a, b + q + c - 1, q
    if nt:  # those with a period to the left of b
        p = np.arange(1, min(nt, most) + 1)
        left = np.append(_prefixes(back), 0)[p]
        right = _prefixes([*v, None, *t, *v])[nv + 1 + nt - p]
        ok = (left + right >= (PERIODS - 1) * p) & (left + p + right >= LEAST)
        for q, a, c in zip(p[ok].tolist(), left[ok].tolist(), right[ok].tolist()):
            yield b - q - a, b - 1 + c, q


def runs_of(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of x of at least LEAST words and PERIODS periods, by start and period."""
    n, found = len(x), {}
    cuts = factors(x)
    ends = [*cuts, (n, 0, -1)]
    for (_, before, _), (b, size, _) in zip(ends, ends[1:]):
        # a run that ends in a factor begins less than a period before the factor before it
        if before + size < _GRAM:
            continue
        low = max(0, b - (3 * before + size) // 2 - 1)
        for s, e, p in _touching(x, low, b, b + size):
            if (s == 0 or x[s - 1] != x[s - 1 + p]) and (e == n - 1 or x[e + 1] != x[e + 1 - p]):
                found[s, e] = min(found.get((s, e), p), p)
    known = sorted((s, e, p) for (s, e), p in found.items())
    for start, size, earlier in cuts:
        if size < LEAST + 2:
            continue
        shift = start - earlier
        k = bisect_right(known, (earlier, n, n))
        while k < len(known) and known[k][0] + shift < start + size - 1:
            s, e, p = known[k]
            if e + shift < start + size - 1 and (s + shift, e + shift) not in found:
                found[s + shift, e + shift] = p
                insort(known, (s + shift, e + shift, p))
            k += 1
    return sorted((s, e - s + 1, p) for (s, e), p in found.items())


def repeated_stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Longest stretches (start, end) covered by 16-word windows whose hash occurs twice; only these can hold runs."""
    n = len(words) - _GRAM + 1
    if n < 2:
        return []
    h, size = hashing.mix(words), 1
    while size < _GRAM:
        h = hashing.mix(h[:-size] * _STEP + h[size:])
        size *= 2
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return []
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + _GRAM, -1)
    inside = np.concatenate(([False], np.cumsum(depth[:-1]) > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= LEAST]


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words."""
    if len(words) < LEAST:
        return []
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    out = []
    for a, b in repeated_stretches(hashes):
        number: dict[bytes, int] = {}
        out += [(a + s, length, p) for s, length, p in runs_of([number.setdefault(w, len(number)) for w in words[a:b]])]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for s, length, p in runs:
        keep[s + p : s + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) for each row, without a shuffle.

    ``runs`` lists start (word number from 0), length and smallest period of each run of at least 24 words and three periods,
    by start and period; ``collapsed`` is the kept words joined by one space. Words are runs
    without ASCII white space. Null and empty texts have no words, no runs and an empty ``collapsed``.
    Runs may overlap and nest; all are listed. Repeated rows, null and repeated ids give a row
    each; other columns aren't read, whatever their names; an empty table gives no rows.
    Time and memory are linear in a text's repeated part; a text is one row's work.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, texts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                found = text_runs(words)
                n_words.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(collapse(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of periodic_runs(): the number of runs, that of the greatest length/period (ties: smallest start, then period), and SHA-256 of the runs and the kept words."""

    def ahead(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(left > right, -1).when(left < right, 1).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))

    best = F.when(F.size("runs") > 0, F.array_sort("runs", ahead)[0])
    rows = found.withColumn("best", best)
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    milli = F.expr("(1000 * best.length) div best.period")
    return rows.select(id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def made_periodic(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): a tenth of the texts, by CRC-32 of the decimal id, repeats a stretch of its words to the end; others stay.

    Rows without id stay as they are; a null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = zlib.crc32(str(i).encode()) if i is not None else 1
                raw = text.as_py() or b""
                words = raw.split() if h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    raw = b" ".join(words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a])
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "text"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, text string").withColumnsRenamed({"id": id_col, "text": text_col})
