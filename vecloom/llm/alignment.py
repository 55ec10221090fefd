"""Alignment of two tokenizers over a corpus, scored by how often their ids are linked.

A text is a row of units, white space and the word after it, which neither tokenizer
crosses; each unit is encoded once a worker and remembered with its links. Links go
to stripes of B ids (id modulo the number of stripes). A stripe's counts are a
dense matrix of its B ids by all A ids, filled by np.add.at from pairs that tasks have
counted before; row maxima give each B id's best partner. Links are dealt to
the same stripes as those counts, and scored there by lookups in the matrix.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import _byte_letters

STRIPES = 128
_LINKS = 1 << 20  # links of a chunk of documents
_CHUNKS = 256  # chunks whose links in a stripe one task scores
_MOST = 400_000  # units that a worker remembers
_LONG = 64  # characters of a unit to remember
# Unicode's white space.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORD = re.compile(f"(\n?)( ?[{_LETTERS}]+)")  # its letters and the space before them are one pre-token
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_MARK = "\u2581"  # stands for a space in pieces

_CHUNK = "stripe int, chunk long, doc binary, a binary, b binary, n binary, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>"


class Aligner:
    """Both tokenizers and the units met so far; made once for a worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(path_a)
        self.one.encode_special_tokens = True
        self.two = SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.bytes_a = [b""] * self.one.get_vocab_size()
        for s, i in self.one.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes([letters[c] for c in s])
        pieces = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.two.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        # B's pieces cross none of these: a space after anything but spaces, white space that no piece holds, a sign after letters
        self.apart = not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces)
        white = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{_WHITE}]", c))
        glue = "".join(c for c in white if any(c in p for p in pieces))
        joined = {c for p in pieces if not _BYTE.fullmatch(p) for c in re.findall(f"(?<=[{_LETTERS}])[!-/:-@\\[-`{{-~]", p)}
        signs = "".join(re.escape(c) for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'" and c not in joined)
        word, more = f"[{_LETTERS}]+(?=[{signs}])" if signs else "(?!)", f"(?:[{glue}][{_WHITE}]*[^{_WHITE}]*)*" if glue else ""
        self.unit = re.compile(f"[{_WHITE}]*(?:{word}|[^{_WHITE}]+{more})|[{_WHITE}]+")
        self.space = self.two.piece_to_id(_MARK)
        self.letter = {b: c for c, b in letters.items()}
        self.line = self.one.encode("\n", add_special_tokens=False).ids
        self.len_a, self.len_b = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.bytes_a, self.bytes_b))
        numbers = [str(i) for i in range(max(self.sizes()))]
        self.comma, self.bar, self.semi = (np.array([x + c for x in numbers], dtype=object) for c in ",|;")
        self.units: dict[str, tuple | None] = {}
        self.merge = self.one.model.tokenize

    def forget(self) -> None:
        self.units.clear()

    def sizes(self) -> tuple[int, int]:
        return len(self.bytes_a), len(self.bytes_b)

    def _ids_a(self, units: list[str]) -> list[list[int]]:
        """A's ids of units: the letters of a word are merged by the library's model, other units are encoded by the library."""
        out, rest, letter, merge = [], [], self.letter, self.merge
        for k, u in enumerate(units):
            m = _WORD.fullmatch(u)
            if m:
                ids = [t.id for t in merge("".join([letter[x] for x in m[2].encode()]))]
                out.append(self.line + ids if m[1] else ids)
            else:
                rest.append(k)
                out.append([])
        for k, e in zip(rest, self.one.encode_batch_fast([units[k] for k in rest], add_special_tokens=False) if rest else ()):
            out[k] = e.ids
        return out

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        """B's ids of units. The library puts a space before what it gets, which is the unit's own; where it has none, a line feed keeps them apart and both go."""
        spaced = [u[0] == " " for u in units]
        found = self.two.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced)], num_threads=1)
        return [(ids or [self.space]) if s else ids[2:] for ids, s in zip(found, spaced)]

    def _learn(self, units: list[str]) -> list[tuple | None]:
        """(links, groups, n_a, n_b, n_groups) of each unit, None if a tokenizer doesn't keep its bytes."""
        if not units:
            return []
        ids_a, ids_b = self._ids_a(units), self._ids_b(units)
        raw = [u.encode() for u in units]
        flat_a, flat_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        n_a, n_b = list(map(len, ids_a)), list(map(len, ids_b))
        one, two = np.array(flat_a, dtype=np.int64), np.array(flat_b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.len_a[one]), np.cumsum(self.len_b[two])
        after_a, after_b, after = np.cumsum(n_a), np.cumsum(n_b), np.cumsum(list(map(len, raw)))
        whole, get_a, get_b = b"".join(raw), self.bytes_a.__getitem__, self.bytes_b.__getitem__
        kept = b"".join(map(get_a, flat_a)) == whole and b"".join(map(get_b, flat_b)) == whole and min(n_a) > 0 and min(n_b) > 0
        kept = kept and np.array_equal(ends_a[after_a - 1], after) and np.array_equal(ends_b[after_b - 1], after)
        if not kept:
            return [None] if len(units) == 1 else [x for u in units for x in self._learn([u])]
        at = np.searchsorted(ends_b, ends_a)
        i = np.flatnonzero(ends_b[at] == ends_a)  # no token is without bytes, so at most one of a side ends anywhere
        j = at[i]
        links = np.stack((one[i], two[j]), axis=1).astype("<u4").tobytes()
        # the tokens of each group in order, A's before B's, each with the sign that follows it
        ends = np.zeros(len(one), dtype=bool), np.zeros(len(two), dtype=bool)
        ends[0][i], ends[1][j] = True, True
        group = np.concatenate((2 * np.searchsorted(i, np.arange(len(one))), 2 * np.searchsorted(j, np.arange(len(two))) + 1))
        told = np.concatenate((np.where(ends[0], self.bar[one], self.comma[one]), np.where(ends[1], self.semi[two], self.comma[two])))
        told = told[np.argsort(group, kind="stable")].tolist()
        at_text, at_link = [0, *(after_a + after_b).tolist()], [0, *np.searchsorted(i, after_a).tolist()]
        texts = ["".join(told[x:y])[:-1] for x, y in zip(at_text, at_text[1:])]
        return [(links[8 * x : 8 * y], t, a, b, y - x) for x, y, t, a, b in zip(at_link, at_link[1:], texts, n_a, n_b)]

    def align(self, text: str) -> tuple[bytes, str, int, int, int] | None:
        """(links as pairs of 32-bit ids, groups, n_a, n_b, n_groups) of a text with a space before it; None if bytes differ."""
        units = self.unit.findall(" " + text) if self.apart else [" " + text]
        known = self.units
        new = [u for u in set(units) if u not in known]
        if new and len(known) + len(new) > _MOST:
            self.forget()
            new = list(set(units))
        known.update(zip(new, self._learn(new)))
        found = [known[u] for u in units]
        for u in new:
            if len(u) > _LONG:
                del known[u]
        if None in found:
            return None
        links, groups, n_a, n_b, n_groups = zip(*found)
        return b"".join(links), ";".join(groups), sum(n_a), sum(n_b), sum(n_groups)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _narrow(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<u4").astype(np.int64)


def chunks(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, hashed: bool = True) -> DataFrame:
    """Documents in chunks: a row with each chunk's documents (stripe -1), and one for each stripe that has links of it.

    Rows of stripes hold distinct (document's place in the chunk, a, b) with their number n, as 32-bit integers.
    groups are SHA-256, or with ``hashed=False`` the groups themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        held: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            counts = [len(x) // 8 for x in held]
            ab = np.frombuffer(b"".join(held), dtype="<u4").reshape(-1, 2).astype(np.uint64)
            doc = np.repeat(np.arange(len(docs), dtype=np.uint64), counts)
            # one number in the order of (stripe, document, b, a), where each part has the bits that it needs
            wide_a, wide_b, wide_d = (int(x).bit_length() for x in (pair.sizes()[0], pair.sizes()[1] // stripes + 1, len(docs)))
            s, row = ab[:, 1] % np.uint64(stripes), ab[:, 1] // np.uint64(stripes)
            key = ((s << np.uint64(wide_d) | doc) << np.uint64(wide_b) | row) << np.uint64(wide_a) | ab[:, 0]
            key, n = np.unique(key, return_counts=True)
            take = lambda x, bits: x & np.uint64((1 << bits) - 1)
            a, row = take(key, wide_a), take(key >> np.uint64(wide_a), wide_b)
            doc = take(key >> np.uint64(wide_a + wide_b), wide_d)
            s = (key >> np.uint64(wide_a + wide_b + wide_d)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, dtype=np.int64)
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(s)]))
            b = row * np.uint64(stripes) + s.astype(np.uint64)
            m = len(cuts)
            cols = [list(c) for c in zip(*docs)]
            out = [pa.array([*s[starts].tolist(), -1], pa.int32()), pa.array([number] * (m + 1), pa.int64())]
            out += [pa.array([*(_narrow(x[i:j]) for i, j in cuts), None], pa.binary()) for x in (doc, a, b, n)]
            out += [pa.array([None] * m + [c], pa.list_(k)) for c, k in zip(cols, (*[pa.int64()] * 5, pa.string()))]
            return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _CHUNK.split(", ")])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = pair.align(text) if text else None
                links, groups, n_a, n_b, n_groups = found or (b"", "", 0, 0, 0)
                groups = hashlib.sha256(groups.encode()).hexdigest() if hashed and found else groups
                docs.append((i, n_a, n_b, n_groups, len(links) // 8, groups))
                held.append(links)
                size += len(links) // 8
                if size >= _LINKS or len(docs) >= 1 << 16:
                    yield packed()
                    docs, held, size, number = [], [], 0, number + 1
        if docs:
            yield packed()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _CHUNK)


def pair_counts(links: DataFrame, n_a: int, n_b: int, stripes: int = STRIPES) -> DataFrame:
    """(stripe, a, b, n, best): packed arrays of each stripe's distinct pairs, their counts and whether a count is its B id's highest.

    Tasks count the pairs of their own links first, so that a frequent pair is sent once a task; the task of
    a stripe holds a matrix of its B ids by all A ids.
    """
    rows = n_b // stripes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            out = []
            for s, parts in held.items():
                key = np.concatenate([p for p, _ in parts])
                key, at = np.unique(key, return_inverse=True)
                n = np.zeros(len(key), dtype=np.int64)
                np.add.at(n, at, np.concatenate([n for _, n in parts]))
                out.append((s, key.astype("<i8").tobytes(), n.astype("<i8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["stripe", "key", "n"])

        for batch in batches:
            for s, a, b, n in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                held.setdefault(s, []).append((_wide(b.as_py()) // stripes * n_a + _wide(a.as_py()), _wide(n.as_py())))
                size += len(held[s][-1][0])
            if size > 1 << 22:
                yield counted()
                held, size = {}, 0
        if held:
            yield counted()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe = None, None

        def told() -> pa.RecordBatch:
            top = block.reshape(rows, n_a).max(axis=1)
            at = np.flatnonzero(block)
            n = block[at]
            best = (n == top[at // n_a]).astype(np.uint8)
            cols = [pa.array([stripe], pa.int32()), *(pa.array([x], pa.binary()) for x in (_narrow(at % n_a), _narrow(at // n_a * stripes + stripe), n.astype("<i8").tobytes(), best.tobytes()))]
            return pa.RecordBatch.from_arrays(cols, names=["stripe", "a", "b", "n", "best"])

        for batch in batches:
            for s, key, n in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                if s != stripe:
                    if block is not None:
                        yield told()
                    block, stripe = np.zeros(rows * n_a, dtype=np.int64), s
                np.add.at(block, np.frombuffer(key.as_py(), dtype="<i8"), np.frombuffer(n.as_py(), dtype="<i8"))
        if block is not None:
            yield told()

    counted = links.select("stripe", "a", "b", "n").mapInArrow(count, "stripe int, key binary, n binary")
    dealt = counted.repartitionById(stripes, "stripe").sortWithinPartitions("stripe")
    return dealt.mapInArrow(add, "stripe int, a binary, b binary, n binary, best binary")


def scored(links: DataFrame, counts: DataFrame, n_a: int, n_b: int, n_chunks: int, stripes: int = STRIPES) -> DataFrame:
    """(chunk, doc, n_best, count_sum): packed scores of the documents of a chunk in one stripe.

    Links are dealt with their stripe's counts; of many chunks a stripe's links are dealt to several tasks, each with the counts.
    A task holds two matrices of one stripe and passes the links through.
    """
    rows, salts = n_b // stripes + 1, max(1, math.ceil(n_chunks / _CHUNKS))
    salt = F.pmod(F.xxhash64("chunk", F.lit(23)), F.lit(salts)).cast("int")
    left = links.select((F.col("stripe") * salts + salt).alias("part"), "stripe", "chunk", "doc", "a", "b", "n", F.lit(None).cast("binary").alias("best"))
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    right = counts.withColumn("s", each).select((F.col("stripe") * salts + F.col("s")).cast("int").alias("part"), "stripe", F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("doc"), "a", "b", "n", "best")
    dealt = left.unionByName(right).repartitionById(stripes * salts, "part").sortWithinPartitions("part", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, best = None, None, None
        for batch in batches:
            out = []
            for p, s, chunk, doc, a, b, n, flags in zip(*(batch.column(k).to_pylist() for k in range(3)), *batch.columns[3:]):
                if p != part:
                    part, block, best = p, np.zeros(rows * n_a, dtype=np.int64), np.zeros(rows * n_a, dtype=bool)
                at = _wide(b.as_py()) // stripes * n_a + _wide(a.as_py())
                if chunk < 0:
                    np.add.at(block, at, np.frombuffer(n.as_py(), dtype="<i8"))
                    best[at] = np.frombuffer(flags.as_py(), dtype=np.uint8) > 0
                    continue
                docs, n = np.frombuffer(doc.as_py(), dtype="<u4"), _wide(n.as_py())
                starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
                out.append((chunk, docs[starts].tobytes(), _narrow(np.add.reduceat(n * best[at], starts)), np.add.reduceat(n * block[at], starts).astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), *[pa.binary()] * 3))], names=["chunk", "doc", "n_best", "count_sum"])

    return dealt.mapInArrow(run, "chunk long, doc binary, n_best binary, count_sum binary")


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, hashed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents' alignment and the corpus's pairs: ((id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), (a, b, n, best)).

    A encodes a space and the text, B the text (it adds the space); tokens' bytes are cut to
    groups where both end, and the tokens that end there are linked. n_best are the links whose
    pair is linked most often, over all documents, of the pairs of its B id, ties included. Texts that are null or empty, and those
    whose bytes a tokenizer doesn't keep, have no tokens: zeros and ''. Texts of any length
    are encoded whole. Repeated rows count as often as they are there; null and repeated ids give a
    row each; other columns aren't read, whatever their names. An empty table gives no rows.
    Scores of a chunk of documents (about 2**20 links) are added up in one task. With
    ``hashed=False`` the first table has the groups themselves, as column groups.
    """
    pair = aligner(path_a, path_b)
    n_a, n_b = pair.sizes()
    made = materialize(chunks(df, path_a, path_b, id_col, text_col, stripes, hashed), "links")
    links, docs = made.where("stripe >= 0"), made.where("stripe < 0")
    n_chunks = docs.count()
    counts = materialize(pair_counts(links, n_a, n_b, stripes), "counts")
    scores = scored(links, counts, n_a, n_b, n_chunks, stripes)
    lists = ["ids", "n_a", "n_b", "n_groups", "n_links", "groups"]
    told = docs.select("chunk", *lists, *[F.lit(None).cast("binary").alias(c) for c in ("doc", "n_best", "count_sum")])
    both = told.unionByName(scores.select("chunk", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in lists], "doc", "n_best", "count_sum"))

    def add(table: pa.Table) -> pa.Table:
        own = table.column("ids").is_valid().to_pylist().index(True)
        cols = [table.column(c)[own].values for c in lists]
        n_best, count_sum = (np.zeros(len(cols[0]), dtype=np.int64) for _ in range(2))
        for doc, n, total in zip(table.column("doc"), table.column("n_best"), table.column("count_sum")):
            if doc.is_valid:
                at = np.frombuffer(doc.as_py(), dtype="<u4")
                n_best[at] += np.frombuffer(n.as_py(), dtype="<u4")
                count_sum[at] += np.frombuffer(total.as_py(), dtype="<i8")
        return pa.table([*cols[:5], pa.array(n_best), pa.array(count_sum), cols[5]], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last])

    last = "groups_sha256" if hashed else "groups"
    out = both.groupBy("chunk").applyInArrow(add, f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {last} string")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n, best in zip(*batch.columns):
                flags = np.frombuffer(best.as_py(), dtype=np.uint8) > 0
                yield pa.RecordBatch.from_arrays([pa.array(_wide(a.as_py())), pa.array(_wide(b.as_py())), pa.array(np.frombuffer(n.as_py(), dtype="<i8")), pa.array(flags)], names=["a", "b", "n", "best"])

    return out, counts.select("a", "b", "n", "best").mapInArrow(unpack, "a long, b long, n long, best boolean")
