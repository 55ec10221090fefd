"""Token counts and ids of whole texts, with a whole-token shortcut.

The tokenizer drops white space and its pre-tokens never cross it, so a text's
ids are those of its pre-tokens, one after another. Where a text (or else a chunk
of it between spaces and line feeds) has only ASCII characters and precomposed
Latin letters, the pre-tokens are read off by the tokenizer's own pattern; those
proven to be one token alone are taken directly, and the library merges only the
rest. It encodes other chunks whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tokenizers import Tokenizer

# Letters that composition leaves alone and whose lower case is one letter: U+00C0 to U+017E less signs and U+0130.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_PLAIN = re.compile(rf"[\x20-\x7e\t\n\r{_LATIN}]*")
# The vocabulary file's pre-token pattern, for the characters of _PLAIN, and its mark of a word's end.
_PRE_TOKEN = re.compile(rf"[a-z{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9{_LATIN}]+")
_WORD_END = "</w>"
_MOST = 400_000  # words that a worker remembers; beyond it starts anew, with equal results
_LONG = 100  # characters of a word to remember


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def whole_tokens(path: str, tok: Tokenizer | None = None) -> dict[str, int]:
    """Vocabulary strings proven to encode alone as their one token: {string: id}.

    Each string that can be a pre-token is encoded by the library itself.
    """
    from tokenizers import Tokenizer

    tok = tok or Tokenizer.from_file(path)
    letters, able = _byte_letters(), []
    for s, i in tok.get_vocab(with_added_tokens=False).items():
        if s.endswith(_WORD_END):
            text = bytes(letters[c] for c in s[: -len(_WORD_END)]).decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and _PRE_TOKEN.fullmatch(text):
                able.append((text, i))
    encoded = tok.encode_batch_fast([s for s, _ in able], add_special_tokens=False)
    return {s: i for (s, i), e in zip(able, encoded) if e.ids == [i]}


class _Known(dict):
    """Ids of plain texts' words (runs without white space).

    Pre-tokens are whole tokens, or merged by the library's model and learnt when first
    met; a word of several is put together from them.
    """

    def __init__(self, whole: dict[str, bytes], merge: Callable[[str], list], most: int = _MOST) -> None:
        super().__init__(whole)
        self.whole, self.merge, self.most = whole, merge, most
        self.letter = {b: c for c, b in _byte_letters().items()}

    def __missing__(self, word: str) -> bytes:
        parts = _PRE_TOKEN.findall(word)
        if len(parts) > 1:
            ids = b"".join([self[p] for p in parts])
        else:
            spelt = word if word.isascii() else "".join([self.letter[b] for b in word.encode()])
            ids = array("I", [t.id for t in self.merge(spelt)]).tobytes()
        if len(self) >= self.most:
            self.forget()
        if len(word) <= _LONG:
            self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.update(self.whole)


class Counter:
    """Ids of texts as little-endian 32-bit bytes, with up to ``most`` words remembered; made once for a worker."""

    def __init__(self, path: str, most: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = tuple(x.content for x in self.tok.get_added_tokens_decoder().values())
        whole = {s: array("I", [i]).tobytes() for s, i in whole_tokens(path, self.tok).items()}
        self.known = _Known(whole, self.tok.model.tokenize, _MOST if most is None else most)
        self.chunks: dict[str, bytes] = {}  # other texts' chunks, encoded whole

    def forget(self) -> None:
        """Lets go of what this task has learnt; the worker may wait long for its next one."""
        self.known.forget()
        self.chunks = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of a text of plain characters."""
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def _chunk(self, chunk: str) -> bytes:
        if self._is_plain(chunk):
            return self._plain(chunk)
        if chunk not in self.chunks:
            if len(self.chunks) >= self.known.most // 10:
                self.chunks.clear()
            self.chunks[chunk] = self._encode(chunk)
        return self.chunks[chunk]

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not ("<|" in text and any(s in text for s in self.special))

    def ids(self, text: str) -> bytes:
        """The text's ids, without added ones; special strings in it are their tokens, as by the library's default."""
        if self._is_plain(text):
            return self._plain(text)
        return b"".join([self._chunk(c) for c in text.replace("\n", " ").split(" ")])

    def ids_of(self, texts: pa.Array) -> Iterator[bytes]:
        """ids() of each text of an Arrow array, null as empty."""
        return (self.ids(x.as_py() or "") for x in texts)


@lru_cache(maxsize=4)
def counter(path: str, most: int | None = None) -> Counter:
    return Counter(path, most)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, without a shuffle; a null text is empty (0 tokens).

    Repeated rows, null and repeated ids give a row each. Other columns aren't read,
    whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = [len(ids) // 4 for ids in c.ids_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])
        c.forget()

    slim = df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
