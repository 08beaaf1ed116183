"""Byte-pair encoding by backtracking, and decoding by an offset table.

The encoder finds all vocabulary tokens in a piece of text with one Aho-Corasick
pass, takes the longest one at each place, and accepts a token after another only
if the merge rules would leave a border between the two. If no token fits, it goes
back by one token and tries a shorter one; places known to lead nowhere are not
tried again, so the work is linear in the length of the piece. The result is the
sequence that applying the merges in order gives.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import ByteMemo, Memo, as_bytes, rows_of

#: The published pre-tokenisation of byte-level vocabularies (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_LIMIT = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBPE:
    """Encoder and decoder of one byte-level vocabulary file. Ids must follow the order of the merges."""

    def __init__(self, path: str, memo: int = 150_000, memo_bytes: int = 40 << 20):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = token
            self.left[token], self.right[token] = vocab[a], vocab[b]
        texts = {i: bytes(map(letters.__getitem__, t)) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.of_bytes = {text: i for i, text in texts.items()}
        self.finder = ahocorasick.Automaton()
        for i, text in texts.items():
            self.finder.add_word(text.decode("latin-1"), (i, len(text)))
        self.finder.make_automaton()
        self.shorter = {i: self._longest_prefix(text) for i, text in texts.items()}
        self.size = {i: len(text) for i, text in texts.items()}
        all_texts = texts | {i: t.encode() for t, i in self.special.items()}
        width = max(all_texts) + 1
        lengths = np.array([len(all_texts.get(i, b"")) for i in range(width)], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.pool = np.frombuffer(b"".join(all_texts.get(i, b"") for i in range(width)), np.uint8)
        self.lengths = lengths
        self.splitter = regex.compile(PIECES)
        self.single_space = regex.compile(r"(?<=\S) (?=\S)")
        self.crowded = regex.compile(r" \s|\s ")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fits = Memo(lambda pair: self.joins(*pair), memo)
        self.packed = ByteMemo(self._pack_piece, memo_bytes)
        self.spaced = ByteMemo(lambda unit: self._unit(" " + unit), memo_bytes)

    def joins(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens ``a`` and ``b`` side by side.

        Undoing the later of the two merges again and again shows every pair that
        stood at the border; one that would have merged before that moment rules
        the border out.
        """
        limit = NO_LIMIT
        merged, left, right = self.merged, self.left, self.right
        while True:
            if merged.get((a, b), NO_LIMIT) < limit:
                return False
            inner_a, inner_b = right.get(a), left.get(b)
            if inner_a is None and inner_b is None:
                return True
            if inner_b is None or (inner_a is not None and a > b):
                limit, a = a, inner_a
            else:
                limit, b = b + 1, inner_b

    def _longest_prefix(self, text: bytes) -> int:
        """The longest token that is a shorter beginning of ``text``, or -1."""
        return next((self.of_bytes[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.of_bytes), -1)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-tokenised piece."""
        whole = self.of_bytes.get(piece)
        if whole is not None and self._is_stable(whole):
            return [whole]
        end = len(piece)
        longest = [-1] * (end + 1)
        for last, (token, size) in self.finder.iter(piece.decode("latin-1")):
            longest[last + 1 - size] = token  # the longest comes last
        size_of, shorter, fits = self.size, self.shorter, self.fits
        dead = bytearray(end + 1)
        ids: list[int] = []
        place, token = 0, longest[0]
        while place < end:
            while token >= 0:
                after = place + size_of[token]
                if not dead[after] and (not ids or fits[ids[-1], token]):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                place, token = after, longest[after]
            elif ids:
                dead[place] = 1
                token = ids.pop()
                place -= size_of[token]
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte")
        return ids

    @functools.cache
    def _is_stable(self, token: int) -> bool:
        """A token that its own two halves lead to."""
        return token not in self.left or (
            self._is_stable(self.left[token])
            and self._is_stable(self.right[token])
            and self._halves_meet(token)
        )

    def _halves_meet(self, token: int) -> bool:
        a, b = self.left[token], self.right[token]
        del self.merged[a, b]
        try:
            return self.joins(a, b)
        finally:
            self.merged[a, b] = token

    def _pack_piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def _unit(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.splitter.findall(text)))

    def _plain(self, text: str) -> bytes:
        """A border is sure at a lone space between two other characters: pieces never cross it."""
        if not text:
            return b""
        units = self.single_space.split(text) if self.crowded.search(text) else text.split(" ")
        return self._unit(units[0]) + b"".join(map(self.spaced.__getitem__, units[1:]))

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for hit in self.specials.finditer(text):
            out += [self._plain(text[at : hit.start()]), self.special[hit[0]].to_bytes(4, "little")]
            at = hit.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        """UTF-8 of the text of packed ids: every id is a slice of one pool of bytes."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        data = self.pool[shift + np.arange(total)].tobytes()
        return data.decode("utf-8", "replace").encode()


@functools.cache
def load_bpe(path: str) -> BacktrackingBPE:
    """One encoder per worker process and file."""
    return BacktrackingBPE(path)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    return (x.decode("utf-8", "replace") for x in batch.column(column).to_pylist())


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids of the whole text as packed little-endian unsigned 32-bit integers.

    One narrow pass, no shuffle; rows keep their number and repeated rows stay. A
    null or empty text has no ids; other columns are not looked at. ``path`` must
    be readable where the tasks run.
    """

    def run(batches):
        bpe = load_bpe(path)
        for batch in rows_of(batches):
            ids = [bpe.encode_packed(t) for t in _texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    source = docs.select(docs[f"`{key}`"].alias("key"), as_bytes(text).alias("text"))
    kind = source.schema["key"].dataType
    out = source.mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("ids", T.BinaryType())]))
    return out.withColumnRenamed("key", key)


def bpe_round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, text): ids of the whole text, packed, and the text that they decode to.

    The same as ``bpe_encode`` and ``bpe_decode`` in one narrow pass, so that ids travel once.
    """

    def run(batches):
        bpe = load_bpe(path)
        for batch in rows_of(batches):
            ids = [bpe.encode_packed(t) for t in _texts(batch, "text")]
            texts = [bpe.decode_packed(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], ["key", "ids", "text"])

    source = docs.select(docs[f"`{key}`"].alias("key"), as_bytes(text).alias("text"))
    kind = source.schema["key"].dataType
    fields = [T.StructField("key", kind), T.StructField("ids", T.BinaryType()), T.StructField("text", T.BinaryType())]
    out = source.mapInArrow(run, T.StructType(fields))
    return out.select(F.col("key").alias(key), "ids", F.col("text").cast("string").alias("text"))


def bpe_decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the text of packed ids; null ids give the empty text, bytes that are no UTF-8 give U+FFFD."""

    def run(batches):
        bpe = load_bpe(path)
        for batch in rows_of(batches):
            texts = [bpe.decode_packed(x).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("ids"), pa.array(texts, pa.string())], ["key", "ids", "text"]
            )

    source = encoded.select(encoded[f"`{key}`"].alias("key"), as_bytes(ids).alias("ids"))
    kind = source.schema["key"].dataType
    fields = [T.StructField("key", kind), T.StructField("ids", T.BinaryType()), T.StructField("text", T.StringType())]
    return source.mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key).withColumnRenamed("ids", ids)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
