"""Exact byte-pair encoding with a public vocabulary, by backtracking.

A text is cut by the vocabulary's pattern into pieces. A piece is encoded from
left to right: an Aho-Corasick automaton gives the longest token at a position,
and the token is taken if it is compatible with the token before it, that is if
byte-pair merging, run on the two together, would leave just these two. If not,
the next shorter token is tried; if none fits, the token before is given up and
the position marked as a dead end, so that no position is tried twice: the time
is linear in the piece. Two tokens that are compatible pair by pair make the
whole encoding exact. Pieces seen before come from a bounded cache. Decoding
reads each token's bytes from one blob through an offset table.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.session import shipped

#: Where the vocabulary lies unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts into pieces, as published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern where only ASCII occurs; the standard library runs it faster. Its \s has
# four control characters that are no white space here, so white space is written out.
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
# A line with the white space before it, without that after it: no piece reaches over its ends.
_SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LINE = rf"[{_SPACE}]*[^{_SPACE}](?:[^\n]*[^{_SPACE}])?|[{_SPACE}]+"
#: Pieces that a worker remembers; beyond, it starts over.
CACHE = 200_000
#: Longest piece, in bytes, that is remembered.
CACHED_BYTES = 64
#: Tokens in one Arrow batch of the result, about.
BATCH_TOKENS = 1_000_000


class Tables:
    """What an encoder needs: the tokens, and how merging builds each from two others.

    Made once on the driver and broadcast; its size is that of the vocabulary.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens)}
        self.halves: list[tuple[int, int]] = []
        self.merges: dict[tuple[int, int], int] = {}
        self.shorter: list[int] = []
        self.reachable: list[bool] = []
        for i, t in enumerate(tokens):
            self.shorter.append(next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1))
            found = len(t) == 1
            self.halves.append((i, i))
            for k in range(1, len(t)):
                left, right = ids.get(t[:k], i), ids.get(t[k:], i)
                if left < i and right < i and self.reachable[left] and self.reachable[right] and self.compatible(left, right):
                    self.halves[i], self.merges[left, right], found = (left, right), i, True
                    break
            self.reachable.append(found)

    def compatible(self, left: int, right: int) -> bool:
        """Would merging leave the two tokens as they are, side by side?

        The pair check of backtracking byte pair encoding, as published for linear-time encoders.

        Undoes merges at the seam from the latest to the earliest. A merge across
        the seam counts only if it would have come before those undone so far.
        """
        limit = len(self.tokens)
        merges, halves = self.merges, self.halves
        while True:
            across = merges.get((left, right))
            if across is not None and across < limit:
                return False
            inner_left, inner_right = halves[left][1], halves[right][0]
            if left > right or inner_right == right:
                if inner_left == left:
                    if inner_right == right:
                        return True
                    limit, right = right + 1, inner_right
                else:
                    limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right
            # a merge of the same rank on the left goes first, one on the right after


def load(path: str = VOCABULARY) -> Tables:
    """Tables of a vocabulary of ranks: a line has a token in base64 and its id, ids are 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    return Tables([ranks[i] for i in range(len(ranks))])


class Encoder:
    """Encodes and decodes texts; holds the automaton and the caches of one worker."""

    def __init__(self, tables: Tables):
        import re

        import ahocorasick
        import regex

        self.tables, self.length = tables, [len(t) for t in tables.tokens]
        self.automaton = ahocorasick.Automaton()
        self.known: dict[str, bytes] = {}
        for i, t in enumerate(tables.tokens):
            if tables.reachable[i]:
                self.automaton.add_word(t.decode("latin-1"), i)
                try:
                    self.known[t.decode()] = array("i", (i,)).tobytes()
                except UnicodeDecodeError:
                    pass
        self.automaton.make_automaton()
        self.reach = max(self.length)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        self.cut_any, self.cut_ascii, self.lines = regex.compile(PATTERN).findall, re.compile(_ASCII).findall, re.compile(_LINE).findall
        self.blob = b"".join(tables.tokens)
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).tolist()

    def cut(self, text: str) -> list[str]:
        """The pieces of a text."""
        if text.isascii():
            return self.cut_ascii(text)
        out: list[str] = []
        for line in self.lines(text):
            out += self.cut_ascii(line) if line.isascii() else self.cut_any(line)
        return out

    def encode(self, text: str | None) -> Iterator[int]:
        """The ids of a text; none for a null or empty one."""
        return iter(array("i", self.packed(text)))

    def packed(self, text: str | None) -> bytes:
        """The ids as four bytes each, joined from those of the pieces."""
        if not text:
            return b""
        if len(self.pieces) > CACHE:
            self.pieces = _Pieces(self)
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def decode(self, ids: list[int]) -> str:
        offsets, blob = self.offsets, self.blob
        return b"".join([blob[offsets[i] : offsets[i + 1]] for i in ids]).decode(errors="replace")

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece, by backtracking over longest matches."""
        s = piece.encode().decode("latin-1")
        longest, length, shorter, pairs, reach = self.automaton.iter_long, self.length, self.tables.shorter, self.pairs, self.reach
        dead = bytearray(len(s) + 1)
        out: list[int] = []
        at, end_of = 0, len(s)
        # a search costs time for the text it is handed, so it gets no more than the longest token
        token = next(longest(s[:reach]))[1]
        while True:
            end = at + length[token]
            fits = not dead[end]
            if fits and out:
                pair = (out[-1], token)
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > 4 * CACHE:
                        pairs.clear()
                    fits = pairs[pair] = self.tables.compatible(*pair)
            if fits:
                out.append(token)
                if end == end_of:
                    return tuple(out)
                at = end
                token = next(longest(s[at : at + reach]))[1]
                continue
            token_before = token
            token = shorter[token_before]
            while token >= 0 and not self.tables.reachable[token]:
                token = shorter[token]
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= length[token]


class _Pieces(dict):
    """Remembers the packed ids of pieces; starts from those that are tokens."""

    def __init__(self, encoder: Encoder):
        super().__init__(encoder.known)
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encoder.piece(piece)).tobytes()
        if len(piece) <= CACHED_BYTES:
            self[piece] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(name: str, tables) -> Encoder:
    """This worker's encoder; ``tables`` is a broadcast variable."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(tables.value)
    return _ENCODERS[name]


_BROADCASTS: dict[tuple[str, str], object] = {}


def _broadcast(df: DataFrame, path: str):
    shipped(df.sparkSession)
    sc = df.sparkSession.sparkContext
    key = (sc.applicationId, path)
    if key not in _BROADCASTS:
        _BROADCASTS[key] = sc.broadcast(load(path))
    return _BROADCASTS[key]


def _encoded(df: DataFrame, id_columns: list[str], text: str, path: str, counts: bool) -> DataFrame:
    tables = _broadcast(df, path)
    picked = df.select(*id_columns, F.col(text).cast("string").alias("_text"))
    schema = picked.drop("_text").withColumn("n_tokens" if counts else "ids", F.lit(0).cast("long") if counts else F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, tables)
        for batch in batches:
            texts = batch.column(len(id_columns))
            if counts:
                sizes = pa.array([len(encoder.packed(t.as_py())) // 4 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_columns)], sizes], names=[*id_columns, "n_tokens"])
                continue
            start, ends, packed = 0, [0], []
            for k in range(len(texts)):
                packed.append(encoder.packed(texts[k].as_py()))
                ends.append(ends[-1] + len(packed[-1]) // 4)
                if ends[-1] > BATCH_TOKENS or k + 1 == len(texts):
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype="int32")))
                    keys = [batch.column(c).slice(start, k + 1 - start) for c in range(len(id_columns))]
                    yield pa.RecordBatch.from_arrays([*keys, ids], names=[*id_columns, "ids"])
                    start, ends, packed = k + 1, [0], []

    return picked.mapInArrow(run, schema)


def token_ids(df: DataFrame, id_columns: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """``id_columns`` and ids (array of int) of every row, without special tokens.

    Null and empty texts have the empty list. Strings of special tokens in a
    text are ordinary text. Rows are neither dropped nor merged, repeated ones
    included; nothing is shuffled; a text of any length is encoded whole.
    """
    return _encoded(df, id_columns, text, path, counts=False)


def token_counts(df: DataFrame, id_columns: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """``id_columns`` and n_tokens of every row; 0 for null and empty texts."""
    return _encoded(df, id_columns, text, path, counts=True)


def decoded(df: DataFrame, id_columns: list[str], ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``id_columns`` and the text of each list of ids; a null list gives an empty text."""
    tables = _broadcast(df, path)
    picked = df.select(*id_columns, F.col(ids).alias("_ids"))
    schema = picked.drop("_ids").withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, tables)
        for batch in batches:
            texts = [encoder.decode(x.as_py() or []) for x in batch.column(len(id_columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_columns)], pa.array(texts, pa.string())], names=[*id_columns, "text"])

    return picked.mapInArrow(run, schema)
