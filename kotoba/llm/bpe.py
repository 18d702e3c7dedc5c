"""Operator 1: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that one Aho-Corasick automaton over the vocabulary (pyahocorasick) finds the longest
token at a position. A piece of text is encoded by taking longest matches and stepping back to shorter ones whenever
two neighbours couldn't stand side by side in what the merges produce; that compatibility depends on the two tokens
alone and is memoised. Positions found to be dead ends are marked, so each is left at most once and the time is
linear in the length of the piece, while the result is exactly that of the merges in order of rank.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows give repeated results; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bounded_batches, per_slice, table, text_or_empty

#: Entries of each half of a memo.
MEMO = 250_000
#: Texts longer than this many characters are not memoised.
MEMO_CHARS = 40
#: Stands for the token before the first.
NONE = (1 << 30) - 1
SPACES = re.compile(r"\s(?= )").search
ENCODED = "doc_id long, ids array<int>, decoded binary"


class Memo(dict):
    """Remembers a function's results, at most two halves of MEMO entries: when the young half is full it becomes the
    old one, and what is asked for again moves back."""

    def __init__(self, fn: Callable):
        super().__init__()
        self.fn, self.old = fn, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
            if isinstance(key, str) and len(key) > MEMO_CHARS:
                return value
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encodes and decodes by a table of ranks (bytes to id), as merges in order of rank do."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s is Unicode's White_Space, as in the library whose results these must be.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.bytes = {i: token for token, i in ranks.items()}
        self.token = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.length = {i: len(token) for token, i in ranks.items()}
        self.longest = ahocorasick.Automaton()
        for token, i in self.token.items():
            self.longest.add_word(token, i)
        self.longest.make_automaton()
        self.shorter: dict[int, int] = {}
        for token, i in self.token.items():
            self.shorter[i] = next((self.token[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.token), -1)
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._learn_merges()
        self.fits = Memo(self._fitting)
        self.pieces = Memo(lambda piece: tuple(self.encode_piece(piece)))
        self.words = Memo(lambda word: tuple(self.chunk(" " + word)))

    def _learn_merges(self) -> None:
        """For each token, in order of rank, the two tokens whose merge makes it."""
        text = {i: token for token, i in self.token.items()}
        for i in sorted(text):
            left = self.shorter[i]
            while left >= 0:
                right = self.token.get(text[i][self.length[left]:])
                if right is not None and left < i and right < i and self._stand(left, right):
                    self.merged[left, right] = i
                    break
                left = self.shorter[left]
            self.halves[i] = (left, right) if left >= 0 else (i, i)

    def _stand(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those that make left and right."""
        limit = 1 << 62
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left != limit:
                    continue
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, self.halves[left][1]
                if left == limit:
                    return True

    def _fitting(self, pair: int) -> int:
        """The longest beginning of a token (itself included) that may follow another; -1 if there is none."""
        last, token = pair >> 32, pair & 0xFFFFFFFF
        while last != NONE and token >= 0 and not self._stand(last, token):
            token = self.shorter[token]
        return token

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern."""
        text = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        if (whole := self.token.get(text)) is not None:
            return [whole]
        length, shorter, fits, matches = self.length, self.shorter, self.fits, self.longest.iter_long
        ids: list[int] = []
        dead: set[int] = set()
        at, end, last = 0, len(text), NONE
        run = matches(text)
        while True:
            longest = next(run)[1]
            token = fits[last << 32 | longest]
            while token >= 0 and dead and at + length[token] in dead:
                token = shorter[token]
                token = token if token < 0 else fits[last << 32 | token]
            while token < 0:  # no token fits here: step back, and never come here again
                dead.add(at)
                longest = last
                at -= length[ids.pop()]
                token = shorter[last]
                last = ids[-1] if ids else NONE
                while token >= 0 and ((token := fits[last << 32 | token]) >= 0) and at + length[token] in dead:
                    token = shorter[token]
            ids.append(token)
            at += length[token]
            if at == end:
                return ids
            last = token
            if token != longest:
                run = matches(text, at)

    def encode(self, text: str) -> list[int]:
        """Ids of a text. White space after anything else always begins a new piece, so where single spaces are the
        rule the words between them are looked up whole."""
        if SPACES(text):
            words = map(self.pieces.__getitem__, self.split(text))
        else:
            first, *rest = text.split(" ")
            words = chain((self.chunk(first),), map(self.words.__getitem__, rest))
        return list(chain.from_iterable(words))

    def chunk(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str) -> Codec:
    """The codec of a rank file (a token in base64 and its rank on each line); one for each Python worker."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return Codec(ranks, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and the bytes that the ids decode to, for each row of docs. vocabulary is a file that every worker has."""
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = codec(vocabulary, pattern)
        gc.disable()  # nothing here is cyclic, and the memos are long to look through
        try:
            ids = [of.encode(x) for x in batch.column("text").to_pylist()]
        finally:
            gc.enable()
        ends = np.cumsum([0, *map(len, ids)])
        flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, ends[-1]))
        decoded = pa.array([of.decode(x) for x in ids], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), decoded], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(per_slice(run), ENCODED)


def tokenizer() -> tuple[str, str]:
    """The rank file and the pattern of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: counts and digests."""
    return digests(encode_documents(table(spark, sf_dir, "documents"), *tokenizer()))
