"""Encoding of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie unless a path is given.
TOKENIZERS = os.environ.get("GRIDLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published pattern that splits a text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most pieces that a worker remembers, and the longest that it does, in characters.
REMEMBERED, LONGEST = 250_000, 48


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary with one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file."""
    with open(path, "rb") as f:
        return read_ranks(f.read())


class RankQueue:
    """Positions in buckets, one a merge rank; three levels of 64-bit words tell the lowest rank whose bucket holds any."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        w = rank >> 6
        self.low[w] |= 1 << (rank & 63)
        self.mid[w >> 6] |= 1 << (w & 63)
        self.top |= 1 << (w >> 6)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and all positions in its bucket; rank -1 if there is none."""
        top = self.top
        if not top:
            return -1, []
        a = (top & -top).bit_length() - 1
        x = self.mid[a]
        w = a << 6 | (x & -x).bit_length() - 1
        x = self.low[w]
        rank = w << 6 | (x & -x).bit_length() - 1
        self.low[w] = x = x & (x - 1)
        if not x:
            self.mid[a] &= ~(1 << (w & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return rank, self.buckets.pop(rank)


class Encoder:
    """Token ids of texts under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.names = {i: b for b, i in ranks.items()}
        self.pairs: dict[int, int] = {}
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def _pair(self, a: int, b: int) -> int:
        """The id that two neighbouring tokens merge to, -1 if none."""
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.ranks.get(self.names[a] + self.names[b], -1)
            if len(self.pairs) < 1_000_000:
                self.pairs[key] = rank
        return rank

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair merges first, the leftmost of equals.

        Tokens form a linked list over byte positions; each neighbouring pair waits in the bucket of its rank. An entry whose pair
        has changed since is skipped when it comes up. A pre-token of n bytes takes O(n) pushes and pops, whatever its length.
        """
        n = len(data)
        token = [self.single[c] for c in data]
        if n < 2:
            return token
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair, push, pop = self._pair, self.queue.push, self.queue.pop
        for i in range(n - 1):
            r = pair(token[i], token[i + 1])
            if r >= 0:
                push(r, i)
        rank, places = pop()
        while rank >= 0:
            if len(places) > 1:
                places.sort()
            for i in places:
                j = after[i]
                if token[i] < 0 or j >= n or pair(token[i], token[j]) != rank:
                    continue
                token[i], token[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = pair(rank, token[k])
                    if r >= 0:
                        push(r, i)
                h = before[i]
                if h >= 0:
                    r = pair(token[h], rank)
                    if r >= 0:
                        push(r, h)
            rank, places = pop()
        return [t for t in token if t >= 0]

    def _piece(self, s: str) -> list[int]:
        ids = self.pieces.get(s)
        if ids is None:
            ids = self.merge(s.encode("utf-8", "surrogatepass"))
            if len(s) <= LONGEST:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[s] = ids
        return ids

    def _word(self, s: str) -> list[int]:
        found = self.find(s)
        ids = self._piece(found[0]) if len(found) == 1 else list(chain.from_iterable(map(self._piece, found)))
        if len(s) <= LONGEST:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[s] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; a null and an empty text give an empty list.

        A single space between two other characters that are no white space always begins a pre-token, so the text is first cut
        there, and what lies between, mostly a word with its marks, is looked up whole.
        """
        if not text:
            return []
        cut = text.replace(" ", "\0 ").split("\0") if "\0" not in text and not _ODD(text) else _CUT(text)
        words, slow = self.words, self._word
        return list(chain.from_iterable([words[w] if w in words else slow(w) for w in cut]))


_ODD = re.compile(r"\s | \s").search
_CUT = re.compile(r"(?<=\S)(?= \S)").split
_ENCODERS: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary, kept for the life of the process."""
    key = crc32(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(data))
    return _ENCODERS[key]


def _sent(df: DataFrame, path: str | None):
    """The vocabulary file, read by the driver and sent to the workers (about a megabyte), so that only the driver must see it."""
    with open(path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, ids)``: each row's token ids by the vocabulary file ``path`` (byte_bpe_50k by default), without special tokens.

    Null and empty texts give an empty list; strings that name special tokens are ordinary text. Rows are encoded where they lie,
    without a shuffle; a text of any length is encoded whole. Other columns are dropped.
    """
    sent = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent.value)
        for b in batches:
            texts = b.column(1)
            for lo in range(0, b.num_rows, 1000):
                flat, ends = array("i"), [0]
                for t in texts.slice(lo, 1000):
                    flat.extend(own.encode(t.as_py()))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1000), lists], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, n_tokens bigint)``: how many ids ``token_ids`` gives each row."""
    sent = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(own.encode(t.as_py())) for t in b.column(1)], pa.int64())], ["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
