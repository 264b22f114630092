"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens that a slice of documents needs are encoded together. They lie one after the other in a
linked list of byte positions; pairs never reach over the end of a pre-token. One bucket per merge rank
holds the positions where such a pair starts, a bitmap of three levels tells which buckets are not empty,
and find-first-set on it gives the next rank. Entries whose pair has changed meanwhile are stale and are
skipped. Work is linear in the bytes, so a pre-token of a megabyte costs no more than a thousand short ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from faultgauge.llm.common import slices, texts

NO_RANK = np.int32(2**31 - 1)
#: Pieces of text whose ids a worker remembers; it forgets all of them beyond that.
CACHE_PIECES = 400_000

#: What the pattern takes for white space.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
BEFORE_WHITE = [" " + c for c in WHITE]

SCHEMA = "doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bitmap:
    """A set of small integers; ``pop`` removes the least one. A word of 64 bits sums up 64 words below it."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, x: int) -> None:
        for level in self.levels:
            word, bit = x >> 6, 1 << (x & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            x = word

    def pop(self) -> int:
        """The least member, or -1."""
        if not self.levels[-1][0]:
            return -1
        x = 0
        for level in reversed(self.levels):
            word = level[x]
            x = (x << 6) | ((word & -word).bit_length() - 1)
        found = x
        for level in self.levels:
            word = x >> 6
            level[word] &= ~(1 << (x & 63))
            if level[word]:
                break
            x = word
        return found


class Vocabulary:
    """Ranks of a tokenizer file, and the rank of every pair of tokens that joins to a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.values = np.append(np.array(values, np.int32)[order], NO_RANK)
        left, right = self.keys[:-1] // self.size, self.keys[:-1] % self.size
        # a join with one of these may at once offer a pair of lower rank
        self.lowers = np.zeros(self.size, bool)
        ranks_ = self.values[:-1]
        self.lowers[left[ranks_ < left]] = True
        self.lowers[right[ranks_ < right]] = True

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NO_RANK)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(words), np.uint8)
        if not len(data):
            return [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        n = len(data)
        token = self.byte_ids[data]
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        after = np.arange(1, n + 1, dtype=np.int32)
        after[last] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[1:][last[:-1]] = -1
        rank = np.full(n, NO_RANK, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])

        queue, buckets = Bitmap(self.size), {}

        def push(at: np.ndarray) -> None:
            ranks = rank[at]
            known = ranks != NO_RANK
            at, ranks = at[known], ranks[known]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]):
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    queue.add(r)

        push(inner)
        while (r := queue.pop()) >= 0:
            entries = buckets.pop(r)
            at = entries[0] if len(entries) == 1 else np.unique(np.concatenate(entries))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                if self.lowers[r]:
                    # one pair per word, the leftmost: what it offers may come before the others
                    first = np.ones(len(at), bool)
                    first[1:] = owner[at[1:]] != owner[at[:-1]]
                    if not first.all():
                        buckets[r] = [at[~first]]
                        queue.add(r)
                        at = at[first]
                else:
                    touching = after[at[:-1]] == at[1:]
                    if touching.any():
                        # of pairs that overlap, every other one from the left
                        starts = np.concatenate([[True], ~touching])
                        place = np.arange(len(at))
                        at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            gone = after[at]
            following = after[gone]
            token[at] = r
            token[gone] = -1
            rank[gone] = NO_RANK
            after[at] = following
            has = following >= 0
            before[following[has]] = at[has]
            rank[at] = NO_RANK
            rank[at[has]] = self.pair_ranks(token[at[has]], token[following[has]])
            ahead = before[at]
            led = ahead >= 0
            ahead, led = ahead[led], at[led]
            rank[ahead] = self.pair_ranks(token[ahead], token[led])
            push(np.unique(np.concatenate([at, ahead])))

        alive = token >= 0
        ids = token[alive].astype("<u4").tobytes()
        bounds = np.concatenate([[0], np.cumsum(alive)])
        stops = (bounds[ends] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


class Encoder:
    """Whole texts to ids, with a bounded memory of pieces seen before.

    A piece is what lies between single spaces, with the space before it. A space that stands before
    anything but white space always opens a match of the pattern, so no match reaches over pieces.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary = vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}  # key: the piece without its space

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The pieces without their leading spaces; the first one has none."""
        parts = text.split(" ")
        if text.endswith(" ") or any(pair in text for pair in BEFORE_WHITE):
            # white space beside a space belongs to what comes before
            out = [parts[0]]
            for part in parts[1:]:
                if part and part[0] not in WHITE:
                    out.append(part)
                else:
                    out[-1] += " " + part
            return out
        return parts

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        fresh: set[str] = set()
        for text in batch:
            fresh.update(set(self.pieces(text)[1:]).difference(self.known))
        first = list({self.pieces(text)[0] for text in batch})
        new = list(fresh)
        found = self.ids([*first, *[" " + piece for piece in new]])
        opening = dict(zip(first, found))
        self.known.update(zip(new, found[len(first):]))
        for text in batch:
            parts = self.pieces(text)
            yield opening[parts[0]] + b"".join(map(self.known.__getitem__, parts[1:]))

    def ids(self, pieces: list[str]) -> list[bytes]:
        split = list(map(self.pattern.findall, pieces))
        words = list(set(chain.from_iterable(split)))
        ids = dict(zip(words, self.vocabulary.encode([w.encode() for w in words])))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in split]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids again: one row per row of ``docs``.

    Columns ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. Only ``doc_id`` and ``text`` are
    read. A null text is empty and has no tokens; repeated rows give repeated rows; no row, no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for part in slices(batches, "text"):
            rows = []
            for ids in encoder.encode(part.column(1).to_pylist()):
                decoded = encoder.vocabulary.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = texts(docs)
    return source.mapInArrow(run, SCHEMA.format(key=source.schema["doc_id"].dataType.simpleString()))
