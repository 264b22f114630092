"""Document fingerprints from closed syncmers.

A k-mer of bytes is an anchor when its least inner s-mer (by a fixed hash) stands at either edge of it. The
choice looks at nothing outside the k-mer, so equal passages hold equal anchors wherever they stand. A
fingerprint keeps the anchors with the least hashes, a fixed share of all and a number of them at least, each
with its first position; two fingerprints are alike in so far as they share anchors in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultgauge.llm.common import slices, texts

INNER = 8  # bytes of the inner substring
WINDOW = 17  # inner substrings in a k-mer
K = INNER + WINDOW - 1
ANCHORS = 64  # anchors in a fingerprint, at least
LIMIT = 1 << 28  # hashes below it, one in sixteen, are all in the fingerprint, so that it grows with a long text

SCHEMA = (
    "doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of all closed syncmers, by ascending hash."""
    none = np.empty(0, np.uint32), np.empty(0, np.int64)
    if not data:
        return none
    count = len(data) - K + 1
    at = np.empty(0, np.int64)
    if count > 0:
        inner = mix(np.ndarray((len(data) - INNER + 1,), "<u8", data, strides=(1,)).astype(np.uint64))
        least = inner
        for step in (1, 2, 4, 8):  # least of 2, 4, 8, 16 neighbours
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[:-1], least[1:])
        at = np.flatnonzero((inner[:count] == least) | (inner[WINDOW - 1 :] == least))
    if not len(at):
        # too short for an anchor: the text as a whole is one
        whole = int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little")
        return np.array([whole], np.uint32), np.zeros(1, np.int64)
    whole = mix(inner[at] + mix(inner[at + INNER] + mix(inner[at + 2 * INNER]))) >> np.uint64(32)
    hashes, first = np.unique(whole.astype(np.uint32), return_index=True)
    return hashes, at[first]


Print = tuple[tuple[int, ...], tuple[int, ...]]


def fingerprint(text: str, size: int = ANCHORS) -> Print:
    hashes, at = anchors(text.encode())
    size = max(size, int(np.searchsorted(hashes, LIMIT)))
    return tuple(hashes[:size].tolist()), tuple(at[:size].tolist())


def complete(print_: Print, size: int = ANCHORS) -> int:
    """The greatest hash up to which a fingerprint has every anchor of its text."""
    return 1 << 32 if len(print_[0]) < size else max(print_[0][-1], LIMIT - 1)


def as_text(print_: Print) -> str:
    """Eight hexadecimal digits for the hash and eight for the position of each anchor; empty for an empty text."""
    return "".join(f"{h:08x}{p:08x}" for h, p in zip(*print_))


def likeness(a: Print, b: Print, size: int = ANCHORS) -> float:
    """Share of both texts that their anchors have in common, in the same order; 0 to 1.

    Of the hashes up to which both fingerprints are complete, those in both are counted as far as their positions
    rise in step (the longest such chain); the Jaccard ratio j is returned as the share 2j / (1 + j).
    """
    if a == b:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    there = dict(zip(*b))
    last = min(complete(a, size), complete(b, size))
    least = {h for h in (*a[0], *b[0]) if h <= last}
    shared = sorted((p, there[h]) for h, p in zip(*a) if h <= last and h in there)
    chain: list[int] = []
    for _, p in shared:
        i = bisect_left(chain, p)
        chain[i : i + 1] = [p]
    j = len(chain) / len(least)
    return 2 * j / (1 + j)


def with_next(docs: DataFrame, pieces: int) -> DataFrame:
    """Rows dealt to tasks by ranges of descending ``doc_id``, each range closed by a copy of the next one's first row.

    Columns ``doc_id, text, bucket, extra``, sorted within each task by bucket; copies (``extra``) come first.
    Rows without a ``doc_id`` come last. Only the cut points and the first id of each range reach the driver.
    Texts are shuffled once.
    """
    ids = docs.select("doc_id")
    shares = [i / pieces for i in range(1, pieces)]
    cuts = ids.agg(F.percentile_approx("doc_id", shares, 100 * pieces).alias("cuts")).first()["cuts"] if shares else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def ranges(ids: pd.Series) -> np.ndarray:
        found = 1 + np.searchsorted(cuts, ids.fillna(0).to_numpy().astype(np.int64), "right")
        return np.where(ids.notna().to_numpy(), found, 0).astype(np.int32)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(ranges(ids))

    first = ids.select(bucket("doc_id").alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id").alias("head"))
    heads = {r["b"]: r["head"] for r in first.collect()}
    order = sorted(heads, reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first range follows the last one

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        rows = zip(ranges(ids).tolist(), ids.tolist())
        return pd.Series([[2 * b, 2 * before[b] + 1] if b == 0 or i == heads[b] else [2 * b] for b, i in rows])

    dealt = docs.select("doc_id", "text", F.explode(targets("doc_id")).alias("t"))
    return (
        dealt.select("doc_id", "text", F.expr("t div 2").cast("int").alias("bucket"), (F.col("t") % 2 == 1).alias("extra"))
        .repartition(pieces, "bucket")
        .sortWithinPartitions("bucket", F.desc("extra"), F.desc_nulls_last("doc_id"), "text")
    )


def fingerprints(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, whose last half is the next document's beginning.

    The next document is that with the next smaller ``doc_id``; after the last comes the first. Equal ids
    follow each other by text; rows without an id come after all others. A null text is empty; an empty text
    has an empty fingerprint, alike only to another empty one. A single document is its own next one. An
    empty table gives no rows. Only ``doc_id`` (an integer) and ``text`` are read.
    """
    source = texts(docs)
    pieces = pieces or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one: bucket, doc_id, text, fingerprint
        wrap = None  # the row after the last one of the bucket: text, fingerprint
        done: list[tuple] = []

        def finish(row: tuple, text: str, print_: Print) -> None:
            _, doc_id, own, own_print = row
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            other = own_print if edited == own else fingerprint(edited)
            done.append((
                doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_text(own_print), as_text(other),
                likeness(own_print, other), likeness(own_print, print_),
            ))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 7
            kinds = [key, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], NAMES)
            done.clear()
            return out

        key = pa.int64()
        for part in slices(batches, "text"):
            key = part.schema.field("doc_id").type
            for doc_id, text, bucket, extra in zip(*[part.column(i).to_pylist() for i in range(4)]):
                print_ = fingerprint(text)
                if held and held[0] != bucket:
                    finish(held, *wrap)
                    held = None
                if extra:
                    if wrap is None or wrap_of != bucket:
                        wrap, wrap_of = (text, print_), bucket
                    continue
                if held:
                    finish(held, text, print_)
                held = (bucket, doc_id, text, print_)
            yield flush()
        if held:
            finish(held, *wrap)
            yield flush()

    kind = source.schema["doc_id"].dataType.simpleString()
    return with_next(source, pieces).mapInArrow(run, SCHEMA.format(key=kind))


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
