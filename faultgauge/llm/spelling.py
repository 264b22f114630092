"""Spelling variants: words one edit apart, found through words written in a few symbols.

Letters are hashed to ``SYMBOLS`` symbols, and every reduced word yields all reduced words within one edit of it. Words
one edit apart have reduced forms at most one edit apart, so joining these neighbourhoods with the reduced vocabulary
finds every pair; the pairs are then verified on the words themselves. Reduced words travel as 64-bit sums, from which
a word's whole neighbourhood follows in a few array operations, whatever its length. Equal reduced words have equal
sums; unequal ones that meet only add pairs that fail the verification.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from faultgauge.llm.common import slices, texts, written

WORD = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO, ONE_IN = 6, 5, 5, 199
SYMBOLS = 6  # twelve neighbours for each letter of a reduced word; more symbols, fewer pairs to verify
HELD = 300_000  # words a task counts before it hands them on
AT_ONCE = 100_000  # letters whose neighbours are made at once

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
LINKS = pa.schema([("code", pa.int64()), ("near", pa.int64())])

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def varied(doc_id: int | None, run: str, one_in: int = ONE_IN) -> str:
    """The run, or for one in so many (document, run) the run without one of its letters; as it is without an id."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` over all ``docs(doc_id, text)``: runs of letters, A-Z lowered, some with a letter deleted.

    Words are summed in each task before the shuffle. A null text has none; rows that repeat count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                # bytes.lower() leaves everything but A-Z
                runs = Counter(m.group() for m in WORD.finditer(text.encode().lower().decode()) if m.end() - m.start() >= least_length)
                for word, n in runs.items():
                    held[varied(doc_id, word)] += n
                    if len(held) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTS)
                        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTS)

    sums = texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def reduced(words: list[str], symbols: int = SYMBOLS) -> list[bytes]:
    """Words with each letter replaced by one of ``symbols`` symbols, numbered from 1."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    marks = ((points * np.uint64(2654435761) >> np.uint64(13)) % np.uint64(symbols) + np.uint64(1)).astype(np.uint8).tobytes()
    out, start = [], 0
    for word in words:
        out.append(marks[start : start + len(word)])
        start += len(word)
    return out


def neighbourhoods(forms: np.ndarray, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """For reduced words of one length (a row each): their sums, and the sums of all words within one edit, themselves included.

    A word's sum is that of its symbols times powers of an odd base, modulo 2^64. An edit changes one term, and
    moves those behind it by one power. Edits that give the same word (in a run of one symbol) are made once.
    """
    rows, length = forms.shape
    marks = forms.astype(np.uint64)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(length + 1, BASE)]))
    before = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(marks * powers[:length], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    owners, sums = [np.arange(rows)], [whole[:, 0]]

    def found(keep: np.ndarray, values: np.ndarray) -> None:
        owners.append(np.nonzero(keep)[0])
        sums.append(values[keep])

    first_of_run = np.ones((rows, length), bool)
    first_of_run[:, 1:] = marks[:, 1:] != marks[:, :-1]
    found(first_of_run, before[:, :-1] + (whole - before[:, 1:]) * INVERSE)
    room = np.ones((rows, length + 1), bool)
    for symbol in range(1, symbols + 1):
        s = np.uint64(symbol)
        other = marks != s
        found(other, whole + (s - marks) * powers[:length])
        room[:, :length] = other
        found(room, before + s * powers[: length + 1] + (whole - before) * BASE)
    return whole[:, 0], np.stack([whole[np.concatenate(owners), 0], np.concatenate(sums)])


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, near, near_n`` for every two of the distinct ``words(word, n)`` that are one edit apart, from both sides."""

    @F.pandas_udf(StructType().add("code", LongType()).add("form", "binary"))
    def coded(word: pd.Series) -> pd.DataFrame:
        forms = reduced(word.tolist(), symbols)
        codes = []
        for form in forms:
            marks = np.frombuffer(form, np.uint8).astype(np.uint64)
            powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(len(form) - 1, 0), BASE)]))
            codes.append((marks * powers[: len(form)]).sum(dtype=np.uint64))
        return pd.DataFrame({"code": np.array(codes, np.uint64).view(np.int64), "form": pd.Series(forms, dtype=object)})

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[bytes]] = {}
            for form in batch.column(0).to_pylist():
                by_length.setdefault(len(form), []).append(form)
            for length, forms in by_length.items():
                step = max(1, AT_ONCE // max(length, 1))
                for start in range(0, len(forms), step):
                    some = forms[start : start + step]
                    table = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), length)
                    _, pairs = neighbourhoods(table, symbols)
                    yield pa.RecordBatch.from_arrays([pa.array(side.view(np.int64)) for side in pairs], schema=LINKS)

    vocabulary = written(words.select("word", "n", coded("word").alias("c")).select("word", "n", "c.code", "c.form"), "vocabulary")
    reach = vocabulary.select("form").distinct().mapInArrow(links, "code long, near long")
    met = reach.join(vocabulary.select(F.col("code").alias("near")).distinct(), "near")
    sides = vocabulary.select("word", "n", "code").join(met, "code").select("word", "n", F.col("near").alias("code"))
    others = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "code")
    pairs = sides.join(others, "code").filter(F.levenshtein("word", "near", 1) == 1)
    # two reduced words with one sum would bring a pair twice
    return pairs.select("word", "n", "near", "near_n").distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``forms(word, form)`` by doubling steps; counts grow along forms, so there is no circle."""
    current = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("at"), F.col("root").alias("onward"))
        moved = written(current.join(onward, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")
        ), "roots")
        current = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return current


def variants(docs: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs(doc_id, text)``.

    A word's form is its near word of largest count (ties: least in code-point order) if that is ``ratio`` times its
    own at least, else null; the root follows forms to the last one. Columns of other names have no part. No texts,
    no rows.
    """
    words = written(counts(docs), "words")
    best = near_words(words, symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    is_form = -F.col("best.less") >= ratio * F.col("n")
    out = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    ), "forms")
    roots = _followed(out.filter(F.col("form").isNotNull()))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
