"""A quality classifier without labels of its own.

Several overlapping heuristics vote on each text: good, bad, or nothing. Expectation-maximisation over the
counts of their vote patterns estimates how often each of them is right, and with that a posterior for every
pattern. The posteriors are the labels of a linear scorer over hashed features of the text, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultgauge.llm.common import bounded_batches, slices, written
from faultgauge.llm.order_minhash import mix, word_hashes

TRAIN_TEXTS = 6_000  # distinct texts that the scorer is fitted on, about; votes are counted over all
FEATURES = 1024
ROUNDS = 200  # of expectation-maximisation
STEPS = 200  # of gradient descent
ACCEPT = 0.5

STOP_WORDS = (
    "the of and to in a is that it for was with as on be by this are from at or an not but have "
    "de la le et les des en un une du est que pour dans qui sur par au pas "
    "der die das und ist von mit zu den ein eine auf nicht sich im dem "
    "el los las una por con para del se al lo como su es no"
).split()
STOPS = np.sort(np.array([word_hashes(w)[0] for w in STOP_WORDS], np.uint64))

# kinds of bytes: letters fold to two, digits to one, white space to one, letters beyond ASCII to small ones
KIND = np.zeros(256, np.int64)
KIND[128:] = 1
for _i, _c in enumerate(map(chr, range(33, 127))):
    KIND[ord(_c)] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 0
_marks = [c for c in range(33, 127) if KIND[c] == 0]
KIND[_marks] = np.arange(4, 4 + len(_marks))
KINDS = int(KIND.max()) + 1
#: Bucket of each run of three kinds; the upper part of the vector is for measures in steps.
STEPPED = 64
BUCKET = (mix(np.arange(KINDS**3, dtype=np.uint64) + np.uint64(1)) % np.uint64(FEATURES - STEPPED)).astype(np.int64)
BAD_MARKS = np.array([ord(c) for c in "#$%&*|{}<>~^=\\@_+"], np.int64)


class Measures:
    """What heuristics and features look at, for one text."""

    def __init__(self, text: str):
        data = np.frombuffer(text.encode(), np.uint8)
        self.kinds = KIND[data]
        counts = np.bincount(data, minlength=256)
        words = word_hashes(text)
        self.words = n = len(words)
        self.symbols = counts[BAD_MARKS].sum() / max(n, 1)
        self.shouts = counts[ord("!")] / max(n, 1)
        small, capital = counts[97:123].sum() + counts[128:].sum(), counts[65:91].sum()
        self.capitals = capital / max(small + capital, 1)
        self.letters = (small + capital) / max(len(data) - counts[:33].sum(), 1)
        self.ends = (counts[ord(".")] + counts[ord("?")] + counts[ord("!")]) / max(n, 1)
        self.length = (len(data) - counts[:33].sum()) / max(n, 1)
        if n:
            self.top = np.unique(words, return_counts=True)[1].max() / n
            self.stops = np.isin(words, STOPS).mean()
            same = words[1:] == words[:-1]
            self.again = same.mean() if n > 1 else 0.0
            self.runs = (same[2:] & same[1:-1] & same[:-2]).mean() if n > 3 else 0.0
            threes = mix(words[:-2] + mix(words[1:-1] + mix(words[2:]))) if n > 2 else words[:0]
            self.repeats = 1 - len(np.unique(threes)) / len(threes) if len(threes) else 0.0
        else:
            self.top = self.stops = self.again = self.runs = self.repeats = 0.0


def _between(x: float, good: float, bad: float) -> int:
    """1 on the good side, -1 beyond the bad one, 0 between."""
    if good < bad:
        return 1 if x <= good else -1 if x >= bad else 0
    return 1 if x >= good else -1 if x <= bad else 0


#: Each votes 1 (good), -1 (bad) or 0 (says nothing).
HEURISTICS = (
    lambda m: _between(m.symbols, 0.1, 0.4),
    lambda m: _between(m.letters, 0.9, 0.75),
    lambda m: _between(m.capitals, 0.15, 0.5),
    lambda m: _between(m.shouts, 0.05, 0.4),
    lambda m: _between(m.again, 0.05, 0.25) if m.words >= 10 else 0,
    lambda m: _between(m.runs, 0.02, 0.15) if m.words >= 10 else 0,
    lambda m: _between(m.repeats, 0.1, 0.3) if m.words >= 10 else 0,
    lambda m: _between(m.top, 0.15, 0.3) if m.words >= 20 else 0,
    lambda m: _between(m.stops, 0.12, 0.03) if m.words >= 10 else 0,
    lambda m: _between(m.ends, 0.4, 0.7) if m.ends > 0 and m.words >= 10 else 0,
    lambda m: _between(m.length, 9.0, 14.0) if m.words >= 5 else 0,
    lambda m: -1 if m.words == 0 else 0,
)


def votes(m: Measures) -> str:
    return "".join("-0+"[h(m) + 1] for h in HEURISTICS)


def features(m: Measures) -> np.ndarray:
    """Shares of hashed runs of three kinds of bytes, and indicators of a few measures in steps."""
    out = np.zeros(FEATURES, np.float32)
    k = m.kinds
    if len(k) > 2:
        found = np.bincount(BUCKET[(k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:]], minlength=FEATURES)
        out[:] = np.sqrt(found / (len(k) - 2))
    if m.words:
        for i, x in enumerate((m.top, m.again, m.stops, m.repeats)):
            out[FEATURES - STEPPED + 16 * i + min(15, int(16 * x))] = 1
    return out


def label_model(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior of good for each vote pattern, by expectation-maximisation from the majority's view."""
    if not counts:
        return {}
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    seen = np.array([["-0+".index(c) for c in p] for p in patterns])
    one_hot = np.eye(3)[seen]  # pattern, heuristic, vote
    one_hot[:, :, 1] = 0  # who says nothing is no evidence
    lean = (seen - 1).sum(axis=1)
    # a bad vote is a strong sign at first; the rounds settle how strong
    good = 1 / (1 + np.exp(-(lean - 3.0 * (seen == 0).sum(axis=1) + 1.0)))
    for _ in range(rounds):
        share = np.clip((weight * good).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        logs = []
        for part in (good, 1 - good):
            mass = np.einsum("p,phv->hv", weight * part, one_hot) + [1.0, 0.0, 1.0]
            logs.append(np.log(np.maximum(mass, 1e-12) / mass.sum(axis=1, keepdims=True)))
        odds = np.log(share / (1 - share)) + np.einsum("phv,hv->p", one_hot, logs[0] - logs[1])
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return dict(zip(patterns, good.tolist()))


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the offset of a logistic scorer with soft labels, by accelerated gradient descent."""
    w = np.zeros(x.shape[1] + 1, x.dtype)
    if not len(x):
        return w
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    rate = x.dtype.type(4.0 / np.linalg.norm(x.T @ x / len(x), 2))
    ahead, t = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50)))
        gradient = x.T @ (p - y).astype(x.dtype) / len(x) + ridge * ahead
        new = ahead - rate * gradient
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + x.dtype.type((before - 1) / t) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, sample: int = TRAIN_TEXTS) -> np.ndarray:
    """The scorer's weights. Votes are counted over all rows; about ``sample`` distinct texts train the scorer.

    Only the counts of vote patterns and the weights reach the driver.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    @F.pandas_udf("string")
    def voted(text: pd.Series) -> pd.Series:
        return pd.Series([votes(Measures(t)) for t in text], dtype=object)

    # copies vote once for each row, but are measured where they lie
    patterns = texts.groupBy(voted("text").alias("votes")).agg(F.count("*").alias("n"))
    counts = {r["votes"]: r["n"] for r in written(patterns, "votes").collect()}
    posterior = label_model(counts)
    share = min(1.0, sample / max(1, sum(counts.values())))
    line = min(2**63 - 1, int((2 * share - 1) * 2**63))
    chosen = texts.withColumn("key", F.xxhash64("text")).filter(F.col("key") <= line)
    row = pa.schema([("key", pa.int64()), ("x", pa.binary()), ("y", pa.float64())])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [Measures(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array([features(m).tobytes() for m in found], pa.binary()),
                 pa.array([posterior[votes(m)] for m in found], pa.float64())], schema=row,
            )

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            xs += [np.frombuffer(x, np.float32) for x in batch.column(1).to_pylist()]
            ys += batch.column(2).to_pylist()
        w = fit_scorer(np.array(xs, np.float32).reshape(len(xs), FEATURES), np.array(ys))
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], ["weights"])

    once = chosen.mapInArrow(measured, "key long, x binary, y double").dropDuplicates(["key"])
    table = once.coalesce(1).sortWithinPartitions("key")
    found = table.mapInArrow(trained, "weights array<double>").collect()
    return np.array(found[0]["weights"] if found else np.zeros(FEATURES + 1))


def score(text: Column, weights: np.ndarray) -> Column:
    """Between 0 (bad) and 1 (good); a null text is scored as the empty one."""
    weights = np.asarray(weights)

    @F.pandas_udf("double")
    def scored(values: pd.Series) -> pd.Series:
        return pd.Series([float(features(Measures(t)) @ weights[:-1] + weights[-1]) for t in values], dtype=float)

    return F.round(1 / (1 + F.exp(-scored(F.coalesce(text, F.lit(""))))), 9)


def classify(docs: DataFrame, sample: int = TRAIN_TEXTS) -> DataFrame:
    """``doc_id, score, accepted`` of every row of ``docs(doc_id, text)``.

    A text without words is never accepted. Repeated rows give repeated rows with the same score; an empty
    table gives no rows.
    """
    weights = fit(docs, sample)
    scored = docs.select("doc_id", score(F.col("text"), weights).alias("score"), solid(F.col("text")).alias("solid"))
    return scored.select("doc_id", "score", ((F.col("score") >= ACCEPT) & F.col("solid")).alias("accepted"))


def accepted(docs: DataFrame, sample: int = TRAIN_TEXTS) -> DataFrame:
    """The rows of ``docs`` whose texts are accepted, with all columns as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = docs.select(row, score(F.col("text"), fit(docs, sample)).alias("score"))
    return scored.filter((F.col("score") >= ACCEPT) & solid(F.col("row.text"))).select("row.*")


def solid(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))
