"""Mix documents to target weights of domains that they belong to only in part.

A naive Bayes classifier over hashed words, fitted on labelled rows, gives each document a posterior over the
domains. Each document gets a rate, the number of times that it is to be used; rates are fitted by projected
gradient descent on the squares of the relative gaps between expected domain token totals and their targets.
A step moves a document's rate by its posterior times the gaps, so rates follow from the posterior and the
short list of all gaps so far: a round is one sum over the table of posteriors, without a join or a shuffle of rows.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from faultgauge.llm.common import written

BUCKETS = 4096  # of word hashes
LABELLED = 4_000  # labelled rows that the classifier is fitted on, about
EVIDENCE = 20.0  # a text counts as so many independent words
SMOOTHING = 0.5
ROUNDS = 60  # of plain descent; beyond, steps are scaled by the curvature
CLOSE = 1e-4  # greatest relative gap to stop at
STALLED = 1e-4  # three scaled steps that take less than this share off the squares of the gaps end the descent
WRITE_EVERY = 12  # rounds between two written tables of rates


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = LABELLED) -> list[tuple[float, list[float]]]:
    """For each domain the logarithm of its share and those of its words' shares, from ``labelled(doc_id, domain)``.

    About ``sample`` labelled rows are read, those with the least hashes of their ids. Only a number for each
    domain and bucket reaches the driver.
    """
    known = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain").distinct()
    share = min(1.0, sample / max(1, known.count()))
    line = min(2**63 - 1, int((2 * share - 1) * 2**63))
    few = known.filter(F.xxhash64("doc_id") <= line)
    text = docs.filter(F.xxhash64("doc_id") <= line).select("doc_id", "text")
    rows = text.join(few, "doc_id").select("domain", F.explode(words(F.col("text"))).alias("word"))
    counted = rows.groupBy("domain", bucket(F.col("word")).alias("b")).agg(F.count("*").alias("n")).collect()
    out = []
    total = sum(r["n"] for r in counted)
    for domain in domains:
        counts = [0.0] * BUCKETS
        for r in counted:
            if r["domain"] == domain:
                counts[r["b"]] = r["n"]
        n = sum(counts)
        out.append((
            math.log((n + 1) / (total + len(domains))),
            [math.log((c + SMOOTHING) / (n + SMOOTHING * BUCKETS)) for c in counts],
        ))
    return out


def posterior(text: Column, model: list[tuple[float, list[float]]]) -> Column:
    """An array of one share for each domain; a text without words has the domains' own shares."""
    weights = [F.from_json(F.lit(json.dumps(w)), "array<double>") for _, w in model]
    zero = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(f"s{d}") for d in range(len(model))])

    def add(sums: Column, b: Column) -> Column:
        return F.struct(
            (sums["n"] + 1).alias("n"), *[(sums[f"s{d}"] + F.get(w, b)).alias(f"s{d}") for d, w in enumerate(weights)]
        )

    def shares(sums: Column) -> Column:
        each = [F.lit(p) + F.lit(EVIDENCE) * sums[f"s{d}"] / F.greatest(sums["n"], F.lit(1)) for d, (p, _) in enumerate(model)]
        top = F.greatest(*each) if len(each) > 1 else each[0]
        powers = F.array(*[F.exp(e - top) for e in each])
        return F.struct(
            sums["n"].cast("long").alias("n"),
            F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)).alias("p"),
        )

    return F.aggregate(F.transform(words(text), bucket), zero, add, shares)


def memberships(docs: DataFrame, model: list[tuple[float, list[float]]], *keep: str) -> DataFrame:
    found = docs.select(*keep, posterior(F.col("text"), model).alias("_m"))
    return found.select(*keep, F.col("_m.n").alias("n_tokens"), F.col("_m.p").alias("p"))


def stepped(rate: Column, share: list[Column], steps: list[list[float]], least: float) -> Column:
    for step in steps:
        moved = rate
        for p, s in zip(share, step):
            moved = moved - F.lit(s) * p
        rate = F.greatest(F.lit(least), moved)
    return rate


def fit_rates(found: DataFrame, targets: list[float], least: float = 0.0) -> tuple[list[list[float]], list[float]]:
    """The steps that lead from rates of 1 to the fitted ones, from ``found(n_tokens, p)``, and the relative gaps left.

    ``targets`` are token totals. A step is a list of one number for each domain: a rate falls by their sum
    weighted with the document's posterior, but not below ``least``. The descent goes on until all gaps are below
    ``CLOSE``, or until their squares no longer shrink: then no rates meet the targets.
    """
    d = len(targets)
    share = [F.col("p")[i] for i in range(d)]
    n = F.col("n_tokens")
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    gram = found.agg(*[F.sum(n * share[i] * share[j]).alias(f"g{i}_{j}") for i, j in cells]).first()
    if gram[0] is None:
        return [], []
    g = [[0.0] * d for _ in range(d)]
    for (i, j), x in zip(cells, gram):
        g[i][j] = g[j][i] = x / (targets[i] * targets[j])
    # a row sum bounds the greatest eigenvalue of the relative problem
    bound = max(max(sum(row) for row in g), 1e-300)
    steps: list[list[float]] = []
    state, since = found.select("n_tokens", "p", F.lit(1.0).alias("rate")), 0

    def gaps_after(more: list[list[float]]) -> list[float]:
        rate = stepped(F.col("rate"), share, steps[since:] + more, least)
        totals = state.agg(*[F.sum(n * rate * share[i]).alias(f"t{i}") for i in range(d)]).first()
        return [(t - wanted) / wanted for t, wanted in zip(totals, targets)]

    def curvature(slope: list[float]) -> np.ndarray:
        """How the gaps follow a step, by the documents that it can move: those above the bound or pushed upwards."""
        rate = stepped(F.col("rate"), share, steps[since:], least)
        push = sum((F.lit(s) * p for s, p in zip(slope, share)), F.lit(0.0))
        free = state.select("n_tokens", "p", rate.alias("rate")).filter((F.col("rate") > least) | (push < 0))
        found_ = free.agg(*[F.coalesce(F.sum(n * share[i] * share[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in cells]).first()
        out = np.zeros((d, d))
        for (i, j), x in zip(cells, found_):
            out[i, j] = out[j, i] = x / (targets[i] * targets[j])
        return out

    def take(step: list[float]) -> None:
        nonlocal state, since
        steps.append(step)
        if len(steps) - since == WRITE_EVERY:
            rate = stepped(F.col("rate"), share, steps[since:], least)
            state, since = written(state.select("n_tokens", "p", rate.alias("rate")), "rates"), len(steps)

    gaps = gaps_after([])
    for _ in range(ROUNDS):
        if max(abs(x) for x in gaps) < CLOSE:
            return steps, gaps
        take([gap / bound / wanted for gap, wanted in zip(gaps, targets)])
        gaps = gaps_after([])
    # domains of very unequal size: steps scaled by the curvature, damped up to a plain one, which always helps
    damping, slow = 1e-6 * bound, 0
    while max(abs(x) for x in gaps) >= CLOSE and slow < 3:
        here = curvature([gap / wanted for gap, wanted in zip(gaps, targets)])
        before = sum(x * x for x in gaps)
        while True:
            scaled = np.linalg.solve(here + damping * np.eye(d), gaps) if damping < bound else np.array(gaps) / bound
            step = [float(x) / wanted for x, wanted in zip(scaled, targets)]
            tried = gaps_after([step])
            if sum(x * x for x in tried) < before:
                break
            if damping >= bound:
                return steps, gaps
            damping = min(bound, 100 * damping)
        take(step)
        gaps, damping = tried, max(damping / 10, 1e-12 * bound)
        slow = slow + 1 if sum(x * x for x in gaps) > (1 - STALLED) * before else 0
    return steps, gaps


def reported(steps_and_gaps: tuple[list[list[float]], list[float]], domains: list[str]) -> list[list[float]]:
    """The steps; gaps that no rates close are told."""
    steps, gaps = steps_and_gaps
    if any(abs(x) >= CLOSE for x in gaps):
        warnings.warn("targets are not met: " + ", ".join(f"{d} {x:+.2%}" for d, x in zip(domains, gaps)), stacklevel=3)
    return steps


def wanted_totals(found: DataFrame, weights: list[float], grow: bool) -> list[float]:
    """Token totals by ``weights``: of as many tokens as there are, or with ``grow`` so many that none must be left out."""
    d = len(weights)
    row = found.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(d)]).first()
    totals = [x or 0.0 for x in row]
    size = max(t / w for t, w in zip(totals, weights)) if grow else sum(totals)
    return [max(size, 1.0) * w for w in weights]


def copies(rate: Column, *key: Column) -> Column:
    """A whole number of uses whose mean over documents is the rate: the hash of the key rounds it up or down."""
    return F.floor(rate + F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("int")


def rates(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], sample: int = LABELLED, grow: bool = False, least: float = 0.0
) -> DataFrame:
    """``doc_id, n_tokens, p_<domain> ..., rate, copies`` of every row of ``docs(doc_id, text)``.

    ``weights`` are the domains' shares of tokens (words between spaces), greater than 0 and 1 together. A null
    text is empty; an empty one has no tokens, the domains' own shares as posterior, and a rate like any other
    document of that posterior. Repeated rows have equal rates. Without labelled rows all domains are equally
    likely and targets are met as far as that allows. An empty table gives no rows.
    """
    domains = sorted(weights)
    model = fit(docs, labelled, domains, sample)
    found = written(memberships(docs, model, "doc_id"), "memberships")
    shares = [weights[d] for d in domains]
    steps = reported(fit_rates(found, wanted_totals(found, shares, grow), least), domains)
    rate = stepped(F.lit(1.0), [F.col("p")[i] for i in range(len(domains))], steps, least)
    out = found.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], rate.alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("n_tokens")))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], sample: int = LABELLED) -> DataFrame:
    """``docs`` with each row as often as its rate says, and at least once: small domains are repeated, none is cut.

    All columns are kept as they are, also those that share a name with a column of this module.
    """
    domains = sorted(weights)
    model = fit(docs, labelled, domains, sample)
    found = written(memberships(docs, model), "memberships")
    steps = reported(fit_rates(found, wanted_totals(found, [weights[d] for d in domains], True), 1.0), domains)
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    scored = docs.select(kept, posterior(F.col("text"), model)["p"].alias("p"))
    rate = stepped(F.lit(1.0), [F.col("p")[i] for i in range(len(domains))], steps, 1.0)
    times = scored.select("kept", copies(rate, F.col("kept.doc_id"), F.col("kept.text")).alias("times"))
    return times.select("kept", F.explode(F.sequence(F.lit(1), F.col("times")))).select("kept.*")
