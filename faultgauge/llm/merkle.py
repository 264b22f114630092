"""Merkle manifest of a dataset: aligned builders append nodes to a log in postorder, proofs address siblings in it.

Every source has a tree of runs of three over its rows in order; the roots of the sources form one more tree. Rows are
numbered by ranges, then dealt in aligned blocks of ``SPAN`` leaves. A builder sees one block and appends each node when
it is complete, so a block's nodes are one piece of the tree's postorder log. The tops of the blocks are the leaves of
the next round, until each tree has one. The position of a node in the log follows from the sizes of the subtrees that
are complete before it. That is where proofs find siblings: first those in the block, then, once for the whole block,
those above it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from faultgauge.llm.common import written
from faultgauge.llm.ordering import placed

ARITY = 3
LEVELS = 5  # of a block
SPAN = ARITY**LEVELS  # leaves of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = ArrayType(StructType().add("left", StringType()).add("right", StringType()))
NODE = StructType().add("level", IntegerType()).add("position", LongType()).add("digest", StringType())
PROOF = StructType().add("leaf", StringType()).add("proof", StringType()).add("folded", StringType())


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields, each with its length in bytes ahead; ``-`` stands for a null."""
    values = [c.cast("string") for c in fields]
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*parts), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def position(n: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places in the postorder log of a tree of ``n`` leaves; works for any level at or below the root's.

    Before a node come the whole subtrees to its left and the nodes under it; levels are counted one by one.
    """
    first, end = index * ARITY**level, (index + 1) * ARITY**level
    place = np.zeros_like(index) - 1
    for j in range(height(n) + 1):
        place = place + (np.minimum(-(-end // ARITY**j), -(-n // ARITY**j)) if j <= level else first // ARITY**j)
    return place


def append(leaves: list[str], whole: bool) -> list[str]:
    """Nodes over ``leaves`` in the order of their completion; ``whole`` trees end at their root, others at ``LEVELS``."""
    log: list[str] = []
    open_runs: list[list[str]] = [[]]
    top = height(len(leaves)) if whole else LEVELS

    def complete(node: str, level: int) -> None:
        log.append(node)
        if level == len(open_runs):
            open_runs.append([])
        open_runs[level].append(node)
        if len(open_runs[level]) == ARITY and level < top:
            close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        complete(digest("".join(run)), level + 1)

    for node in leaves:
        complete(node, 0)
    for level in range(top):
        if open_runs[level]:
            close(level)
    return log


def levels_of(log: list[str], n: int, whole: bool) -> list[list[str]]:
    """Nodes of a block by level, each read at its position in the log."""
    top = height(n) if whole else LEVELS
    # up to the block's top, a block's nodes lie as those of a tree of its own; a short one has single nodes above that
    h = height(n)
    found = [[log[p] for p in position(n, level, np.arange(-(-n // ARITY**level)))] for level in range(min(h, top) + 1)]
    return found + [[log[len(log) - (top - h) + i]] for i in range(top - h)]


def siblings(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """By level below the top: what stands left and right of each node in its run."""
    out = []
    for nodes in levels[:-1]:
        level = []
        for i in range(len(nodes)):
            start = i - i % ARITY
            level.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + ARITY])))
        out.append(level)
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _hex(log: bytes) -> list[str]:
    text = log.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


@F.pandas_udf(BinaryType())
def _append(leaves: pd.Series, whole: pd.Series) -> pd.Series:
    return pd.Series([bytes.fromhex("".join(append([x.hex() for x in block], w))) for block, w in zip(leaves, whole)], dtype=object)


@F.pandas_udf(ArrayType(PATH))
def _paths(log: pd.Series, n: pd.Series, whole: pd.Series, above: pd.Series) -> pd.Series:
    """For each leaf of a block, its siblings up to the block's top and then those of the top."""
    out = []
    for nodes, leaves, w, outer in zip(log, n, whole, above):
        levels = siblings(levels_of(_hex(nodes), leaves, w))
        rest = [{"left": s["left"], "right": s["right"]} for s in outer]
        out.append([
            [dict(zip(("left", "right"), level[i // ARITY**k])) for k, level in enumerate(levels)] + rest for i in range(leaves)
        ])
    return pd.Series(out, dtype=object)


@F.pandas_udf(ArrayType(PROOF))
def _proofs(log: pd.Series, n: pd.Series, whole: pd.Series, above: pd.Series, presented: pd.Series) -> pd.Series:
    """For each leaf of a block: itself, the digest of its siblings, and the root that the presented leaf leads to."""
    out = []
    for nodes, leaves, w, outer, shown in zip(log, n, whole, above, presented):
        levels = levels_of(_hex(nodes), leaves, w)
        beside = siblings(levels)
        rest = [(s["left"], s["right"]) for s in outer]
        tail = "".join(left + right for left, right in rest)
        rows = []
        for i in range(leaves):
            own = [level[i // ARITY**k] for k, level in enumerate(beside)]
            given = levels[0][i] if shown[i] is None else shown[i].hex()
            rows.append({
                "leaf": levels[0][i], "proof": digest("".join(left + right for left, right in own) + tail), "folded": fold(given, own + rest),
            })
        out.append(rows)
    return pd.Series(out, dtype=object)


@F.pandas_udf(ArrayType(NODE))
def _nodes(log: pd.Series, n: pd.Series, whole: pd.Series, block: pd.Series, total: pd.Series, depth: pd.Series) -> pd.Series:
    """The nodes of a block at their positions in the log of its whole tree; ``depth`` levels lie below the block's leaves."""
    out = []
    for nodes, leaves, w, b, size, below in zip(log, n, whole, block, total, depth):
        rows = []
        for level, found in enumerate(levels_of(_hex(nodes), leaves, w)):
            if level or not below:  # the leaves of a later round are the tops of the one before
                index = b * (SPAN // ARITY**level) + np.arange(len(found))
                places = position(size, below + level, index)
                rows += [{"level": below + level, "position": p, "digest": d} for p, d in zip(places.tolist(), found)]
        out.append(rows)
    return pd.Series(out, dtype=object)


@dataclass
class Manifest:
    """``sources(tree, source, n)``; the rounds of the source trees, and those of the tree over their roots (tree 0).

    A round holds a row for each block: ``tree, n`` (leaves of the tree in this round), ``block, leaves`` (of the
    block), ``log`` (its nodes, 32 bytes each, in postorder); the first one of the source trees also ``ids, presented``.
    """

    sources: DataFrame
    rounds: list[DataFrame]
    upper: list[DataFrame]


def _whole() -> Column:
    return F.col("n") <= SPAN


def _top() -> Column:
    return F.expr("substring(log, -32, 32)")


def _blocks(entries: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deal ``entries(tree, n, at, leaf)`` in aligned blocks and build each; a block has at most ``SPAN`` entries."""
    row = F.struct("at", "leaf", *carry)
    block = F.floor(F.col("at") / SPAN).cast("long").alias("block")
    dealt = entries.groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return written(dealt.select(
        "tree", "n", "block", F.size("rows").alias("leaves"), _append("rows.leaf", _whole()).alias("log"), *[F.col(f"rows.{c}").alias(c) for c in carry]
    ), "log")


def _rounds(entries: DataFrame, most: int, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """Blocks of the entries, of the tops of these, and so on until no tree has more than one; ``most`` leaves in a tree."""
    out = [_blocks(entries, carry)]
    while most > SPAN:
        most = -(-most // SPAN)
        tops = out[-1].filter(~_whole()).select("tree", F.ceil(F.col("n") / SPAN).cast("long").alias("n"), F.col("block").alias("at"), _top().alias("leaf"))
        out.append(_blocks(tops))
    return out


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree: the top of its only block."""
    return reduce(DataFrame.unionByName, [r.filter(_whole()).select("tree", _top().alias("root")) for r in rounds])


def build(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, presented: dict[str, Column] | None = None) -> Manifest:
    """Manifest of all rows of ``docs``: by source (null first, then bytewise), in each by key (null first, ties by leaf).

    ``presented`` gives other values of fields, by which a proof is to be tested. Texts are hashed where they are
    read; only digests are sorted and dealt.
    """
    plain = leaf([docs[f] for f in fields])
    shown = leaf([(presented or {}).get(f, docs[f]) for f in fields])
    hashed = docs.select(docs[source].alias("source"), docs[key].alias("ids"), F.unhex(plain).alias("leaf"), F.unhex(shown).alias("presented"))
    # a leaf that is presented as it is needs no second digest
    leaves = written(hashed.withColumn("presented", F.when(F.col("presented") != F.col("leaf"), F.col("presented"))), "leaves")
    order = placed(leaves, ["source", "ids"], ["leaf", "presented"], ["source", "ids", "leaf", "presented"]).drop("name")
    counted = written(order.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n")), "sources")
    sources = written(placed(counted, ["source"], [], ["source", "first", "n"]).drop("name").withColumnRenamed("place", "tree"), "sources")
    # one row for each source on this side; a hot source's rows are split by the skew join
    of = sources.withColumnRenamed("source", "of")
    entries = order.join(of, F.col("source").eqNullSafe(F.col("of"))).select(
        "tree", "n", (F.col("place") - F.col("first")).alias("at"), "ids", "leaf", "presented"
    )
    many, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    rounds = _rounds(entries, most, ("ids", "presented"))
    over = _roots(rounds).select(F.lit(0).cast("long").alias("tree"), F.lit(many).cast("long").alias("n"), F.col("tree").alias("at"), F.col("root").alias("leaf"))
    return Manifest(sources, rounds, _rounds(over, many))


def nodes(manifest: Manifest) -> DataFrame:
    """``source, level, position, digest``: the whole log of each source's tree; leaves have level 0."""
    trees = manifest.sources.select("tree", "source", F.col("n").alias("total"))
    parts = []
    for k, blocks in enumerate(manifest.rounds):
        found = _nodes("log", "leaves", _whole(), "block", "total", F.lit(k * LEVELS))
        parts.append(blocks.join(trees, "tree").select("source", F.explode(found).alias("node")).select("source", "node.*"))
    return reduce(DataFrame.unionByName, parts)


def _above(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """``tree, block, above`` of the first round's blocks, from ``paths(tree, above)`` of the trees' roots, downwards."""
    whole = lambda r: r.filter(_whole()).select("tree", "block").join(paths, "tree")
    above = whole(rounds[-1])
    for here, below in zip(rounds[:0:-1], rounds[-2::-1]):
        each = here.join(above, ["tree", "block"]).select("tree", "block", F.posexplode(_paths("log", "leaves", _whole(), "above")).alias("i", "path"))
        inner = each.select("tree", (F.col("block") * SPAN + F.col("i")).alias("block"), F.col("path").alias("above"))
        above = whole(below).unionByName(inner)
    return above


def proofs(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``proof_sha256`` is of the siblings, level by level up to the root and from left to right; ``folded_root`` is what
    the presented leaf leads to with them; ``verified`` tells whether that is the root. No rows, no proofs.
    """
    upper = manifest.upper
    spark = manifest.sources.sparkSession
    start = spark.range(1).select(F.col("id").alias("tree"), F.from_json(F.lit("[]"), PATH).alias("above"))
    lowest = _above(upper, start)
    of_source = upper[0].join(lowest, ["tree", "block"]).select(
        F.col("block"), F.posexplode(_paths("log", "leaves", _whole(), "above")).alias("i", "path")
    ).select((F.col("block") * SPAN + F.col("i")).alias("tree"), F.col("path").alias("above"))
    above = _above(manifest.rounds, written(of_source, "paths"))
    subroots = _roots(manifest.rounds).withColumnRenamed("root", "subroot")
    blocks = manifest.rounds[0].join(above, ["tree", "block"]).join(subroots, "tree")
    rows = blocks.select(
        "subroot", F.explode(F.arrays_zip("ids", _proofs("log", "leaves", _whole(), "above", "presented").alias("p"))).alias("x")
    )
    # one digest for the whole dataset
    last = _roots(upper).first()
    root = F.lit(bytes(last["root"]).hex() if last else "")
    return rows.select(
        F.col("x.ids").alias(key), F.col("x.p.leaf").alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), root.alias("root"),
        F.col("x.p.proof").alias("proof_sha256"), F.col("x.p.folded").alias("folded_root"), (F.col("x.p.folded") == root).alias("verified"),
    )
