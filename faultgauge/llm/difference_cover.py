"""Order of all suffixes of a long string of numbers, by the difference cover modulo 3.

Suffixes at places that are not divisible by 3 are the sample. Their triples are sorted and named; if names
repeat, the string of names is sorted the same way. The other suffixes follow from their first symbol and the
rank of the sampled suffix after it, and both orders are merged by counting, for each suffix, those of the
other kind before it. Every step is a join or a sort by ranges over rows of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultgauge.llm.common import written
from faultgauge.llm.ordering import placed


def ranks(text: DataFrame, length: int, depth: int) -> DataFrame:
    """``pos, rank`` for each ``text(pos, symbol)``; places run from 0 to ``length`` - 1, symbols are above 0.

    Suffixes are told apart by their first ``depth`` symbols at least; equal ones come in any order. What lies
    beyond the end counts as 0.
    """
    if length < 3:
        # too short for a sample of its own
        whole = text.select("pos", "symbol")
        after = whole.select((F.col("pos") - 1).alias("pos"), F.col("symbol").alias("next"))
        keyed = whole.join(after, "pos", "left").withColumn("next", F.coalesce("next", F.lit(0)))
        return placed(keyed, ["symbol", "next"], ["pos"], ["pos"]).select("pos", F.col("place").alias("rank"))

    blocks = text.groupBy(F.expr("pos div 3").alias("b")).agg(
        *[F.max(F.when(F.col("pos") % 3 == i, F.col("symbol"))).alias(f"c{i}") for i in range(3)]
    )
    following = blocks.select((F.col("b") - 1).alias("b"), F.col("c0").alias("c3"), F.col("c1").alias("c4"))
    blocks = written(blocks.join(following, "b", "left").fillna(0, ["c1", "c2", "c3", "c4"]), "blocks")
    # the last triple of the first kind reaches beyond the end, so no suffix of names runs on into the second kind;
    # unless one does anyway, it is the empty suffix, which comes before all others
    ones = length // 3 + 1
    empty = 0 if length % 3 == 2 else 1
    edge = text.sparkSession.range(ones - 1, ones).select(F.col("id").alias("b"))
    first = blocks.select("b", F.col("c1").alias("x"), F.col("c2").alias("y"), F.col("c3").alias("z"))
    missing = edge.join(first, "b", "left_anti").select("b", *[F.lit(0).cast("long").alias(n) for n in "xyz"])
    twos = blocks.filter(F.col("b") * 3 + 2 < length)
    triples = (
        first.union(missing).filter(F.col("b") < ones).select("b", "x", "y", "z", F.col("b").alias("at"))
        .union(twos.select("b", F.col("c2"), F.col("c3"), F.col("c4"), (F.col("b") + ones).alias("at")))
    )
    named = written(placed(triples, ["x", "y", "z"], ["at"], ["at"]), "names")
    sampled = named.agg(F.count("*").alias("n"), F.max("name").alias("names")).first()
    if sampled["names"] == sampled["n"] or depth <= 3:
        sample = named.select("at", F.col("place").alias("rank"))
    else:
        sample = ranks(named.select(F.col("at").alias("pos"), F.col("name").alias("symbol")), sampled["n"], -(-depth // 3))
        sample = sample.select(F.col("pos").alias("at"), "rank")
    # ranks from 1; 0 is the empty suffix
    sample = sample.select("at", (F.col("rank") + 1).alias("rank"))
    r1 = sample.filter(F.col("at") < ones).select(F.col("at").alias("b"), F.col("rank").alias("r1"))
    r2 = sample.filter(F.col("at") >= ones).select((F.col("at") - ones).alias("b"), F.col("rank").alias("r2"))
    r4 = r1.select((F.col("b") - 1).alias("b"), F.col("r1").alias("r4"))
    full = blocks.join(r1, "b", "left").join(r2, "b", "left").join(r4, "b", "left").fillna(0, ["r1", "r2", "r4"])
    full = written(full, "ranked")

    pos = F.col("b") * 3
    zero = full.select(pos.alias("pos"), F.lit(True).alias("zero"), F.col("c0").alias("k1"), F.col("r1").alias("k2"), F.lit(0).cast("long").alias("own"))
    one = full.filter(pos + 1 < length).select((pos + 1).alias("pos"), F.lit(False), F.col("c1"), F.col("r2"), F.col("r1"))
    by_one = placed(zero.union(one), ["k1", "k2"], ["zero", "pos"], ["pos", "zero", "own"], "zero")
    zero2 = full.select(pos.alias("pos"), F.lit(True).alias("zero"), F.col("c0").alias("k1"), F.col("c1").alias("k2"), F.col("r2").alias("k3"), F.lit(0).cast("long").alias("own"))
    two = full.filter(pos + 2 < length).select((pos + 2).alias("pos"), F.lit(False), F.col("c2"), F.col("c3"), F.col("r4"), F.col("r2"))
    by_two = placed(zero2.union(two), ["k1", "k2", "k3"], ["zero", "pos"], ["pos", "zero", "own"], "zero")
    # a sampled suffix follows the sampled ones before it and the others; one that is not sampled follows
    # those of its own kind, counted once, and the sampled ones of both kinds
    of_zero = by_one.filter("zero").select("pos", F.col("place").alias("p")).join(
        by_two.filter("zero").select("pos", (F.col("place") - F.col("marked")).alias("q")), "pos"
    ).select("pos", (F.col("p") + F.col("q")).alias("rank"))
    of_sample = by_one.filter("not zero").union(by_two.filter("not zero")).select("pos", (F.col("own") - 1 - empty + F.col("marked")).alias("rank"))
    return of_zero.union(of_sample)
