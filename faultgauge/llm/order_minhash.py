"""Near-duplicate classes by order MinHash and banded alignment.

A sketch draws the two labelled k-mers (five words and the number of their occurrence in the text) that a hash
makes least, and keeps them in the order in which they stand: two texts agree on it with a probability that
follows their edit similarity, as k-mers in another order do not count. Texts that share a sketch are first
compared with one member of their bucket (and with one of a narrower bucket, of two sketches), which settles most
classes. Then all pairs of a bucket that are of different classes meet, at first by the counts of their words, and
those that these do not rule out are aligned, until any two texts that share a sketch are of one class or were
compared. A pair counts if an alignment of its words, computed in a band or, where that does not decide, by bits,
needs edits for at most a fifth of the longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultgauge.llm.common import bounded_batches, slices, written
from faultgauge.llm.components import components

WORDS = 5  # in a k-mer
SKETCHES = 32
SIMILARITY = 0.8
BASE = np.uint64(0x100000001B3)
BAND = 8  # diagonals on both sides in which an alignment is sought first
CELLS = 1 << 21  # of an alignment table in memory at a time
AT_ONCE = 1 << 15  # k-mers times seeds hashed at a time

BAG = 128  # counts of words by their hash
BLOCK = 2048  # members of a bucket that meet at a time
TILE_PAIRS, TILE_TEXTS = 8192, 512  # about so many pairs are aligned in one place, between two sets of so many texts
TRIED = 512  # pairs aligned before it is seen which others they connect

SIGNATURE = pa.schema([("node", pa.int64()), ("words", pa.int64()), ("sketches", pa.list_(pa.int64())), ("bag", pa.binary())])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-case text, without a loop over words."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    solid = data > 32
    if not solid.any():
        return np.empty(0, np.uint64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    starts, ends = edges[::2], edges[1::2]
    # a polynomial over each word's bytes
    since = np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    place = np.arange(len(data)) - since
    powers = POWERS if place.max() < len(POWERS) else np.cumprod(np.full(int(place.max()) + 1, BASE))
    terms = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * powers[place], np.uint64(0))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
    return mix(sums[ends] - sums[starts])


POWERS = np.cumprod(np.full(1 << 12, BASE))
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketches(words: np.ndarray, seeds: np.ndarray = SEEDS) -> np.ndarray:
    """One 64-bit value for each seed; none for a text without words."""
    if not len(words):
        return np.empty(0, np.int64)
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    kmers = np.zeros(n, np.uint64)
    for i in range(k):
        kmers = kmers * BASE + mix(words[i : i + n] + np.uint64(i))
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not new.all():
        # further occurrences get another hash; the first one keeps its own
        place = np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
        kmers = kmers + mix(label)
    first, second = np.empty(len(seeds), np.int64), np.empty(len(seeds), np.int64)
    # several seeds at a time, as many as the text leaves room for
    step = max(1, AT_ONCE // n)
    for start in range(0, len(seeds), step):
        some = slice(start, min(start + step, len(seeds)))
        h = (kmers[None, :] ^ seeds[some, None]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        least = h.argmin(axis=1)
        first[some] = least
        h[np.arange(len(least)), least] = np.uint64(2**64 - 1)
        second[some] = h.argmin(axis=1)
    # in the order of the text
    one, other = kmers[np.minimum(first, second)], kmers[np.maximum(first, second)]
    return mix(one * np.uint64(0xE7037ED1A0B428DB) + other).view(np.int64)


def bag(words: np.ndarray) -> bytes:
    """Counts of words by hash, two bytes each; nothing for a text that has more of a kind than those hold."""
    counts = np.bincount((words % np.uint64(BAG)).astype(np.int64), minlength=BAG)
    return counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else b""


def counted(bags: list[bytes]) -> np.ndarray:
    """A row of counts for each bag, which is not empty."""
    return np.frombuffer(b"".join(bags), "<u2").reshape(-1, BAG)


def enough_shared(x: np.ndarray, y: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Whether rows of counts share so many words that the others, which need an edit each, are at most the edits allowed."""
    return longest - np.minimum(x, y).sum(1, dtype=np.int64) <= np.floor(longest * (1 - SIMILARITY) + 1e-9)


def may_align(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """False only for pairs of bags whose texts cannot align: words that one text lacks need an edit each."""
    out = np.ones(len(a), bool)
    known = np.flatnonzero([bool(x and y) for x, y in zip(a, b)])
    if len(known):
        x, y = (counted([side[i] for i in known]) for side in (a, b))
        out[known] = enough_shared(x, y, np.maximum(x.sum(1, dtype=np.int64), y.sum(1, dtype=np.int64)))
    return out


def unlike_pairs(node: np.ndarray, words: np.ndarray, component: np.ndarray, side: np.ndarray, bags: list[bytes]) -> np.ndarray:
    """Pairs of nodes, ``a < b`` in each row, of different components whose lengths and bags allow an alignment.

    Rows come in the order of ``words``. Two of them meet unless both are of side 0, or both of side 1.
    """
    known = np.array([bool(b) for b in bags])
    counts = counted([b or bytes(2 * BAG) for b in bags])
    shortest = np.searchsorted(words, (SIMILARITY - 1e-9) * words)
    found = [np.empty((0, 2), np.int64)]
    for j, start in enumerate(shortest):
        # the row with its predecessors, none of which is longer
        meet = component[start:j] != component[j]
        if side[j] != 2:
            meet &= side[start:j] != side[j]
        others = start + np.flatnonzero(meet)
        if len(others):
            fine = ~known[others] | ~known[j] | enough_shared(counts[others], counts[j], words[j])
            others = others[fine]
            found.append(np.stack([np.minimum(node[others], node[j]), np.maximum(node[others], node[j])], axis=1))
    return np.concatenate(found)


def _edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Word edits of the best alignment of each pair that keeps within ``band`` diagonals; the least of all if no more than ``band``."""
    count, width = len(pairs), 2 * band + 1
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, far = int(n.max()), np.int32(1 << 28)
    left = np.zeros((count, rows), np.uint64)
    right = np.zeros((count, rows + width + 1), np.uint64)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        right[i, band : band + min(len(b), rows + band)] = b[: rows + band]
    shift = np.arange(width, dtype=np.int32)
    # cell (i, d) compares the first i words of one text with the first i + d - band of the other
    column = shift - band
    line = np.where(column >= 0, column, far)[None, :].repeat(count, 0).astype(np.int32)
    result = np.full(count, far, np.int64)
    result[n == 0] = m[n == 0]
    for i in range(1, rows + 1):
        unequal = right[:, i - 1 : i - 1 + width] != left[:, i - 1 : i]
        best = line + unequal
        best[:, :-1] = np.minimum(best[:, :-1], line[:, 1:] + 1)
        j = i + column
        best = np.where((j >= 0)[None, :] & (j[None, :] <= m[:, None]), best, far)
        if 0 <= band - i:
            best[:, band - i] = i
        line = np.minimum.accumulate(best - shift, axis=1) + shift
        line = np.where((j >= 0)[None, :] & (j[None, :] <= m[:, None]), line, far)
        ended = np.flatnonzero(n == i)
        if len(ended):
            at = m[ended] - i + band
            inside = (at >= 0) & (at < width)
            result[ended[inside]] = line[ended[inside], at[inside]]
    return result


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edits of the best alignment, or more than ``most`` if there are more.

    A column of the alignment table is two long integers: where it rises and where it falls, a bit for each word.
    """
    if len(a) < len(b):
        a, b = b, a
    where: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    last, every = 1 << len(a) >> 1, (1 << len(a)) - 1
    rises, falls, result, left = every, 0, len(a), len(b)
    for word in b.tolist():
        equal = where.get(word, 0) | falls
        same = (((equal & rises) + rises) ^ rises) | equal
        up, down = falls | (every & ~(rises | same)), rises & same
        if up & last:
            result += 1
        elif down & last:
            result -= 1
        left -= 1
        if result - left > most:
            break
        up = up << 1 | 1
        falls, rises = up & same & every, (down << 1 | ~(up | same)) & every
    return result


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether the words of each pair align with edits of at most ``1 - similarity`` of the longer text."""
    longest = np.array([max(len(a), len(b)) for a, b in pairs])
    allowed = np.floor(longest * (1 - similarity) + 1e-9).astype(np.int64)
    # an alignment that goes further from the diagonal needs more edits to get there and to its end
    widest = (allowed + np.array([abs(len(a) - len(b)) for a, b in pairs], np.int64)) // 2
    out = np.zeros(len(pairs), bool)
    open_ = []
    for i, (a, b) in enumerate(pairs):
        # words that one text lacks need an edit each
        values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        both = np.minimum(np.bincount(where[: len(a)], minlength=len(values)), np.bincount(where[len(a) :], minlength=len(values)))
        if longest[i] - both.sum() <= allowed[i]:
            open_.append(i)
    # an alignment in a narrow band is enough to accept; rejecting takes a band that the edits allowed cannot leave, or all of the table
    open_.sort(key=lambda i: len(pairs[i][0]))
    start = 0
    while start < len(open_):
        stop, longest_in = start, 0
        while stop < len(open_):
            longest_in = max(longest_in, len(pairs[open_[stop]][0]))
            if stop > start and (stop + 1 - start) * (2 * BAND + longest_in) * 4 > CELLS:
                break
            stop += 1
        chosen = open_[start:stop]
        for i, d in zip(chosen, _edit_distances([pairs[i] for i in chosen], BAND)):
            out[i] = d <= allowed[i] or (BAND < widest[i] and edits(*pairs[i], int(allowed[i])) <= allowed[i])
        start = stop
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """``node, words, sketches, bag`` of every row with a text; ``node`` is the hash of the text that ``docs`` brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [(len(w), sketches(w), bag(w)) for w in map(word_hashes, part.column(1).to_pylist())]
            columns = [pa.array([r[i] for r in rows], SIGNATURE.types[i + 1]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=SIGNATURE)

    return docs.select("node", "text").mapInArrow(run, "node long, words long, sketches array<long>, bag binary")


def near(a: str, b: str) -> Column:
    """Two texts whose lengths allow an alignment."""
    return (F.col(f"{a}.node") != F.col(f"{b}.node")) & (
        F.least(f"{a}.words", f"{b}.words") >= F.lit(SIMILARITY - 1e-9) * F.greatest(f"{a}.words", f"{b}.words")
    )


def candidates(found: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of nodes to compare: each member of a bucket with the least of it and of its narrower one."""
    each = found.select("node", "words", F.posexplode("sketches").alias("i", "wide"), "sketches")
    # the narrower bucket also asks for the following sketch
    each = each.select(
        "node", "words", F.xxhash64("i", "wide").alias("wide"),
        F.xxhash64("i", "wide", F.element_at("sketches", (F.col("i") + 1) % F.size("sketches") + 1)).alias("narrow"),
    )
    narrow = each.groupBy("wide", "narrow").agg(F.min(F.struct("node", "words")).alias("head"), F.count("*").alias("n"))
    wide = narrow.groupBy("wide").agg(F.min("head").alias("top"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    heads = narrow.join(wide, "wide").select("narrow", "head", "top", "n")

    tops = heads.filter(near("head", "top")).select(F.col("head.node").alias("x"), F.col("top.node").alias("y"))
    member = each.select("narrow", F.struct("node", "words").alias("own"))
    inner = (
        member.join(heads.filter("n > 1").select("narrow", "head", "top"), "narrow")
        .select("own", F.explode(F.array("head", "top")).alias("other"))
        .filter(near("own", "other"))
        .select(F.col("own.node").alias("x"), F.col("other.node").alias("y"))
    )
    return tops.union(inner).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts align. Texts come from ``docs(doc_id, node, text)``; ``nodes`` names the one to read."""
    named = pairs.withColumn("pair", F.xxhash64("a", "b"))
    asked = named.select(F.col("a").alias("node"), "pair", "a", "b").union(named.select("b", "pair", "a", "b"))
    # a text that many pairs ask for is joined in pieces; every text is shuffled once, and once for each pair
    asked = asked.join(nodes.select("node", "doc_id"), "node")
    sides = docs.join(asked, ["doc_id", "node"]).select("pair", "a", "b", "node", "text")
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: tuple | None = None
        waiting: list[tuple] = []

        def settle() -> pa.RecordBatch:
            good = similar([(x, y) for _, _, x, y in waiting]) if waiting else []
            kept = [(a, b) for (a, b, _, _), fine in zip(waiting, good) if fine]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], schema=kind)

        size = 0
        for part in slices(batches, "text", 2 << 20):
            for pair, a, b, node, text in zip(*[c.to_pylist() for c in part.columns]):
                words = word_hashes(text)
                if held and held[:2] == (a, b) and held[2] != node:
                    waiting.append((a, b, held[3], words))
                    size += len(words) + len(held[3])
                    held = None
                    if size > 1 << 20:
                        yield settle()
                        size = 0
                else:
                    held = (a, b, node, words)
        yield settle()

    met = sides.repartition(parts, "pair").sortWithinPartitions("a", "b", "node")
    return met.mapInArrow(run, "a long, b long")


def cells(members: DataFrame) -> DataFrame:
    """``cell, side, node, component`` of ``members(bucket, n, node, component)``: any two unlike members of a bucket meet in one cell.

    A bucket is a cell of its own, one of more than ``BLOCK`` members is dealt into blocks, every two of which are a
    cell, and so is every block with itself. A component of more than ``BLOCK`` members has blocks of its own, which
    do not meet each other. ``side`` tells the two blocks of a cell apart; it is 2 where all of a cell are to meet.
    """
    plain = members.filter(F.col("n") <= BLOCK).select(F.xxhash64("bucket").alias("cell"), F.lit(2).alias("side"), "node", "component")
    large = members.filter(F.col("n") > BLOCK)
    sizes = large.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    parts = sizes.groupBy("bucket", F.when(F.col("n") > BLOCK, F.col("component")).alias("of")).agg(F.ceil(F.sum("n") / BLOCK).alias("n"))
    parts = parts.select("bucket", "of", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    blocks = parts.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("of", "part"))).alias("blocks"))

    def places(wanted) -> Column:
        at = F.transform("blocks", lambda block, i: F.when(wanted(block["of"]), i))
        return F.filter(at, lambda i: i.isNotNull())

    own = F.when(F.coalesce(F.exists("blocks", lambda block: block["of"] == F.col("component")), F.lit(False)), F.col("component"))
    dealt = large.join(blocks, "bucket").withColumn("of", own)
    mine = places(lambda of: of.eqNullSafe(F.col("of")))
    dealt = dealt.withColumn("mine", mine).withColumn("mine", F.get("mine", F.pmod(F.xxhash64("node"), F.size("mine")).cast("int")))
    others = places(lambda of: ~F.coalesce(of == F.col("of"), F.lit(False)))
    dealt = dealt.select("bucket", "node", "component", "mine", F.explode(others).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    cell = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    return plain.union(dealt.select(cell, side, "node", "component"))


def unlike(found: DataFrame, class_of: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of texts that share a sketch, are of different components and may align by their lengths and bags.

    ``x`` and ``y`` are their components, ``cell`` is one of the cells in which they met.
    """
    own = found.join(class_of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = own.select("node", "component", F.posexplode("sketches").alias("i", "wide"))
    each = each.select("node", "component", F.xxhash64("i", "wide").alias("bucket"))
    of_several = each.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
    members = written(each.join(of_several.filter("least <> most").select("bucket", "n"), "bucket"), "members")
    met = cells(members).join(found.select("node", "words", "bag"), "node").select("cell", "side", "node", "words", "component", "bag")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[np.ndarray] = []

        def settle() -> None:
            rows = pa.Table.from_batches(held)
            side, node, words, component = (rows.column(c).to_numpy() for c in ("side", "node", "words", "component"))
            pairs = unlike_pairs(node, words, component, side, rows.column("bag").to_pylist())
            out.append(np.column_stack([pairs, np.full(len(pairs), rows.column("cell")[0].as_py())]))
            held.clear()

        def some() -> pa.RecordBatch:
            pairs = np.concatenate([np.empty((0, 3), np.int64), *out])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], schema=kind)

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for start, stop in zip(cuts, cuts[1:]):
                if held and held[0].column("cell")[0].as_py() != cell[start]:
                    settle()
                    if sum(map(len, out)) > AT_ONCE:
                        yield some()
                if stop > start:
                    held.append(batch.slice(start, stop - start))
        if held:
            settle()
        yield some()

    pairs = met.repartition(parts, "cell").sortWithinPartitions("cell", "words").mapInArrow(run, "a long, b long, cell long")
    pairs = pairs.groupBy("a", "b").agg(F.min("cell").alias("cell"))
    of = pairs.join(class_of.toDF("a", "x"), "a", "left").join(class_of.toDF("b", "y"), "b", "left")
    return of.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "cell")


def connecting(words: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs ``a, b`` that align and connect all the components ``x, y`` that aligned pairs connect; others are left out."""
    there = np.array([i in words and j in words for i, j in zip(a.tolist(), b.tolist())], bool)
    a, b, x, y = (side[there] for side in (a, b, x, y))
    values, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    root, links = np.arange(len(values)), []
    while True:
        apart = root[x] != root[y]
        a, b, x, y = (side[apart] for side in (a, b, x, y))
        if not len(a):
            return links
        u, v = root[x], root[y]
        # one pair of the same two components at a time
        tried = np.unique(np.minimum(u, v) * len(root) + np.maximum(u, v), return_index=True)[1][:TRIED]
        for i in tried[similar([(words[p], words[q]) for p, q in zip(a[tried].tolist(), b[tried].tolist())])]:
            if root[x[i]] != root[y[i]]:
                links.append((int(a[i]), int(b[i])))
                root[root == root[y[i]]] = root[x[i]]
        a, b, x, y = (np.delete(side, tried) for side in (a, b, x, y))


def aligned(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of ``pairs(a, b, x, y, cell)`` that align, as many as connect the components ``x, y`` that such pairs connect.

    The pairs of a cell are dealt into tiles, to each of which every text of it goes once, however many pairs ask for it.
    """
    sizes = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).groupBy("cell").agg(
        (F.count("*") / 2).alias("n"), F.count_distinct("node").alias("texts")
    )
    parts = F.ceil(F.greatest(F.sqrt(F.col("n") / TILE_PAIRS), F.col("texts") / TILE_TEXTS)).alias("parts")
    p, q = (F.pmod(F.xxhash64(side), F.col("parts")) for side in ("a", "b"))
    tile = F.xxhash64("cell", F.least(p, q), F.greatest(p, q)).alias("tile")
    tiles = written(pairs.join(sizes.select("cell", parts), "cell").select(tile, "a", "b", "x", "y"), "tiles")
    asked = tiles.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node")
    # where few are asked for, no other text is shuffled
    sides = docs.join(written(asked, "asked"), ["doc_id", "node"])
    nothing = F.lit(0).cast("long")
    rows = sides.select("tile", F.lit(False).alias("pair"), F.col("node").alias("a"), nothing.alias("b"), nothing.alias("x"), nothing.alias("y"), "text")
    rows = rows.union(tiles.select("tile", F.lit(True), "a", "b", "x", "y", F.lit("")))
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        words: dict[int, np.ndarray] = {}
        asked: list[tuple] = []
        of = None

        def settle() -> pa.RecordBatch:
            links = connecting(words, *np.array(asked, np.int64).reshape(-1, 4).T)
            words.clear()
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], schema=kind)

        for part in slices(batches, "text", 2 << 20):
            for tile, pair, a, b, x, y, text in zip(*[c.to_pylist() for c in part.columns]):
                if tile != of:
                    yield settle()
                    of = tile
                if pair:
                    asked.append((a, b, x, y))
                elif a not in words:
                    words[a] = word_hashes(text)
        yield settle()

    return rows.repartition(tasks, "tile").sortWithinPartitions("tile", "pair").mapInArrow(run, "a long, b long")


def linked(found: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component`` of the texts that have links.

    The first comparisons, a few for each text, settle most components. Of the pairs of a bucket that are left, which are of
    different components, all that may align are aligned. Any two texts of a bucket end in one component or were compared.
    """
    pairs = written(candidates(found), "pairs")
    links = written(verified(pairs, texts, nodes), "near")
    class_of = written(components(links), "classes")
    left = written(unlike(found, class_of).join(pairs, ["a", "b"], "left_anti"), "alike")
    if left.isEmpty():
        return class_of
    more = written(aligned(left, texts, nodes), "near")
    return class_of if more.isEmpty() else written(components(class_of.toDF("a", "b").union(more)), "classes")


def grouped(docs: DataFrame, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, text, node`` of ``docs``, and for each distinct text (``node``) its least id, number of rows and component.

    ``exact`` is there for callers that name it: all texts that share a sketch are compared in any case.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    # copies count as one text; the one with the least id is read
    nodes = written(texts.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "nodes")
    found = signatures(texts).groupBy("node").agg(*[F.first(c).alias(c) for c in ("words", "sketches", "bag")])
    named = nodes.join(linked(written(found, "signatures"), texts, nodes), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return texts, named


def classes(docs: DataFrame, exact: bool = True) -> DataFrame:
    """``doc_id, class_id, n_class`` of every row of ``docs(doc_id, text)``: near copies are of one class.

    ``class_id`` is the least ``doc_id`` of the class, ``n_class`` the number of its rows. Equal texts are always
    of one class, whatever their length, null and empty ones being equal; of the others, those that chains of
    similar pairs connect, any two that share a sketch being compared unless a chain connects them. A text of fewer than five words is a k-mer of its own. Rows without an id belong to
    the class of their text; if no row of that text has an id, it is compared with no other text and the class
    has none either. An empty table gives no rows.
    """
    texts, named = grouped(docs, exact)
    sums = named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_class"))
    class_of = named.select("node", "component").join(sums, "component").select("node", "class_id", "n_class")
    return texts.select("doc_id", "node").join(class_of, "node").select("doc_id", "class_id", "n_class")


def deduplicated(docs: DataFrame, exact: bool = True) -> DataFrame:
    """One row of each class, that with the least id (then the least hash of the text), with all columns as they are."""
    _, named = grouped(docs, exact)
    # a row without an id stays only where no row of its class has one
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best")
    chosen = named.groupBy("component").agg(best).select(F.col("best.doc_id").alias("_id"), F.col("best.node").alias("_node"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.col("doc_id").alias("id"))
    kept = rows.join(chosen, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["node", "id"]).select("row.*")
