"""Remove every byte that a repeated string of ``length`` bytes covers.

Of each window of ``length`` bytes, the place of the least hash among its first grams is its anchor: equal
windows have equal anchors at equal offsets. So each text has an anchor about every hundred bytes, and all
windows of one anchor share the ``inner`` bytes after it.

1. Inner strings that occur once in the corpus rule out all windows of their anchor. Anchors whose windows'
   whole surroundings occur twice rule them all in, and count as one from there on.
2. Of what is left, the texts at and after anchors become one string of symbols (ranks of inner strings), whose
   suffixes the difference-cover algorithm sorts. Anchors next to each other are compared byte by byte; the
   neighbours in this order have the longest common continuation that any other place has. Suffixes are told
   apart by ``DEPTH`` symbols; the windows of an anchor that reach over more (dense anchors) go to step 4.
3. The same in the order of what stands before the anchor. A window is repeated if one neighbour agrees on both
   sides; it is not if no neighbour agrees far enough on one side.
4. The few windows that this leaves open (both ends near a difference, or dense) are compared by their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from faultgauge.llm.common import bounded_batches, forget, slices, written
from faultgauge.llm.difference_cover import ranks
from faultgauge.llm.ordering import placed

LENGTH = 400
GRAM = 16  # bytes that an anchor's hash looks at
DEPTH = 9  # symbols that tell suffixes apart; ordinary windows reach over two to six anchors

ANCHOR = pa.schema([("node", pa.int64()), ("f", pa.int64()), ("u", pa.int64()), ("spot", pa.int64())])


class Shape:
    """Lengths that follow from that of a repeated string."""

    def __init__(self, length: int):
        if length < 4 * GRAM:
            raise ValueError(f"repeated strings must have {4 * GRAM} bytes or more")
        self.length = length
        self.window = (length + 1 - GRAM) // 2  # places that an anchor is the least of
        self.inner = length - self.window + 1  # bytes after an anchor that all its windows share


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def anchors(data: bytes, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all anchors in a text, and the first and last start of a window that each is the anchor of.

    Starts are taken as far as their first grams reach, so the last anchors may have no whole window. Which
    anchor follows one depends on its inner string alone.
    """
    starts = len(data) - GRAM + 1 - shape.window + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    words = mix(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64))
    grams = mix(words[:-8] + words[8:] * np.uint64(3))
    # hash above, place below: the least is the leftmost of equal hashes
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= shape.window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < shape.window:
        least = np.minimum(least[: -(shape.window - width)], least[shape.window - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], starts) - 1


def spot(column: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(column, 32), F.shiftright(column, 16).bitwiseAND(0xFFFF), column.bitwiseAND(0xFFFF)


def signed(digest: int) -> int:
    return digest - 2**64 if digest >= 2**63 else digest


def scan(docs: DataFrame, shape: Shape) -> DataFrame:
    """Anchors that have windows: ``node, f`` (inner string), ``u`` (all bytes of its windows), ``spot`` (place and
    distances, see ``spot``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for part in slices(batches, "data", 4 << 20):
            nodes, spots, fs, us = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], []
            for node, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                end = len(data) - shape.length
                if end < 0:
                    continue
                at, first, last = anchors(data, shape)
                n = int(np.searchsorted(first, end, "right"))
                at, first, last = at[:n], first[:n], np.minimum(last[:n], end)
                # greatest and least distance of the windows' starts before the anchor
                distances = (at - first) << 16 | (at - last)
                fs += [digest(data[s : s + shape.inner]) for s in at.tolist()]
                # the seed tells surroundings apart that begin elsewhere before the anchor
                spans = zip(first.tolist(), (last + shape.length).tolist(), distances.tolist())
                us += [digest(data[a:b], seed) for a, b, seed in spans]
                nodes.append(np.full(n, node, np.int64))
                spots.append(at << 32 | distances)
            columns = [np.concatenate(nodes), *[np.array(x, np.uint64).view(np.int64) for x in (fs, us)], np.concatenate(spots)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=ANCHOR)

    return docs.select("node", "data").mapInArrow(run, "node long, f long, u long, spot long")


CONTEXT = pa.schema([
    ("node", pa.int64()), ("at", pa.int64()), ("spot", pa.int64()), ("f", pa.int64()), ("open", pa.bool_()), ("block", pa.binary()),
    ("left", pa.binary()), ("right", pa.binary()), ("reach", pa.int64()),
])


def contexts(docs: DataFrame, wanted: DataFrame, shape: Shape) -> DataFrame:
    """Rows of the string to sort: each wanted anchor and those after it, as far as a window reaches.

    ``left`` (reversed) and ``right`` are the bytes around the inner string ``block``; only wanted anchors have
    them, and an ``f``. A row with an empty block ends each run. ``reach`` is the number of anchors to the end
    of the farthest window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data", 1 << 20):
            rows = []
            for node, data, asked in zip(*[c.to_pylist() for c in part.columns]):
                of_place = {w["spot"] >> 32: w for w in asked}
                at = anchors(data, shape)[0].tolist()
                far, open_run = -1, False
                for i, s in enumerate(at):
                    w = of_place.get(s)
                    reach = 0
                    if w:
                        reach = 1
                        while i + reach < len(at) and at[i + reach - 1] + shape.inner < s + shape.length:
                            reach += 1
                        far = max(far, i + reach - 1)
                    if i > far:
                        if open_run:
                            rows.append((node, s, None, None, None, b"", None, None, 0))
                            open_run = False
                        continue
                    open_run = True
                    block = data[s : s + shape.inner]
                    if w:
                        left = data[max(0, s - shape.window + 1) : s][::-1]
                        right = data[s + shape.inner : s + shape.length]
                        rows.append((node, s, w["spot"], w["f"], w["open"], block, left, right, reach))
                    else:
                        rows.append((node, s, None, None, None, block, None, None, 0))
                if open_run:
                    rows.append((node, len(data), None, None, None, b"", None, None, 0))
            columns = list(zip(*rows)) or [[]] * len(CONTEXT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CONTEXT)], schema=CONTEXT)

    schema = "node long, at long, spot long, f long, open boolean, block binary, left binary, right binary, reach long"
    asked = wanted.groupBy("node").agg(F.collect_list(F.struct("spot", "f", "open")).alias("asked"))
    # copies of a text are read once
    return docs.select("node", "data").dropDuplicates(["node"]).join(asked, "node").mapInArrow(run, schema)


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


SIDES = ["id", "f", "left", "right"]
NEIGHBOUR = pa.schema([
    ("id", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("part", pa.int32()), ("f", pa.int64()), ("left", pa.binary()), ("right", pa.binary()),
])


def neighbours(rows: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """``id, l, r``: for each of ``rows(id, f, left, right)`` and its neighbours of the same ``f`` in the order of ``keys``, the
    bytes that agree before and after the anchor.

    Ranges are sorted and compared where they are. The first and last row of each also go to the driver, which
    compares those at which two ranges meet.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None  # the row before
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if last is None:
                    out.append((row[0], 0, None, part, *row[1:]))
                elif last[1] == row[1]:
                    l, r = agreement(last, row, shape)
                    out += [(last[0], l, r, None, None, None, None), (row[0], l, r, None, None, None, None)]
                last = row
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(NEIGHBOUR), NEIGHBOUR)], schema=NEIGHBOUR)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((last[0], 1, None, part, *last[1:]), NEIGHBOUR)], schema=NEIGHBOUR)

    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys).select(*SIDES)
    found = written(sorted_.mapInArrow(run, "id long, l int, r int, part int, f long, left binary, right binary"), "neighbours")
    # a range brings its first row (0) and its last one (1), which may be the same
    ends: dict[int, list] = {}
    for r in sorted(found.filter(F.col("part").isNotNull()).drop("r").collect(), key=lambda r: (r["part"], r["l"])):
        ends.setdefault(r["part"], []).append((r["id"], r["f"], r["left"], r["right"]))
    parts = [ends[p] for p in sorted(ends)]
    met = [(a[-1], b[0]) for a, b in zip(parts, parts[1:]) if a[-1][1] == b[0][1]]
    edges = [(x[0], *agreement(a, b, shape)) for a, b in met for x in (a, b)]
    return found.filter(F.col("part").isNull()).select("id", "l", "r").union(spark.createDataFrame(edges, "id long, l int, r int"))


def agreement(a: tuple, b: tuple, shape: Shape) -> tuple[int, int]:
    return common(bytes(a[2]), bytes(b[2])), shape.inner + common(bytes(a[3]), bytes(b[3]))


def decided(length: int) -> tuple[Column, Column]:
    """For a row with ``most, least`` (distances of window starts before the anchor), ``met`` (agreements with
    neighbours) and ``far`` (its windows reach beyond the order): ranges of distances at which windows are
    repeated, and the single ones that stay open.
    """
    met, most, least, far = F.col("met"), F.col("most"), F.col("least"), F.col("far")
    each = F.transform(
        met, lambda m: F.struct(F.greatest(least, length - m["r"]).alias("a"), F.least(most, m["l"]).alias("b"))
    )
    good = F.array_distinct(F.filter(each, lambda x: x["a"] <= x["b"]))
    # no other place agrees with this one for longer than a neighbour does, as far as the order goes
    low = F.when(far, least).otherwise(F.greatest(least, length - F.array_max(F.transform(met, lambda m: m["r"]))))
    high = F.least(most, F.array_max(F.transform(met, lambda m: m["l"])))
    rest = F.when(low <= high, F.filter(F.sequence(low, high), lambda a: ~F.exists(good, lambda x: a.between(x["a"], x["b"]))))
    return good, F.coalesce(rest, F.array().cast("array<int>"))


def windows(rows: DataFrame, shape: Shape) -> DataFrame:
    """``id, distance, window`` (its hash) for every window of the rows' anchors."""
    out = pa.schema([("id", pa.int64()), ("distance", pa.int32()), ("window", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "block", 1 << 18):
            ids, distances, hashes = [], [], []
            for id_, block, left, right, most, least in zip(*[c.to_pylist() for c in part.columns]):
                whole = left[::-1] + block + right
                for a in range(least, min(most, len(left)) + 1):
                    at = len(left) - a
                    content = whole[at : at + shape.length]
                    if len(content) == shape.length:
                        ids.append(id_)
                        distances.append(a)
                        hashes.append(signed(xxhash.xxh3_64_intdigest(content)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, distances, hashes), out)], schema=out)

    return rows.select("id", "block", "left", "right", "most", "least").mapInArrow(run, "id long, distance int, window long")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``node, start, stop`` of stretches that repeated windows cover in ``docs(node, data)``; they may overlap."""
    shape = Shape(length)
    found = written(scan(docs, shape), "scanned")
    twice = found.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f")
    again = written(found.join(twice, "f", "left_semi"), "anchors")
    forget(found)
    kinds = again.groupBy("f", "u").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min_by("spot", "node").alias("spot"))
    kinds = written(kinds, "surroundings")
    place, most, least = spot(F.col("spot"))
    clear = again.join(kinds.filter("n > 1").select("f", "u"), ["f", "u"], "left_semi").select(
        "node", (place - most).alias("start"), (place - least + length).alias("stop")
    )
    # inner strings with several surroundings, some of which occur once
    mixed = kinds.groupBy("f").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("single")).filter("k > 1 and single > 0")
    wanted = kinds.join(mixed.select("f"), "f", "left_semi").select("node", "spot", "f", (F.col("n") == 1).alias("open"))

    string = written(contexts(docs, wanted, shape), "string")
    size = string.agg(F.count("*").alias("n"), F.max("reach").alias("reach")).first()
    if not size["n"]:
        return clear
    keys = ["node", "at"]
    # places in the string follow the texts; symbols follow the bytes of the inner strings
    places = placed(string.select(*keys), keys, [], keys).select(*keys, F.col("place").alias("id"))
    places = written(places, "places")
    symbols = placed(string.select(*keys, "block"), ["block"], keys, keys).select(*keys, F.col("name").alias("symbol"))
    text = written(places.join(symbols, keys).select(F.col("id").alias("pos"), "symbol"), "symbols")
    order = ranks(text, size["n"], min(size["reach"] + 1, DEPTH)).select(F.col("pos").alias("id"), "rank")
    # the rows with bytes are joined once, with what the narrow ones have together
    ids = string.filter(F.col("f").isNotNull()).select(*keys).join(places, keys).join(order, "id")
    asked = string.filter(F.col("f").isNotNull()).withColumn("far", F.col("reach") >= DEPTH).drop("block", "reach").join(ids, keys)
    asked = written(asked.withColumns({"most": most.cast("int"), "least": least.cast("int")}).drop("spot"), "asked")
    forget(text, places)
    onward = neighbours(asked.select(*SIDES, "rank"), ["rank"], shape)
    back = neighbours(asked.select(*SIDES), ["f", "left", "id"], shape)
    met = onward.union(back).groupBy("id").agg(
        F.collect_set(F.struct("l", "r")).alias("met")  # at most four
    )
    good, rest = decided(length)
    open_ = asked.filter("open").select("id", "node", "at", "f", "most", "least", "far").join(met, "id")
    open_ = written(open_.select("id", "node", "at", "f", good.alias("good"), rest.alias("rest")), "open")
    ranges = open_.select("node", "at", F.explode("good").alias("x")).select(
        "node", (F.col("at") - F.col("x.b")).alias("start"), (F.col("at") - F.col("x.a") + length).alias("stop")
    )
    undecided = open_.filter(F.size("rest") > 0)
    doubtful = asked.join(undecided.select("f").distinct(), "f", "left_semi")
    content = windows(doubtful.join(string.select(*keys, "block"), keys), shape)
    content = written(content, "windows")
    same = content.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    single = undecided.select("id", "node", "at", F.explode("rest").alias("distance"))
    hits = single.join(content, ["id", "distance"]).join(same, "window", "left_semi").select(
        "node", (F.col("at") - F.col("distance")).alias("start"), (F.col("at") - F.col("distance") + length).alias("stop")
    )
    spans = written(clear.union(ranges).union(hits), "spans")
    forget(again, kinds, string, asked, open_, content)
    return spans


def cut(data: bytes, starts: list[int], stops: list[int]) -> tuple[bytes, int, int]:
    """What is left of ``data``, the bytes removed, and the number of stretches that they form."""
    kept, removed, spans, end = [], 0, 0, 0
    last = -1
    for a, b in sorted(zip(starts, stops)):
        if a > last:
            kept.append(data[max(end, 0) : a])
            spans += 1
            removed += b - a
            last = end = b
        elif b > last:
            removed += b - last
            last = end = b
    kept.append(data[end:])
    return b"".join(kept), removed, spans


def of_row(text: str) -> Column:
    return F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary")


def with_spans(docs: DataFrame, text: str, length: int) -> DataFrame:
    """``row`` (a struct of all columns) and ``spans`` (what goes of its text; null if nothing does)."""
    bounded_batches(docs.sparkSession)
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    long = docs.select(F.xxhash64(data).alias("node"), data.alias("data")).filter(F.octet_length("data") >= length)
    # a row travels with its text once; the bytes are taken from it afterwards
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(data).alias("node"))
    spans = repeats(long, length).groupBy("node").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return rows.join(spans, "node", "left").select("row", "spans")


def removed(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``docs`` in a struct ``row``, with ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``.

    Texts are judged as UTF-8 bytes and as they come in; what is kept may hold parts of a character. A null
    text is empty. A row that repeats another one's text has all of it removed if it has ``length`` bytes; a
    shorter text loses nothing. An empty table gives no rows. Clashing column names do no harm.
    """
    rows = with_spans(docs, text, length)
    data = of_row(text)

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def cleaned(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [
            (d, 0, 0) if s is None else cut(d, [x["start"] for x in s], [x["stop"] for x in s]) for d, s in zip(data, spans)
        ]
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    result = rows.select("row", F.octet_length(data).cast("long").alias("n_bytes"), cleaned(data, "spans").alias("c"))
    return result.select("row", "n_bytes", "c.kept", "c.n_removed", "c.n_spans")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with what is left of each text, and all other columns as they are but ``n_chars``, which is counted anew.

    Parts of characters at a cut are left out. Rows of whose texts nothing but white space is left go.
    """

    @F.pandas_udf("string")
    def left(data: pd.Series, spans: pd.Series) -> pd.Series:
        out = [
            None if s is None else cut(d, [x["start"] for x in s], [x["stop"] for x in s])[0].decode("utf-8", "ignore")
            for d, s in zip(data, spans)
        ]
        return pd.Series(out, dtype=object)

    # as a filter and a column it would run twice, in workers of their own, were it not called nondeterministic;
    # texts that stay as they are do not go there
    touched = F.col("spans").isNotNull()
    text = left.asNondeterministic()(F.when(touched, of_row("text")), "spans")
    rows = with_spans(docs, "text", length).select("row", touched.alias("touched"), text.alias("left"))
    rows = rows.filter(~F.col("touched") | (F.length(F.trim("left")) > 0))
    rows = rows.select("row", F.when(F.col("touched"), F.col("left")).otherwise(F.col("row.text")).alias("left"))
    new = {"text": F.col("left"), "n_chars": F.length("left").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
