"""WARC archives written and read by tasks, and one globally ordered index of their captures.

Each task writes archives of bounded size into the shared folder; a small table lists those of the attempts
that counted, so a repeated task leaves at most an unlisted file. Reading an archive back gives a run of
index entries, sorted by URL key and time. Entries are dealt by ranges of (URL key, time, id, place), which
splits even a single hot URL, and in each range a loser tree merges the slices of all runs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from faultgauge.llm.common import bounded_batches, slices, written
from faultgauge.session import new_path

UNSAFE = re.compile(r"[\x00-\x20\x7f]")  # not allowed in a header line's address
ARCHIVE_BYTES = 64 << 20  # a task opens a new archive beyond so many bytes of payload
ENTRY = (
    "url_key string, captured timestamp, page_id long, archive string, offset long, url string, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)
ORDER = ("url_key", "captured", "page_id", "archive", "offset")
ENTRY_ARROW = pa.schema([
    ("url_key", pa.string()), ("captured", pa.timestamp("us", "UTC")), ("page_id", pa.int64()), ("archive", pa.string()),
    ("offset", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()),
])
LISTED_ARROW = pa.schema([("archive", pa.string()), ("records", pa.int64())])


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system of the cluster and the path in it; a bare path or ``file:`` is a shared mount."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query: captures of one site lie together in the index."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    host = host.removeprefix("www.")
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){parts.path or '/'}{query}".lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, captured: datetime, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; of a revisit only the HTTP header is kept, which still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {captured.astimezone(timezone.utc):%Y-%m-%dT%H:%M:%S.%fZ}",
        f"WARC-Target-URI: {UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[3:3] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A gzip member of its own, so that a reader can start at any record."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html, captured, first)``; lists ``archive, records``.

    ``first`` is the least id with this payload; a row whose own id differs from it becomes a revisit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        sink, name, held, count, made = None, "", 0, 0, []
        for part in slices(batches, "html"):
            columns = [part.column(n).to_pylist() for n in ("page_id", "url", "html", "captured", "first")]
            for page_id, url, html, captured, first in zip(*columns):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, held, count = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                payload = html.encode()
                sink.write(packed(record(page_id, url, captured, payload, first, page_id != first)))
                held, count = held + len(payload), count + 1
                if held >= archive_bytes:
                    sink.close()
                    made.append((name, count))
                    sink = None
        if sink is not None:
            sink.close()
            made.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(LISTED_ARROW)], schema=LISTED_ARROW)

    return pages.mapInArrow(run, "archive string, records long")


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, with one member in memory at a time."""
    rest, base = b"", 0
    inflate, out, start = zlib.decompressobj(31), [], 0
    while chunk := rest or stream.read(1 << 20):
        out.append(inflate.decompress(chunk))
        if inflate.eof:
            yield start, b"".join(out)
            rest = inflate.unused_data
            base += len(chunk) - len(rest)
            inflate, out, start = zlib.decompressobj(31), [], base
        else:
            base += len(chunk)
            rest = b""


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def page_number(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def entry(archive: str, offset: int, data: bytes) -> tuple:
    """Index entry of a record; a payload that does not fit its digest is an error."""
    fields, block = parse(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"damaged record in {archive} at {offset}")
    url = fields["WARC-Target-URI"]
    captured = datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc)
    refers = page_number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return (url_key(url), captured, page_number(fields["WARC-Record-ID"]), archive, offset, url, size, named, fields["WARC-Type"], refers)


def sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def read_archives(listed: DataFrame, folder: str) -> DataFrame:
    """Index entries of the listed archives; those of one archive are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    entries = sorted((entry(archive, at, data) for at, data in members(stream)), key=sort_key)
                if len(entries) != records:
                    raise ValueError(f"{archive} holds {len(entries)} records of {records}")
                yield rows_to_batch(entries)

    return listed.mapInArrow(run, ENTRY)


def rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(ENTRY_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTRY_ARROW)], schema=ENTRY_ARROW)


def merge(runs: list[list[tuple]], key=sort_key) -> Iterator[tuple]:
    """K-way merge of sorted runs. An inner node keeps the run that lost there; the winner replays only its own path."""
    k = len(runs)
    places = [0] * k
    end = (1,)

    def front(run: int) -> tuple:
        return (0, key(runs[run][places[run]])) if places[run] < len(runs[run]) else end

    if not k:
        return
    keys = [front(run) for run in range(k)]
    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while keys[best] != end:
        yield runs[best][places[best]]
        places[best] += 1
        keys[best] = front(best)
        node = (best + k) // 2
        while node:
            if keys[losers[node]] < keys[best]:
                losers[node], best = best, losers[node]
            node //= 2


def merge_runs(entries: DataFrame) -> DataFrame:
    """All captures in the order of URL key, time, id and place: ranges follow each other, each merged from its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                runs.setdefault(row[3], []).append(row)
        block: list[tuple] = []
        for row in merge(list(runs.values())):
            block.append(row)
            if len(block) == 10_000:
                yield rows_to_batch(block)
                block = []
        yield rows_to_batch(block)

    pieces = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartitionByRange(pieces, *ORDER).sortWithinPartitions("archive", *ORDER)
    return dealt.mapInArrow(run, ENTRY)


def capture_index(pages: DataFrame, captured: str = "captured", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all of ``pages(page_id, url, html, <captured>)`` to archives, read them back, merge their index.

    One row per page, with ``page_id, url, url_key, captured, archive, offset, payload_bytes, payload_digest,
    record_type, refers_to``. Of equal payloads that with the least ``page_id`` is the response, the others
    are revisits of it. A null html is an empty payload (empty ones are equal too), a null url an empty one
    with key ``)/``; rows that repeat both id and payload are all of the same type; a row without an id
    is a revisit if any row with an id has its payload. White space and control characters of a url are kept as %XX. An empty table gives no rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = new_path(spark, "archives")
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.col(captured).alias("captured"),
        F.sha1(F.coalesce("html", F.lit(""))).alias("payload"),
    )
    # one row for each distinct payload; a hot one is summed up before the shuffle and split by the skew join
    least = rows.groupBy("payload").agg(F.min("page_id").alias("first"))
    listed = written(write_archives(rows.join(least, "payload", "left").drop("payload"), folder, archive_bytes), "archive-list")
    spread = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")
    # written: the sampling of ranges must not read the archives a second time
    return merge_runs(written(read_archives(spread, folder), "archive-index"))
