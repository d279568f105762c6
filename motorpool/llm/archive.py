"""Web archives: records written and read back, and one ordered index of all captures.

Records are written by Spark's text writer: a record is its header, an empty line and its block, and the writer's line
separator is the pair of line ends that closes a record. Any file system Spark writes to will do, and lost tasks are
repeated by Spark. Every archive file is read back into one run of index entries, sorted by URL key and time; the runs
are dealt by ranges of that order and each range merges its pieces of the runs with a tree of losers, so that the
histories of all captures come out in one global order.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.llm.common import written

END = "\r\n\r\n"
# Payloads with copies that are broadcast at most: digest and key, 64 MB in all. More are joined by shuffling pages.
BROADCAST_ROWS = 1_000_000
# Records in one archive file at most: bounds what one task reads back at once.
RECORDS_PER_FILE = 2000
ENTRY = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string,"
    " url_key string, captured_at string, archive string, offset long, length long, run long"
)
RUN = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("captured_at", pa.string()),
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.int64()),
    ]
)
ORDER = ("url_key", "captured_at", "page_id")


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32, upper case: four times 40 bits, each as eight digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str) -> str:
    """The url with its host reversed and without scheme, "www.", port and fragment, so that sites sort together."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    names = host.removeprefix("www.").split(".")
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return ",".join(reversed(names)) + ")" + (parts.path.lower() or "/") + (f"?{query}" if query else "")


def records(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html", least_bytes: int = 0
) -> DataFrame:
    """One row per page: the text of its record.

    Of pages with equal payloads of at least ``least_bytes`` the one with the largest key is written whole, the others
    refer to it. Rows that tie for the largest key are all written whole. A null payload is empty, a null key is below
    all others; a page is captured as many seconds after 2024-01-01 as its key says.
    """
    payload = F.coalesce(F.col(page), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        base32_sha1(payload.cast("binary")).alias("digest"),
    )
    large = rows.where(F.col("bytes") >= least_bytes).groupBy("digest")
    heads = large.agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    heads = written(heads.select(F.col("digest").alias("d"), "head"), "heads")
    few = heads.count() <= BROADCAST_ROWS
    known = rows.join(F.broadcast(heads) if few else heads, F.col("digest") == F.col("d"), "left")
    revisit = F.coalesce((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull(), F.lit(False))
    line = "\r\n"
    # A url may hold anything, line ends too: it is written percent-encoded in the header.
    target = F.url_encode(F.col("url"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    seconds = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9))
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{line}WARC-Target-URI: "),
        target,
        F.lit(f"{line}WARC-Date: "),
        when,
        F.lit(f"{line}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Refers-To: <urn:page:"), F.col("head").cast("string"), F.lit(">"))).otherwise(""),
        F.when(revisit, F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return known.select(F.concat(header, block).alias("value"))


def write(pages: DataFrame, path: str, *, records_per_file: int = RECORDS_PER_FILE, **columns: Any) -> None:
    """Write archives into the folder ``path``, at most ``records_per_file`` records to a file."""
    lines = records(pages, **columns).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    lines.text(path)


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse(data: bytes) -> Iterator[dict[str, Any]]:
    """The records of an archive, payload digests checked."""
    end, at = END.encode(), 0
    while at < len(data):
        head = data.index(end, at)
        fields = dict(line.split(": ", 1) for line in data[at:head].decode().split("\r\n")[1:])
        start = head + len(end)
        stop = start + int(fields["Content-Length"])
        block = memoryview(data)[start:stop]
        body = data.index(end, start, stop) + len(end) - start
        http = dict(line.split(": ", 1) for line in bytes(block[: body - len(end)]).decode().split("\r\n")[1:])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        whole = fields["WARC-Type"] == "response"
        if whole and b32encode(hashlib.sha1(block[body:]).digest()).decode() != digest:
            raise ValueError(f"record at {at}: the payload does not have the digest {digest}")
        size = len(block) - body if whole else int(http["Content-Length"])
        if data[stop : stop + len(end)] != end:
            raise ValueError(f"record at {at} does not end where its length says")
        url = unquote(fields["WARC-Target-URI"].replace("+", " "))
        yield {
            "page_id": _page(fields["WARC-Record-ID"]),
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": fields["WARC-Type"],
            "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
            "url": url,
            "url_key": url_key(url),
            "captured_at": fields["WARC-Date"],
            "offset": at,
            "length": stop + len(end) - at,
            "payload": block[body:],
        }
        at = stop + len(end)


def _sort_key(row: tuple) -> tuple:
    page_id = row[2]
    return row[0], row[1], page_id is not None, page_id or 0


class LoserTree:
    """Merges k sorted iterators: each inner node remembers who lost there, so the next winner costs log2(k) matches."""

    def __init__(self, runs: list[Iterable[Any]], key: Callable[[Any], Any]) -> None:
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.heads: list[Any] = [None] * len(runs)
        self.keys: list[Any] = [None] * len(runs)
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [-1] * max(1, len(runs))
        winners = [0] * (2 * len(runs))
        for i in range(len(runs)):
            winners[len(runs) + i] = i
        for node in range(len(runs) - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if len(runs) > 1 else 0

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self) -> Iterator[Any]:
        while self.runs and self.keys[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self._advance(i)
            node = (len(self.runs) + i) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            run = int.from_bytes(hashlib.sha256(path.encode()).digest()[:7], "big")
            entries = [e | {"archive": path, "run": run} for e in parse(content.as_py())]
            entries.sort(key=lambda e: _sort_key((e["url_key"], e["captured_at"], e["page_id"])))
            yield pa.RecordBatch.from_pylist([{n: e[n] for n in RUN.names} for e in entries], schema=RUN)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives in a folder: one sorted run for each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, ENTRY)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: dict[int, list[tuple]] = {}
    names = [*ORDER, *(n for n in RUN.names if n not in ORDER)]
    place = names.index("run")
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            pieces.setdefault(row[place], []).append(row)
    if not pieces:
        return
    for piece in pieces.values():
        piece.sort(key=_sort_key)  # in order already, unless a block was fetched out of turn
    merged = list(LoserTree([pieces[r] for r in sorted(pieces)], _sort_key))
    columns = dict(zip(names, zip(*merged)))
    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in RUN], schema=RUN)


def merged_index(spark: SparkSession, archives: str, index: str) -> DataFrame:
    """All captures of a folder of archives in order of URL key, time and key.

    The runs are stored under ``index`` first, so that finding the ranges does not read the archives again. Ranges are
    cut through all three columns: the captures of one very frequent URL spread over many tasks.
    """
    runs(spark, archives).write.parquet(index)
    stored = spark.read.schema(ENTRY).parquet(index)
    return stored.repartitionByRange(*[F.col(c).asc_nulls_first() for c in ORDER]).mapInArrow(_merge, ENTRY)

