"""WARC archives and their capture index.

Pages become WARC/1.1 records; of equal payloads one record is a response and
the others are revisits of it. Spark's text writer makes the gzip files (a
record is UTF-8 text that ends in two line breaks, the writer's separator), so
any file system that Spark knows will do and lost tasks are written again.
Reading parses records by their lengths. Each file's captures, sorted by URL
key and time, are a run; the runs are cut into the same key ranges, and a
loser tree merges the runs of each range into one globally ordered index.

A file is one gzip stream, as Spark writes it. So an index entry's offset and
length are places in the file's unpacked text, and files are kept small.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, map_rows, new_path, stage

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file holds about this many bytes before compression, and eight times as many at most if one page is not larger.
FILE_BYTES = 32 << 20
#: Duplicate digests up to this number are joined by broadcast.
BROADCAST_DIGESTS = 100_000
#: Captures that one merging task gets.
MERGED_ROWS = 100_000
#: Fixed value: the alphabet of RFC 4648 base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_: Column) -> Column:
    """Upper-case base32 of 40 hex digits: four characters for each five of them."""
    out = []
    for i in range(8):
        five = F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(five, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _records(pages: DataFrame, digests: DataFrame, date: Column) -> DataFrame:
    """One column, the text of each record without the final line breaks."""
    several = digests.where("rows_ > 1").select("digest", "last_id")
    small = several.count() <= BROADCAST_DIGESTS
    rows = pages.join(F.broadcast(several) if small else several, "digest", "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    payload = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    id_ = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return rows.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            header("WARC-Record-ID", id_(F.col("page_id"))),
            header("WARC-Date", F.date_format(F.coalesce(date, F.to_timestamp(F.lit("1970-01-01 00:00:00"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            header("WARC-Target-URI", clean),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
            F.when(revisit, F.concat(header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", id_(F.col("last_id"))))).otherwise(F.lit("")),
            header("Content-Type", F.lit("application/http; msgtype=response")),
            header("Content-Length", F.octet_length(block).cast("string")),
            F.lit(CRLF),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, date: Column | None = None, least_bytes: int = 0) -> str:
    """Writes a record for every row of pages (page_id, url, html) to gzip WARC files under path.

    Null html is an empty payload, a null url an empty target, a null
    page_id a record without a number. Of equal payloads of at least
    least_bytes, the row with the largest page_id is the response (each of
    them, if that id is repeated); the others are revisits that refer to it.
    With only null ids all are responses. Digests are summed before the
    shuffle, so a payload that a third of all rows share is a row per task.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("digest"), (date if date is not None else F.lit(None).cast("timestamp")).alias("date_"))
    size = F.octet_length(payload)
    digests = rows.groupBy("digest").agg(F.count("*").alias("rows_"), F.max("page_id").alias("last_id"), F.max(size).alias("bytes"))
    digests = stage(digests.select("digest", F.when(F.col("bytes") >= least_bytes, F.col("rows_")).otherwise(1).alias("rows_"), F.when(F.col("bytes") >= least_bytes, F.col("last_id")).alias("last_id"), "bytes"), "warc")
    most, mean = digests.agg(F.max("bytes"), F.avg("bytes")).first()
    per_file = max(1, min(int(FILE_BYTES / max(mean or 1, 512)), int(8 * FILE_BYTES / max(most or 1, 1))))
    _records(rows, digests, F.col("date_")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers in lower case, block, offset, length) of each record; ValueError for anything else."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or end < 0:
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at:end].decode().split(CRLF)[1:])
        head = {k.lower(): v for k, v in head.items()}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        stop = end + 4 + n + 4
        if len(block) != n or data[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"damaged record at {at}")
        yield head, block, at, stop - at
        at = stop


def surt(url: str) -> str:
    """The key that URLs are sorted by: host labels from the last, then path and query; without scheme, www, port 80 or 443, and fragment."""
    try:
        p = urlsplit(url.strip().lower())
        host, port = p.hostname or "", p.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    where = ",".join(reversed(host.split(".")))
    return f"{where}{f':{port}' if port not in (None, 80, 443) else ''}){p.path or '/'}{'?' + p.query if p.query else ''}"


def read_archives(spark, path: str) -> DataFrame:
    """The captures of all records under path: run (file), offset, length, page_id, url, url_key, captured, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are of the payload that was read; a revisit's
    are those it states. Each file's captures are sorted by URL key, time and
    page_id: a run.
    """
    schema = fields(
        ("run", "string"), ("offset", "bigint"), ("length", "bigint"), ("page_id", "bigint"), ("url", "string"), ("url_key", "string"), ("captured", "string"),
        ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint"),
    )

    def number(urn: str | None) -> int | None:
        said = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(said) if said else None

    def run(batches):
        for rows in batches:
            for name, content in rows:
                out = []
                for head, block, at, n in parse_records(zlib.decompress(content, 47)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = head["warc-type"]
                    if kind == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
                    else:
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                    url = head.get("warc-target-uri", "")
                    out.append((name, at, n, number(head["warc-record-id"]), url, surt(url), head["warc-date"], size, digest, kind, number(head.get("warc-refers-to"))))
                out.sort(key=capture_order)
                yield from out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return map_rows(files.select("path", "content"), run, schema)


def capture_order(c: tuple) -> tuple:
    """URL key, time, page_id (null first), then place."""
    return c[5], c[6], c[3] is not None, c[3] or 0, c[0], c[1]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step costs one comparison per level."""

    def __init__(self, runs: list[Iterator[Any]], key) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads: list[tuple | None] = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int) -> tuple | None:
        for row in self.runs[i]:
            return self.key(row), row
        return None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self) -> Iterator[Any]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head[1]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merge_index(captures: DataFrame, rows_per_task: int = MERGED_ROWS) -> DataFrame:
    """captures in global order of URL key, time and page_id, with position: increasing over all rows.

    The key ranges are cut by all of url_key, captured, page_id and place, so
    one URL's captures, or one page's that is repeated, may be in several. A
    task holds its range of each run, in the runs' order, and merges these;
    nothing is sorted anew.
    """
    n = captures.count()
    names = captures.columns
    ranges = captures.repartitionByRange(max(1, -(-n // rows_per_task)), "url_key", "captured", F.col("page_id").asc_nulls_first(), "run", "offset")

    def run(batches):
        runs: dict[str, list[tuple]] = {}
        for rows in batches:
            for row in rows:
                runs.setdefault(row[0], []).append(row)
        for r in runs.values():
            # A run's stretches may arrive in another order: whole stretches are put in place.
            if any(capture_order(a) > capture_order(b) for a, b in itertools.pairwise(r)):
                r.sort(key=capture_order)
        yield from LoserTree([iter(r) for r in runs.values()], capture_order)

    return map_rows(ranges, run, captures.schema).select(*names, F.monotonically_increasing_id().alias("position"))


def archive_pages(pages: DataFrame, date: Column | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back, and returns the merged index."""
    spark = pages.sparkSession
    path = write_archives(pages, new_path(spark, "warc"), date, least_bytes)
    return merge_index(stage(read_archives(spark, path), "warc"))
