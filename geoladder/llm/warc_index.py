"""WARC archives and their index (1): external index merge.

Pages become WARC 1.1 records in gzip members. A writing task gathers captures up to a bounded size, sorts them by URL
key, timestamp and page id, and writes them as one archive: a *run*. The archives are read back record by record, which
gives each run's index entries in order. The runs are then merged: the key space is cut into ranges by (URL key,
timestamp, page id, run, offset), so that even a single URL's captures spread over tasks, one range per ``RANGE_ENTRIES``
entries. A range gets the runs' slices one after another, each as it lies in its run; a loser tree then merges them k ways
into one capture history, with a few entries of each slice unpacked at a time. Ranges in their order give the global
order.

Of records with the same payload the one with the largest page id is a ``response``; the others are ``revisit`` records
that refer to it (payloads under ``min_bytes`` are never revisits). Every payload is hashed again when it is read.

Defined results: a null payload is empty; a null url has the empty key; a null page id counts as smaller than any other
and is refers_to null; rows that repeat the winner's page id and payload are responses too; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

#: Payload bytes of a run (one archive) at most, but for one larger record.
RUN_BYTES = 24 << 20
#: Index entries of a range of the merge, about.
RANGE_ENTRIES = 100_000
EPOCH = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ENTRY = "urlkey string, timestamp string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, run string, offset bigint"
_ENTRY_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_ENTRY_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels in reverse, then path and query; no scheme, ``www.`` or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    if not host:
        return url.partition("#")[0]
    host = re.sub(r"^www\d*\.", "", host)
    tail = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (parts.path or "/") + query


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(text: str | None) -> bytes:
    """A header value: control signs and spaces would break the header, so they are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (text or "").encode("utf-8", "replace"))


def _record_id(page_id: int | None, digest: str) -> bytes:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>".encode()


def record(page_id: int | None, url: str | None, when: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    digest = base32_sha1(payload)
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _record_id(page_id, digest), b"WARC-Date: " + _field(when)]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _field(url))
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"WARC-Payload-Length: %d" % len(payload)]
    if revisit:
        head += [b"WARC-Profile: " + REVISIT_PROFILE.encode(), b"WARC-Refers-To: " + _record_id(refers_to, digest)]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: memoryview, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of an archive."""
    at = 0
    while at < len(data):
        start, d, out = at, zlib.decompressobj(31), []
        while not d.eof:
            piece = data[at : at + step]
            if not len(piece):
                raise EOFError("the archive ends inside a record")
            out.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        yield start, b"".join(out)


def _page_of(record_id: str) -> int | None:
    page = record_id[len("<urn:page:") : -1].partition(":")[0]
    return None if page == "null" else int(page)


def parse(content: bytes) -> tuple:
    """(url, date, page_id, payload length, digest, type, refers_to) of a record, checked against its own payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(h["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    digest, length = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
    if h["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != length or base32_sha1(payload) != digest:
            raise ValueError("a payload differs from its digest")
    refers = _page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
    return h.get("WARC-Target-URI"), h["WARC-Date"], _page_of(h["WARC-Record-ID"]), length, digest, h["WARC-Type"], refers


class LoserTree:
    """Merges sorted iterables: a tournament in which each inner node keeps the loser, so that a new head takes one
    comparison per level."""

    def __init__(self, runs: list[Iterable], key: Callable):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if x is None else key(x) for x in self.heads]
        self.losers = [-1] * self.k
        for i in range(len(self.runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None:
            return False
        return self.keys[b] is None or (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        while self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = x = next(self.runs[w], None)
            self.keys[w] = None if x is None else self.key(x)
            self._play(w)


def _order(urlkey: str, when: str, page_id: int | None) -> tuple:
    return urlkey.encode("utf-8", "replace"), when.encode("utf-8", "replace"), (page_id is not None, page_id or 0)


def write_archives(pages: DataFrame, spark: SparkSession, min_bytes: int = 0, timestamp: Column | None = None, folder: str | None = None) -> DataFrame:
    """Writes every page as a WARC record; returns the archives: uri, records. Columns used: page_id, url, html."""
    folder = folder or _shared.new_folder(spark, "warc")
    _shared.small_batches(spark)
    when = F.date_format(timestamp.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if timestamp is not None else F.lit(EPOCH)
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(when, F.lit(EPOCH)).alias("when"), _shared.utf8(F.col("html").cast("string")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    firsts = base.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    again = _shared.rehashed("digest")
    rows = base.withColumn("again", again).join(firsts.withColumn("again", again), ["digest", "again"], "left")
    revisit = F.col("copies").isNotNull() & (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "url", "when", "payload", "first_id", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def write(batches):
        held, size, no, out = [], 0, 0, []

        def flush():
            nonlocal held, size, no
            if not held:
                return
            held.sort(key=lambda r: r[0])
            f = _shared.SharedFile(folder, f"{_shared.attempt()}-{no:05d}.warc.gz")
            for _, r in held:
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                f.write(z.compress(record(r[0], r[1], r[2], r[3], r[4], r[5])) + z.flush())
            out.append((f.close(), len(held)))
            held, size, no = [], 0, no + 1

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((_order(url_key(_field(r[1]).decode()) if r[1] is not None else "", r[2], r[0]), r))
                size += len(r[3])
                if size >= RUN_BYTES:
                    flush()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out]), pa.array([n for _, n in out], pa.int64())], ["uri", "records"])

    return _shared.written(rows.mapInArrow(write, "uri string, records bigint"), spark, "warc-archives")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY_TYPES, strict=True)], _ENTRY_NAMES)


def read_runs(archives: DataFrame) -> DataFrame:
    """The index entries of all records, read from the archives; each archive's entries are a sorted run."""

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, before = [], None
                for offset, content in members(memoryview(_shared.read_shared(uri))):
                    url, when, page_id, length, digest, kind, refers = parse(content)
                    rows.append((url_key(url), when, page_id, length, digest, kind, refers, uri, offset))
                    now = _order(*rows[-1][:3])
                    if before is not None and now < before:
                        raise ValueError(f"{uri} is not in order")
                    before = now
                if rows:
                    yield _batch(rows)

    # a given number of tasks: adaptive execution would read rows as small as names in a single one
    return archives.select("uri").repartition(max(1, archives.count()), "uri").mapInArrow(read, ENTRY)


def merge_runs(entries: DataFrame) -> DataFrame:
    """All runs' entries in global order of (urlkey, timestamp, page_id), merged by loser trees range by range."""

    def entries_of(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
        for piece in pieces:
            for i in range(0, piece.num_rows, 64):
                yield from zip(*(c.to_pylist() for c in piece.slice(i, 64).columns), strict=True)

    def merge(batches):
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:  # sorted by run and offset: a run's slice may span batches
            ends = batch.column(7).dictionary_encode()
            at = np.asarray(ends.indices)
            cut = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist()
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                runs.setdefault(ends.dictionary[int(at[a])].as_py(), []).append(batch.slice(a, b - a))
        out = []
        for r in LoserTree([entries_of(runs[k]) for k in sorted(runs)], lambda r: _order(*r[:3])):
            out.append(r)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    n = max(1, -(-entries.count() // RANGE_ENTRIES))
    ranges = entries.repartitionByRange(n, F.col("urlkey"), F.col("timestamp"), F.col("page_id").asc_nulls_first(), F.col("run"), F.col("offset"))
    return ranges.sortWithinPartitions("run", "offset").mapInArrow(merge, ENTRY)


def capture_index(pages: DataFrame, spark: SparkSession, min_bytes: int = 0, timestamp: Column | None = None) -> DataFrame:
    """Writes the archives, reads them back and merges their runs: one row per record, in global index order."""
    entries = _shared.written(read_runs(write_archives(pages, spark, min_bytes, timestamp)), spark, "warc-runs")
    return merge_runs(entries)
