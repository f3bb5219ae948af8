"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, one gzip member each, in one archive for each task. Captures are sorted by their
reversed-host URL key; runs of ``block_lines`` index lines are compressed as blocks of an index file, and a sparse
directory keeps the first key, the offset and the length of every block. To find a URL, binary search in the index files'
first keys, in the directory of one of them and in one decompressed block leads to a range read of one record. ``captures`` does
so for a whole table of URLs, in the order of their keys: a first pass turns keys into the blocks that may hold them, a second one, dealt by
block, searches these and reads the records, so that a URL with very many captures is read by many tasks.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id holds the payload
(response); the others are revisits that name it. Payload digests are grouped with map-side maxima; only digests that
occur twice are joined back, by broadcast while there are at most BROADCAST_ROWS of them, else with salted keys.

Files go through a file system opened from the shared folder's URI. A task writes under a fresh name, and only names that
finished tasks return are indexed, so a lost executor leaves at worst an unread file.

Edge cases: null html is an empty payload; null page_ids sort below all others and null URLs give the empty key; rows that
share the largest page_id of a payload are each a response; page_ids come back as they were, line breaks in a URL as %0D and %0A;
payloads of any length that fits a task are whole; empty tables make an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, small_batches, staged, tidy

BROADCAST_ROWS, SALTS = 50_000, 16
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed host, then the path and query: sorts captures of a domain together. Scheme, user, port 80/443 and fragment go."""
    if not url:
        return ""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = next((i for i, c in enumerate(rest) if c in "/?"), len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:]
    host, _, port = host.partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "")
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in f"{key}){path or '/'}")


def _header(pairs: list[tuple[str, str]]) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in pairs) + "\r\n").encode()


def _record_id(page_id: str | None) -> str:
    return "<urn:null>" if page_id is None else f"<urn:page:{quote(str(page_id))}>"


def _page_id(record_id: str) -> str | None:
    return None if record_id == "<urn:null>" else unquote(record_id[len("<urn:page:") : -1])


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """An uncompressed record: a response with its payload, or a revisit with the HTTP header alone."""
    block = _HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    pairs = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date),
             ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        pairs.append(("WARC-Target-URI", url))
    if refers_to is not None:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to))]
    return _header(pairs) + block + b"\r\n\r\n"


@dataclass
class Capture:
    page_id: str | None
    url: str | None
    record_type: str
    payload_bytes: int
    digest: str
    refers_to: str | None
    payload: bytes | None


def parse(raw: bytes) -> Capture:
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
    if h["WARC-Type"] == "revisit":
        return Capture(_page_id(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), "revisit", size, h["WARC-Payload-Digest"].split(":", 1)[1], _page_id(h["WARC-Refers-To"]), None)
    digest = hashlib.sha1(payload).hexdigest()
    if len(payload) != size or f"sha1:{digest}" != h["WARC-Payload-Digest"]:
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    return Capture(_page_id(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), "response", size, digest, None, payload)


class Reader:
    """Range reads of the files under one folder; keeps the last file open."""

    def __init__(self, root: str):
        self.fs, self.path = opened(root)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, offset)

    def directory(self, name: str) -> list[list]:
        """(first key, offset, length) of an index file's blocks, in order."""
        with self.fs.open_input_file(f"{self.path}/{name}.dir") as f:
            return [json.loads(x) for x in f.read().decode().split("\n")[:-1]]


def roles(pages: DataFrame, least: int) -> DataFrame:
    """digest and response page of the payloads that occur more than once."""
    p = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("b"))
    p = p.where(F.octet_length("b") >= least).select("page_id", F.sha1("b").alias("digest"))
    p = p.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    return staged(p.select("digest", "response"), "warc-roles")


@dataclass
class Store:
    """A written archive: its folder, the index directory and the captures' id type."""

    root: str
    directory: DataFrame
    id_type: str

    def captures(self, urls: DataFrame) -> DataFrame:
        """Every record of the URLs in ``urls`` (url), found by binary search in directories and blocks and read back by ranges."""
        root, spark, parts = self.root, self.directory.sparkSession, self.parts()

        @tidy
        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in b.column(0).to_pylist()}), pa.string())], ["key"])

        @tidy
        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Keys, in order, to the blocks whose range holds them."""
            read, name, rows, firsts = Reader(root), None, [], []
            for b in batches:
                out: list[tuple[str, str, int, int]] = []
                for k in b.column(0).to_pylist():
                    for p in range(max(0, bisect.bisect_left(parts, (k,)) - 1), len(parts)):
                        first, file = parts[p]
                        if first > k:
                            break
                        if file != name:
                            name, rows = file, read.directory(file)
                            firsts = [r[0] for r in rows]
                        for i in range(max(0, bisect.bisect_left(firsts, k) - 1), len(rows)):
                            if firsts[i] > k:
                                break
                            out.append((k, file, rows[i][1], rows[i][2]))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

        @tidy
        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, archive, at, lines = Reader(root), Reader(root), None, []
            kinds = [("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
            for b in batches:
                places: list[dict] = []
                for k, *block in zip(*(c.to_pylist() for c in b.columns)):
                    if block != at:
                        at, lines = block, gzip.decompress(index.read(*block)).decode().split("\n")[:-1]
                    for i in range(bisect.bisect_left(lines, k + " "), len(lines)):
                        if not lines[i].startswith(k + " "):
                            break
                        places.append(json.loads(lines[i].split(" ", 1)[1]))
                places.sort(key=lambda x: (x["f"], x["o"]))
                got = [parse(zlib.decompress(archive.read(x["f"], x["o"], x["n"]), 31)) for x in places]
                yield pa.RecordBatch.from_arrays([pa.array([getattr(c, k) for c in got], t) for k, t in kinds], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = urls.select("url").mapInArrow(key, "key string").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
        found = keys.mapInArrow(locate, "key string, file string, offset bigint, length bigint")
        found = found.repartition(n, "file", "offset").sortWithinPartitions("file", "offset", "key")
        out = found.mapInArrow(fetch, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
        return out.withColumn("page_id", F.col("page_id").cast(self.id_type)).withColumn("refers_to", F.col("refers_to").cast(self.id_type))

    def parts(self) -> list[tuple[str, str]]:
        """First key and name of each index file, in order: as many as the index has partitions."""
        rows = self.directory.groupBy("file").agg(F.min("first_key").alias("k")).collect()
        return sorted((r["k"], r["file"]) for r in rows)

    def lookup(self, url: str, parts: list[tuple[str, str]] | None = None) -> list[Capture]:
        """Captures of a URL, by binary search and range reads; revisits carry the digest of their response."""
        parts, key, read, found = parts or self.parts(), url_key(url), Reader(self.root), []
        for _, name in parts[max(0, bisect.bisect_left(parts, (key,)) - 1) :]:
            rows = read.directory(name)
            firsts = [r[0] for r in rows]
            if firsts and firsts[0] > key:
                break
            for k in range(max(0, bisect.bisect_left(firsts, key) - 1), len(rows)):
                if rows[k][0] > key:
                    return found
                lines = gzip.decompress(read.read(name, rows[k][1], rows[k][2])).decode().split("\n")[:-1]
                for i in range(bisect.bisect_left(lines, key + " "), len(lines)):
                    if not lines[i].startswith(key + " "):
                        break
                    x = json.loads(lines[i].split(" ", 1)[1])
                    found.append(parse(zlib.decompress(read.read(x["f"], x["o"], x["n"]), 31)))
        return found


def write(pages: DataFrame, least: int = 1000, block_lines: int = 1000, level: int = 4, date: str = "1970-01-01T00:00:00Z", root: str | None = None) -> Store:
    """Write ``pages`` (page_id, url, html) as archives, index blocks and directory below ``root``."""
    spark = pages.sparkSession
    small_batches(spark)
    root = root or fresh_dir(spark, "warc")
    id_type = pages.schema["page_id"].dataType.simpleString()
    again = roles(pages, least)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    if again.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(again), "digest", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response").cast("string"))
    rows = rows.select(F.col("page_id").cast("string"), "url", "payload", "digest", refers.alias("refers_to"))

    @tidy
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(root)
        out, name, offset = None, f"archive-{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            lines = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, payload, digest, refers_to, date)) + z.flush()
                out.write(member)
                lines.append((url_key(url), page_id or "", json.dumps({"f": name, "o": offset, "n": len(member)})))
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in lines], pa.string()) for c in range(3)], ["key", "page", "at"])
        if out is not None:
            out.close()

    index = staged(rows.mapInArrow(archive, "key string, page string, at string"), "warc-captures")

    @tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(root)
        out, name, offset, directory, part = None, f"index-{uuid.uuid4().hex}.gz", 0, [], []

        def flush() -> None:
            nonlocal offset
            member = gzip.compress("".join(f"{k} {a}\n" for k, a in part).encode(), 6, mtime=0)
            out.write(member)
            directory.append((part[0][0], offset, len(member), len(part)))
            offset += len(member)
            part.clear()

        for b in batches:
            for key, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                part.append((key, at))
                if len(part) == block_lines:
                    flush()
        if part:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as f:
                f.write("".join(json.dumps(d[:3]) + "\n" for d in directory).encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(directory)), *(pa.array([d[c] for d in directory], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (0, pa.string()), (3, pa.int64())))],
                ["file", "offset", "length", "first_key", "lines"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.repartitionByRange(parts, "key", "page").sortWithinPartitions("key", "page").select("key", "at")
    directory = staged(ordered.mapInArrow(blocks, "file string, offset bigint, length bigint, first_key string, lines bigint"), "warc-directory")
    return Store(root, directory, id_type)


def op2(pages: DataFrame) -> DataFrame:
    return write(pages).captures(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP2_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, h, strlen(h) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY h) AS again,
             max(page_id) OVER (PARTITION BY h) AS response FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN response END AS refers_to, url
FROM q
"""
