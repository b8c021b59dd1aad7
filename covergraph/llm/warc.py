"""WARC archives written from page rows and read back as a table of record chunks.

Writing. Each task streams its rows into archive files of the shared folder (one gzip member per
record, a new file after ``roll_bytes``) and reports a manifest row per file. Names hold a random
part and only the manifests of successful attempts are committed, so files that a lost or repeated
attempt left are never read. Of records with equal payloads of at least ``revisit_bytes`` bytes the
one with the largest id is a response, the others are revisits that refer to it; rows that repeat
this id are responses too, as are rows without an id if no row of their payload has one.

Reading. A record becomes rows (record_id, chunk_no, data) of at most ``chunk_bytes`` bytes each;
the length and SHA-1 of the payload are carried from chunk to chunk and stand on the last one. No
step holds a whole record. A payload that does not fit its digest is an error, and so is a record
that ends before its length.

Skew. Revisits are found by digest, without payloads, so that many copies of one page are light rows;
the payload of a response is not shuffled.

Nulls: a null payload is an empty one, a null URL is left out. Ids are whole numbers (or text that reads as
such). Empty tables give no archive and no
rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergraph.llm._common import KeyFilter, fresh_path, materialize, small_batches

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "record_id string, record_type string, url string, refers_to string, chunk_no int, data binary, "
    "is_last boolean, bytes_so_far long, payload_bytes long, payload_digest string"
)
_PIECE = 1 << 16
#: Rows are handed on when this many payload bytes or rows are waiting.
_BATCH_BYTES, _BATCH_ROWS = 1 << 22, 2000


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class _Member:
    """Writes one record as a gzip member, piece by piece."""

    def __init__(self, sink):
        self.sink, self.zip = sink, zlib.compressobj(4, zlib.DEFLATED, 31)

    def write(self, data) -> int:
        out = self.zip.compress(data)
        self.sink.write(out)
        return len(out)

    def close(self) -> int:
        out = self.zip.flush()
        self.sink.write(out)
        return len(out)


def _record(sink, record_id: str, url: str | None, payload: bytes | None, refers_to: str | None, date: str, known: tuple[int, str] | None = None) -> int:
    """Writes a record; a revisit needs no payload where its size and SHA-1 (in hex) are ``known``."""
    view = memoryview(payload or b"")
    if known is None:
        sha = hashlib.sha1()
        for at in range(0, len(view), _PIECE):
            sha.update(view[at : at + _PIECE])
        known = len(view), sha.hexdigest()
    size, hexed = known
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = size if refers_to is None else 0
    lines = [
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%s>" % record_id.encode(),
        b"WARC-Date: " + date.encode(),
        b"Content-Type: application/http;msgtype=response",
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(hexed)),
        b"Content-Length: %d" % (len(http) + body),
    ]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~").encode())
    if refers_to is not None:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%s>" % refers_to.encode()]
    member = _Member(sink)
    n = member.write(VERSION + b"\r\n".join(lines) + b"\r\n\r\n" + http)
    for at in range(0, body, _PIECE):
        n += member.write(view[at : at + _PIECE])
    return n + member.write(b"\r\n\r\n") + member.close()


def write_archives(
    pages: DataFrame, *, revisit_bytes: int = 0, roll_bytes: int = 1 << 30, date: str = "2020-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Writes the archives; returns their manifest (file, records)."""
    folder = fresh_path(pages.sparkSession, "warc", keep=True)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    own = F.coalesce("id", F.lit(-(1 << 63)))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("row", F.xxhash64("key", own))
    # Who refers to whom is told without payloads.
    meta = materialize(rows.select("id", "url", "key", "row", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha")), "warc-meta")
    same = meta.where(F.col("size") >= revisit_bytes).groupBy("key").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1 AND best IS NOT NULL").drop("n")
    again = materialize(meta.join(same, "key").where(~F.col("id").eqNullSafe(F.col("best"))), "warc-revisits")
    # Responses are written where they lie; only those that the filter takes for revisits are joined.
    maybe = KeyFilter(again.select("row"), "row")
    wrong = materialize(meta.where(maybe.test("row")).join(again, ["key", "row"], "left_anti").select("key", "row").distinct(), "warc-wrong")
    mistaken = KeyFilter(wrong.select("row"), "row")
    flagged = rows.withColumn("maybe", maybe.test("row"))
    columns = ["id", "url", "payload", "refers_to", "size", "sha"]
    plain = lambda df: df.select("id", "url", "payload", *[F.lit(None).cast(t).alias(c) for c, t in zip(columns[3:], ("string", "long", "string"))])
    known = plain(flagged.where(~F.col("maybe"))).unionByName(plain(rows.where(maybe.test("row")).where(mistaken.test("row")).join(wrong, ["key", "row"], "left_semi")))
    known = known.unionByName(again.select("id", "url", F.lit(None).cast("binary").alias("payload"), F.col("best").cast("string").alias("refers_to"), "size", "sha"))
    known = known.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("null")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        sink = name = None
        size = records = 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for key, url, data, refers, size_, sha in zip(*(batch[c] for c in columns)):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, size, records = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                size += _record(sink, key, url, data, refers, date, None if refers is None else (int(size_), sha))
                records += 1
                if size >= roll_bytes:
                    sink.close()
                    done.append((f"{folder}/{name}", records))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", records))
        yield pd.DataFrame(done, columns=["file", "records"])

    return materialize(known.mapInPandas(write, "file string, records long"), "warc-manifest")


def _headers(stream) -> dict[str, str] | None:
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line.endswith(b"\n"):
            raise ValueError("a record's head is cut short")
        name, _, value = line.decode("utf-8").partition(":")
        found[name.strip().lower()] = value.strip()
    if "content-length" not in found or "warc-record-id" not in found or "warc-type" not in found:
        raise ValueError("a record's head lacks its length, id or type")
    return found


def _id(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<urn:page:").removesuffix(">")


def chunks(stream, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA from an uncompressed stream of response and revisit records."""
    while (head := _headers(stream)) is not None:
        left = int(head["content-length"])
        length = None
        while left:
            line = stream.readline(left)
            if not line:
                raise ValueError("a record's HTTP head is cut short")
            left -= len(line)
            if line.lower().startswith(b"content-length:"):
                length = int(line.partition(b":")[2])
            if line in (b"\r\n", b"\n"):
                break
        told = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        known = (_id(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"), _id(head.get("warc-refers-to")))
        sha, seen, no = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError(f"record {known[0]} is cut short")
            left -= len(data)
            seen += len(data)
            sha.update(data)
            if left:
                yield (*known, no, data, False, seen, None, None)
                no += 1
                continue
            if known[1] == "revisit":
                yield (*known, no, data, True, seen, length, told)
            else:
                digest = base32_sha1(sha)
                if told not in (None, digest):
                    raise ValueError(f"payload of record {known[0]} does not fit its digest")
                yield (*known, no, data, True, seen, seen, digest)
            break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {known[0]} is cut short")


def read_chunks(manifest: DataFrame, *, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in a manifest; without data if only what is known of records matters."""
    names = [x.strip().split()[0] for x in CHUNK_SCHEMA.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["file"]:
                fs, path = _open(file)
                waiting, size = [], 0
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in chunks(stream, chunk_bytes):
                        size += len(row[5])
                        waiting.append(row if with_data else (*row[:5], None, *row[6:]))
                        if len(waiting) >= _BATCH_ROWS or with_data and size >= _BATCH_BYTES:
                            yield _frame(waiting, names)
                            waiting, size = [], 0
                if waiting:
                    yield _frame(waiting, names)

    # One archive is one unit of work; they are dealt out singly.
    return manifest.select("file").repartition(_spread(manifest.sparkSession), "file").mapInPandas(read, CHUNK_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    frame["payload_bytes"] = frame["payload_bytes"].astype("Int64")
    return frame


def _spread(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def record_index(chunk_table: DataFrame) -> DataFrame:
    """One row per record, from its last chunk."""
    return chunk_table.where("is_last").select("record_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)),
    'string_agg', '') AS payload_digest,
    CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM d
"""
