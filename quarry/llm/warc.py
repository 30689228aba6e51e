"""WARC archives as a Python data source, ``spark.read.format("warc")``.

Writing: each task writes one gzip file with a member per record. A member's
header says how long the member is (an extra field, as the format allows), so
a reader can step over it. File names are unique to the attempt; the driver's
commit writes a manifest of the files of successful tasks, and readers take
only those, so retried or speculative tasks leave no double records.

Reading: partitions are planned from file sizes. Filters on ``record_type`` and
the header columns are pushed down. Only the beginning of a record is inflated
to parse its headers; the payload of an unwanted record is neither inflated nor
decoded, and with ``option("payload", "false")`` no payload is. Archives from
elsewhere (plain, or gzip without the extra field) are read as well.

Paths are opened through ``pyarrow.fs``: file, hdfs, s3 and gs URIs.

Defined cases: a null html is an empty payload; pages that share the smallest
page_id of their payload are all responses; a page without an id is a revisit
if its payload has a page with one, else a response with a null page_id.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from quarry.plans.workspace import Workspace, broadcast_if_small

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, content_type string, payload binary"
#: Header of the archive -> column of the source.
HEADERS = {
    "warc-type": "record_type",
    "warc-record-id": "record_id",
    "warc-target-uri": "target_uri",
    "warc-date": "date",
    "warc-refers-to": "refers_to",
    "warc-payload-digest": "payload_digest",
    "content-type": "content_type",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = 1 << 14
#: How far an archive is read ahead at most.
AHEAD = 4 << 20
BATCH_BYTES = 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _member(raw: bytes, level: int) -> bytes:
    """A gzip member whose extra field "QL" holds the member's whole length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HccHI", 8, b"Q", b"L", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _record(row: dict) -> bytes:
    payload = b"" if row["record_type"] == "revisit" else bytes(row["payload"] or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row['content_type']}\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + row["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += [f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    name: str
    records: int
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.level = int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                names = batch.schema.names
                for values in zip(*(c.to_pylist() for c in batch.columns)):
                    m = _member(_record(dict(zip(names, values))), self.level)
                    out.write(m)
                    records, size = records + 1, size + len(m)
        return _Written(name, records, size)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"name": m.name, "records": m.records, "size": m.size} for m in messages if m is not None]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class _Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.value = None


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if _}


class _Scan:
    """Records of one open archive, in order."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        self.held, self.begin, self.ahead = b"", 0, HEAD

    def records(self, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
        at = 0
        while at < self.size:
            head = self._at(at, HEAD)
            if head[:2] == b"\x1f\x8b":
                got, at = self._gzip(at, head, wanted, payload)
            else:
                got, at = self._plain(at, head, wanted, payload)
            if got is None:
                continue
            yield got

    def _at(self, at: int, n: int) -> bytes:
        """Bytes of the archive. It is read ahead: twice as far each time while reading goes on, a little after a leap."""
        n = min(n, self.size - at)
        end = self.begin + len(self.held)
        if at < self.begin or at + n > end:
            near = self.begin <= at <= end + self.ahead
            self.ahead = min(2 * self.ahead, AHEAD) if near else HEAD
            kept = self.held[at - self.begin :] if self.begin <= at < end else b""
            self.f.seek(at + len(kept))
            self.held, self.begin = kept + self.f.read(max(n, self.ahead) - len(kept)), at
        return self.held[at - self.begin : at - self.begin + n]

    def _gzip(self, at, head, wanted, payload):
        size = None
        if head[3] & 4 and head[12:14] == b"QL":
            size = struct.unpack_from("<I", head, 16)[0]
            z = zlib.decompressobj(31)
            data = z.decompress(head[:size], HEAD)
            rest, fed = z.unconsumed_tail, min(len(head), size)
        else:
            z = zlib.decompressobj(31)
            data, rest, fed = z.decompress(head, HEAD), z.unconsumed_tail, len(head)

        def more() -> bytes:
            nonlocal rest, fed
            if not rest and not z.eof:
                rest = self._at(at + fed, HEAD if size is None else min(1 << 20, size - fed))
                fed += len(rest)
                if not rest:
                    raise EOFError("a WARC record is cut short")
            out = z.decompress(rest, 1 << 20)
            rest = z.unconsumed_tail
            return out

        while b"\r\n\r\n" not in data and not z.eof:
            data += more()
        cut = data.find(b"\r\n\r\n")
        headers = _headers(data[:cut]) if cut >= 0 else {}
        ok = bool(headers) and wanted(headers)
        end = cut + 4 + int(headers.get("content-length", 0))
        block = data[cut + 4 : end] if ok else None
        if ok:
            parts, have = [data], len(data)
            need = end if payload else cut + 4  # without the payload, only the protocol's own headers
            while have < need and not z.eof:
                parts.append(more())
                have += len(parts[-1])
            data = b"".join(parts)
            block = data[cut + 4 : end]
        if size is None:
            while not z.eof:
                more()
            size = fed - len(z.unused_data)
        return ((headers, block) if ok else None), at + size

    def _plain(self, at, head, wanted, payload):
        skip = len(head) - len(head.lstrip(b"\r\n"))
        if skip == len(head):
            return None, at + max(1, skip)
        while b"\r\n\r\n" not in head[skip:] and at + len(head) < self.size:
            head += self._at(at + len(head), HEAD)
        cut = head.find(b"\r\n\r\n", skip)
        if cut < 0:
            return None, self.size
        headers = _headers(head[skip:cut])
        n = int(headers.get("content-length", 0))
        got = None
        if wanted(headers):
            got = headers, self._at(at + cut + 4, n if payload else min(n, HEAD))
        return got, at + cut + 4 + n


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.equal: list[tuple[str, frozenset]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]):
        own = set(HEADERS.values()) - {"content_type"}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in own and isinstance(f, EqualTo):
                self.equal.append((name, frozenset([f.value])))
            elif name in own and isinstance(f, In):
                self.equal.append((name, frozenset(f.value)))
            elif name in own and isinstance(f, StringStartsWith):
                self.prefix.append((name, f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            found = [(root, info.size)]
        else:
            every = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
            listed = [x for x in every if x.base_name.startswith("_manifest-")]
            if listed:
                found = []
                for x in listed:
                    with fs.open_input_stream(x.path, compression=None) as f:
                        found += [(f"{x.path.rpartition('/')[0]}/{y['name']}", y["size"]) for y in json.loads(f.read())]
            else:
                found = [(x.path, x.size) for x in every if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        out, size = [_Files()], 0
        for path, n in sorted(found):
            if out[-1].paths and size + n > self.partition_bytes:
                out.append(_Files())
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def _wanted(self, headers: dict[str, str]) -> bool:
        if not self.equal and not self.prefix:
            return True
        row = _columns(headers)
        return all(row.get(k) in values for k, values in self.equal) and all((row.get(k) or "").startswith(v) for k, v in self.prefix)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for headers, block in _Scan(f, f.size()).records(self._wanted, self.payload):
                    row = _columns(headers)
                    http, body = {}, block
                    if headers.get("content-type", "").startswith("application/http"):
                        cut = block.find(b"\r\n\r\n")
                        http, body = (_headers(block[:cut]), block[cut + 4 :]) if cut >= 0 else ({}, b"")
                    row["content_type"] = http.get("content-type", row.get("content_type"))
                    length = http.get("content-length", "")
                    row["payload_bytes"] = int(length) if length.isdigit() else len(body)
                    row["payload"] = body if self.payload and row.get("record_type") != "revisit" else None
                    rows.append(row)
                    held += len(block)
                    if held > BATCH_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def _columns(headers: dict[str, str]) -> dict:
    row = {name: headers.get(h) for h, name in HEADERS.items()}
    for k in ("record_id", "refers_to", "target_uri"):
        if row[k] and row[k][0] == "<" and row[k][-1] == ">":
            row[k] = row[k][1:-1]
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha256:")
    return row


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, ws: Workspace, least: int = 100) -> DataFrame:
    """(id, url columns kept) plus payload, its size and digest, record_type and refers_to.

    Only digests that occur more than once meet the rows again, as a broadcast
    if they are few, so payloads are shuffled only for very many duplicates.
    """
    p = pages.withColumn("payload", F.coalesce(F.encode(payload_col, "UTF-8"), F.lit(b""))).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    many = p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    many = ws.stage(many.select(F.col("payload_digest").alias("digest"), "first_id"), "repeated-payloads")
    met = p.join(broadcast_if_small(many), p["payload_digest"] == many["digest"], "left")
    again = F.col("first_id").isNotNull() & (F.col(id_col).isNull() | (F.col("first_id") != F.col(id_col)))
    return met.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id")))


def write_pages(spark: SparkSession, pages: DataFrame, path: str, ws: Workspace, date: str = "1970-01-01T00:00:00Z") -> None:
    """A WARC record for each row of (page_id, url, html)."""
    register(spark)
    rows = with_revisits(pages.select("page_id", "url", "html"), "page_id", "html", ws)
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    rows.select(
        "record_type",
        F.coalesce(name("page_id"), F.lit("urn:page:null")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        name("refers_to").alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    path = ws.path("archives")
    write_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), path, ws)
    page = lambda c: F.substr(F.col(c), F.lit(10)).try_cast("long")  # noqa: E731  after urn:page:
    return read_records(spark, path).select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT html, min(page_id) AS low FROM p WHERE n >= 100 GROUP BY html HAVING count(*) > 1 AND min(page_id) IS NOT NULL)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN low IS NOT NULL AND low IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN low IS DISTINCT FROM page_id THEN low END AS refers_to
FROM p LEFT JOIN m ON m.html = p.html
"""
