"""Web archives: legacy ARC files, their conversion to WARC 1.0, and a WARC reader.

ARC files are one gzip member per record. The version block names the header fields of its
version (1: URL, IP, date, type, length; 2: also result code, checksum, location, offset, file
name); each record is one header line and as many bytes as it declares. The converter reads
them in two passes. The first takes metadata only (digest, length, date, place); with it,
records of equal payloads are found without moving a payload between executors. The second
streams each ARC file into a WARC file: record ids are made from the record's place, dates and
types from its header line, digests from its bytes, and payloads stored before become revisits.

Files go to a folder that driver and executors share, through its file system's own client.
Every attempt of a task writes files of its own and only the files of tasks that ended are
listed, so lost executors and repeated tasks leave no double records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged

#: Header fields by ARC version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Records in a file, and bytes after which a file ends.
FILE_RECORDS, FILE_BYTES = 4000, 64 << 20
LEVEL = 6
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURE_DATE = "20260101000000"
#: Payloads below this many bytes never become revisits.
REVISIT_BYTES = 0

_FILES = "file string, records long"
_META = "file string, n long, record_id string, page_id long, url string, date string, rtype string, digest string, strong string, payload_bytes long"
_RECORDS = "file string, n long, record_id string, page_id long, url string, date string, rtype string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Folder:
    """Writes and reads files of a folder given by path or URI."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(root)

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str) -> io.BufferedReader:
        return io.BufferedReader(gzip.GzipFile(fileobj=self.fs.open_input_file(f"{self.root}/{name}")), 1 << 18)


# ---- ARC -------------------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 tidewright\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {CAPTURE_DATE} text/plain {rest}{len(body) + 1}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, block: bytes, ctype: str = "text/html") -> bytes:
    rest = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} "
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 256 else "%20", url)
    return f"{url} 0.0.0.0 {CAPTURE_DATE} {ctype} {rest}{len(block)}\n".encode() + block + b"\n"


def parse_arc(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Ordinal, header fields and block of each record of an (unpacked) ARC stream; the version block comes first, with ``version``.

    The header line is read by the fields that the version block names; addresses with blanks in them are kept whole. Blank
    lines between records are skipped. A record cut off by the end of the file comes with the bytes that are there and
    ``truncated``; a header line that can't be read, or a file without a version block, is a ValueError.
    """
    fields = ARC_FIELDS[1]
    n = 0
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if n == 0 and not text.startswith("filedesc:"):
            raise ValueError(f"no ARC version block: {text[:80]!r}")
        parts = text.split(" ")
        try:
            length = int(parts[-1])
        except ValueError:
            raise ValueError(f"bad ARC header line: {text[:80]!r}") from None
        block = stream.read(length)
        if n == 0:
            head = block.decode("utf-8", "replace").split("\n")
            version = int(head[0].split(" ")[0])
            fields = tuple(head[1].split()) if len(head) > 1 and head[1].strip() else ARC_FIELDS[version]
            yield n, {"version": str(version), "URL": parts[0], "Archive-date": parts[2]}, block
        else:
            tail = len(fields) - 1
            if len(parts) < tail + 1:
                raise ValueError(f"bad ARC header line: {text[:80]!r}")
            header = dict(zip(fields, [" ".join(parts[:-tail]), *parts[-tail:]], strict=True))
            if len(block) < length:
                header["truncated"] = "length"
            yield n, header, block
        n += 1


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP header bytes (with the blank line), payload and header fields of a response block; no header if it isn't one."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    cut = block.find(b"\r\n\r\n")
    cut, skip = (cut, 4) if cut >= 0 else (len(block), 0)
    lines = block[:cut].decode("utf-8", "replace").split("\r\n")[1:]
    return block[: cut + skip], block[cut + skip :], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _warc_date(date: str) -> str:
    """ISO date of 14 (or fewer: filled up) digits; the epoch if they are no date."""
    if not re.fullmatch(r"\d{4,14}", date or ""):
        return "1970-01-01T00:00:00Z"
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc_type(url: str, block: bytes = b"") -> str:
    """A capture is a response if its block is an HTTP response, whatever its address, or its address is one of HTTP."""
    return "response" if block.startswith(b"HTTP/") or re.match(r"https?:", url, re.I) else "resource"


def _record_id(file: str, n: int, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{n} {date} {url}')}>"


def write_arc(pages: DataFrame, folder: str, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive ``page_id, url, html`` rows as ARC files, versions 1 and 2 in turn; returns the list of files.

    Null html is an empty payload, a null url becomes ``http://unknown.invalid/``. Repeated rows are records of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, attempt, made = _Folder(folder), uuid.uuid4().hex, 0
        out, name, version, records, size = None, "", 1, 0, 0
        for batch in batches:
            for page_id, url, page in zip(*(batch.column(i) for i in range(3)), strict=True):
                if out is None:
                    version, name = 1 + made % 2, f"{attempt}-{made:05d}.arc.gz"
                    out, records, made = to.create(name), 0, made + 1
                    size = out.write(_member(arc_version_block(version, name))) or 0
                    size = out.tell()
                body = (page.as_py() or "").encode("utf-8", "surrogatepass")
                mark = "" if page_id.as_py() is None else f"X-Page-Id: {page_id.as_py()}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{mark}\r\n".encode() + body
                out.write(_member(arc_record(version, name, size, url.as_py() or "http://unknown.invalid/", block)))
                size, records = out.tell(), records + 1
                if records >= file_records or size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])

    return staged(pages.select("page_id", "url", "html").mapInArrow(run, _FILES), "arc-files")


# ---- conversion ------------------------------------------------------------------------------------------------------------


def _arc_metadata(files: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Folder(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: dict[str, list] = {k.split()[0]: [] for k in _META.split(", ")}
                with source.read(file) as stream:
                    for n, head, block in parse_arc(stream):
                        if n == 0:
                            continue
                        url, date = head["URL"], head["Archive-date"]
                        _, payload, fields = _http(block)
                        page = fields.get("x-page-id", "")
                        row = (file, n, _record_id(file, n, url, date), int(page) if page else None, url, _warc_date(date), _warc_type(url, block), sha1_base32(payload), hashlib.sha256(payload).hexdigest(), len(payload))
                        for values, v in zip(rows.values(), row, strict=True):
                            values.append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.int64() if t == "long" else pa.string()) for k, t in (x.split() for x in _META.split(", "))]))

    return files.select("file").mapInArrow(run, _META)


def _revisits(meta: DataFrame, least: int) -> DataFrame:
    """Metadata with the record that holds the payload: ``ref_id, ref_url, ref_date``, null for the holder itself.

    Equal means the same SHA-1, SHA-256 and length. The smallest page id holds the payload (null ids last; then by file and place).
    """
    who = F.struct(F.col("page_id").isNull().alias("no"), "page_id", "file", "n", "record_id", "url", "date")
    same = (F.col("rtype") == "response") & (F.col("payload_bytes") >= least)
    first = meta.filter(same).groupBy("digest", "strong", "payload_bytes").agg(F.min(who).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    joined = meta.join(first, ["digest", "strong", "payload_bytes"], "left")
    again = same & F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return joined.select(*meta.columns, *[F.when(again, F.col(f"first.{c}")).alias(a) for c, a in (("record_id", "ref_id"), ("url", "ref_url"), ("date", "ref_date"))])


def _warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return _member(f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


def convert_arc(files: DataFrame, folder: str, to_folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Convert listed ARC files to WARC files, one each; returns the list of WARC files.

    The version block becomes a warcinfo record. HTTP responses and captures of HTTP addresses become response records, or revisit records (with the HTTP
    header kept and the payload left out) if a record with an equal payload of at least ``revisit_bytes`` bytes has a smaller
    page id; other captures become resource records. Truncated records are marked as such.
    """
    count = max(1, files.count())
    meta = staged(_revisits(staged(_arc_metadata(files.repartition(count), folder), "arc-meta"), revisit_bytes), "arc-plan")
    entry = F.struct("n", "record_id", "rtype", "ref_id", "ref_url", "ref_date")
    # A file's list is bounded by FILE_RECORDS.
    plan = meta.groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("plan")).join(files.select("file"), "file", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, to = _Folder(folder), _Folder(to_folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                plan = {p["n"]: p for p in row["plan"] or []}
                with source.read(row["file"]) as stream, to.create(name) as out:
                    for n, head, block in parse_arc(stream):
                        date = _warc_date(head["Archive-date"])
                        if n == 0:
                            info = f"software: tidewright\r\nformat: WARC File Format 1.0\r\narc-version: {head['version']}\r\narc-file: {row['file']}\r\n".encode()
                            out.write(_warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(row["file"], 0, head["URL"], date)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
                            continue
                        p = plan[n]
                        http, payload, _ = _http(block)
                        kind = "revisit" if p["ref_id"] else p["rtype"]
                        body = http if kind == "revisit" else block
                        headers = [("WARC-Type", kind), ("WARC-Record-ID", p["record_id"]), ("WARC-Target-URI", head["URL"]), ("WARC-Date", date), ("WARC-IP-Address", head.get("IP-address", "0.0.0.0"))]
                        headers += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(body)}")]
                        if kind == "revisit":
                            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", p["ref_id"]), ("WARC-Refers-To-Target-URI", p["ref_url"]), ("WARC-Refers-To-Date", p["ref_date"])]
                        if "truncated" in head:
                            headers.append(("WARC-Truncated", head["truncated"]))
                        headers.append(("Content-Type", "application/http; msgtype=response" if http else head.get("Content-type", "application/octet-stream")))
                        out.write(_warc_record(headers, body))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(plan)], pa.int64())], names=["file", "records"])

    return staged(plan.repartition(count).mapInArrow(run, _FILES), "warc-files")


# ---- WARC ------------------------------------------------------------------------------------------------------------------


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an (unpacked) WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"bad WARC record: {line[:80]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


def read_warc(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of listed WARC files but warcinfo: place, id, type, reference, digest and length of the full payload, payload.

    A stored payload's digest is computed anew and must be the declared one (else ValueError); a revisit's are those declared.
    Without ``payloads`` the payload column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Folder(folder)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(k, kinds[t]) for k, t in (x.split() for x in _RECORDS.split(", "))])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with source.read(file) as stream:
                    for n, (head, block) in enumerate(parse_warc(stream)):
                        kind = head["warc-type"]
                        if kind == "warcinfo":
                            continue
                        _, payload, fields = _http(block)
                        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        stored = kind != "revisit"
                        if stored and declared and declared != sha1_base32(payload):
                            raise ValueError(f"{file}: record {n} does not match its digest")
                        page = fields.get("x-page-id", "")
                        rows.append(
                            {
                                "file": file, "n": n, "record_id": head["warc-record-id"], "page_id": int(page) if page else None, "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "rtype": kind,
                                "refers_to_id": head.get("warc-refers-to"), "payload_digest": declared, "payload_bytes": len(payload) if stored else int(fields.get("content-length", 0)), "payload": payload if payloads and stored else None,
                            }
                        )
                        size += len(payload) if payloads else 100
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(run, _RECORDS)


def archive_round_trip(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files hold: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``.

    An empty table gives an empty result. Page ids should be unique: of rows that share one, one is the response.
    """
    spark: SparkSession = pages.sparkSession
    root = folder or new_path(spark, "archives")
    arc = write_arc(pages, f"{root}/arc")
    warc = convert_arc(arc, f"{root}/arc", f"{root}/warc", revisit_bytes)
    records = staged(read_warc(warc, f"{root}/warc", payloads=False).drop("payload"), "warc-records")
    held = records.filter("rtype = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(held, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", F.col("rtype").alias("record_type"), "refers_to", "url")
