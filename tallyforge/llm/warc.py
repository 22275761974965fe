"""WARC archives: written with one gzip member a record, and read back in sequence.

The writer names each archive anew and reports it in a table; only archives of that table
are read, so that what a lost or repeated task has left behind is never seen.  The reader
streams an archive: it decompresses member by member, takes a record's header lines, frames
its block by the content length, and verifies the digests of block and payload.  It holds
one record at a time.

Archives go to and come from any file system that pyarrow knows by its URI; the folder must
be one that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tallyforge.llm.common import cut, shared_folder

#: Size from which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
_CHUNK = 1 << 16
_END = b"\r\n\r\n"
_WRITTEN = pa.schema([("archive", "string"), ("records", "int64"), ("bytes", "int64")])
_READ = pa.schema(
    [("archive", "string"), ("offset", "int64"), *((c, "string") for c in ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest")), ("payload_bytes", "int64"), ("payload", "binary"), ("error", "string")]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str) -> str:
    """A URL that fits into a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, record_id: str, block: bytes, payload: bytes = b"", **headers: str | None) -> bytes:
    """One WARC record as a gzip member of its own."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", **{k.replace("_", "-"): v for k, v in headers.items() if v is not None}}
    if kind != "warcinfo":
        lines["WARC-Payload-Digest"] = f"sha1:{sha1_base32(payload)}"
    lines |= {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(head.encode() + block + _END) + member.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with the page, or a revisit of the page that ``refers_to`` names, without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = {"WARC_Date": date, "WARC_Target_URI": None if url is None else _uri(url), "Content_Type": "application/http; msgtype=response"}
    name = f"urn:page:{'' if page_id is None else page_id}"
    if refers_to is None:
        return record("response", name, http + payload, payload, **common)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record("revisit", name, http, payload, WARC_Refers_To=f"<urn:page:{refers_to}>", WARC_Profile=profile, **common)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, binary ``payload``, ``refers_to``) to archives below ``folder``.

    Returns the table of the archives, which is itself written and so done once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n = system.open_output_stream(f"{root}/{name}", compression=None), 0
                    out.write(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC file version 1.1\r\n", WARC_Date=date, WARC_Filename=name, Content_Type="application/warc-fields"))
                page, url, payload, refers = (c[i].as_py() for c in columns)
                out.write(page_record(page, url, payload or b"", refers, date))
                n += 1
                if (size := out.tell()) >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "records": n, "bytes": size}], _WRITTEN)
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "records": n, "bytes": size}], _WRITTEN)

    return cut(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, from_arrow_schema(_WRITTEN)), "archives")


@dataclass
class Record:
    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    error: str | None = None


class Reader:
    """The records of a stream of gzip members, one after the other."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.at = stream, b"", 0

    def _more(self, member) -> bytes:
        """The next decompressed bytes of a member; nothing at its end."""
        while not member.eof:
            raw = self.raw or self.stream.read(_CHUNK)
            if not raw:
                raise EOFError("the archive ends within a record")
            data = member.decompress(raw, _CHUNK)
            left = member.unused_data if member.eof else member.unconsumed_tail
            self.at += len(raw) - len(left)
            self.raw = left
            if data:
                return data
        return b""

    def __iter__(self) -> Iterator[Record]:
        while True:
            self.raw = self.raw or self.stream.read(_CHUNK)
            if not self.raw:
                return
            found = Record(self.at)
            member = zlib.decompressobj(31)
            try:
                self._fill(found, member)
            except (zlib.error, EOFError) as e:  # no later member can be found for certain
                found.error = str(e)
                yield found
                return
            yield found

    def _fill(self, found: Record, member) -> None:
        data, seen = bytearray(), 0
        while (end := data.find(_END, max(0, seen - len(_END) + 1))) < 0:
            seen = len(data)
            more = self._more(member)
            if not more:
                found.error = "no end of the record's header"
                break
            data += more
        else:
            lines = data[:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                found.error = "not a WARC record"
            found.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = found.headers.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", size):
                found.error = found.error or "no content length"
            else:
                want = end + len(_END) + int(size)
                while len(data) < want + len(_END) and (more := self._more(member)):
                    data += more
                found.block = bytes(data[end + len(_END) : want])
                if len(data) < want:
                    found.error = found.error or "the block is shorter than its content length"
                elif data[want:] != _END:
                    found.error = found.error or "the block does not end where its content length says"
        while self._more(member):
            pass
        digest = found.headers.get("warc-block-digest", "")
        if digest.lower().startswith("sha1:") and digest[5:] != sha1_base32(found.block):
            found.error = found.error or "the block digest differs"


def _row(archive: str, r: Record, payloads: bool) -> dict:
    h = r.headers
    digest = re.sub("(?i)^sha1:", "", h.get("warc-payload-digest", "")) or None
    row = {"archive": archive, "offset": r.offset, "warc_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "error": r.error}
    row |= {"record_id": h.get("warc-record-id", "").strip("<>") or None, "refers_to": h.get("warc-refers-to", "").strip("<>") or None}
    head, _, payload = r.block.partition(_END)
    if row["warc_type"] == "response":
        own = sha1_base32(payload)
        if digest is not None and digest != own:
            row["error"] = row["error"] or "the payload digest differs"
        return row | {"payload_digest": own, "payload_bytes": len(payload), "payload": payload if payloads else None}
    size = re.search(rb"(?i)\ncontent-length: *([0-9]+)", head)
    return row | {"payload_digest": digest, "payload_bytes": int(size[1]) if size else None, "payload": None}


def read_archives(archives: DataFrame, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of all archives that the column ``archive`` names by URI, one row each.

    A record that breaks the format or whose digest differs has an ``error`` and stays in the
    result; after a damaged gzip member, the rest of that archive can't be framed and is not read.
    ``payload_bytes`` and ``payload_digest`` of a revisit are those of the payload it revisits, as
    its headers give them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for r in Reader(stream):
                        rows.append(_row(archive, r, payloads))
                        size += 200 + len(r.block) * payloads
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _READ)

    n = archives.count()
    spread = archives.select("archive").repartition(n) if n > 1 else archives.select("archive")
    return spread.mapInArrow(run, from_arrow_schema(_READ))


def with_revisits(pages: DataFrame, least: int = 0, parts: int = 1000) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and ``refers_to``: of pages with equal payloads, the largest id stands for all.

    Payloads below ``least`` bytes refer to none.  A null html is an empty payload.  Rows that
    repeat the largest id stand for themselves; a null id refers to the largest if there is one.

    Payloads that more than one in ``parts`` of all pages have are fewer than ``parts``: their largest ids are
    broadcast and their pages not shuffled.  The others meet by digest.
    """
    made = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    made = made.withColumn("digest", F.sha1("payload"))
    heads = made.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = cut(heads, "heads")
    hot = heads.where(F.col("n") * parts > pages.count()).select("digest", F.col("head").alias("hot_head"), F.lit(True).alias("hot"))
    placed = made.join(F.broadcast(hot), "digest", "left")
    few = placed.where("hot IS NULL").join(heads.select("digest", "head"), "digest", "left")
    both = placed.where("hot").withColumnRenamed("hot_head", "head").select("page_id", "url", "payload", "head").unionByName(few.select("page_id", "url", "payload", "head"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return both.select("page_id", "url", "payload", refers.alias("refers_to"))


def archive_pages(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back: a row for each page, with what its record says.

    Repeated rows have a record each.  Other columns of ``pages`` are not returned.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    records = read_archives(write_archives(with_revisits(pages, least), folder), payloads=False).where("warc_type <> 'warcinfo' or warc_type is null")
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1)
    broken = F.raise_error(F.concat(F.lit("a record of "), "archive", F.lit(": "), "error"))
    return records.select(
        F.when(F.col("error").isNotNull(), broken).otherwise(F.nullif(number("record_id"), F.lit(""))).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.nullif(number("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )
