"""WARC archives: write with an index first, read by coalesced byte ranges.

Writing tasks put one gzip member per record into an archive of their own and
return an index row per record (file, offset, length, url, digest).  Reading
takes any selection of index rows: they are sorted by file and offset, ranges
that touch (or nearly) become one read, and the records are cut out of it.
Archives lie in the shared folder, reached through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import ids_as_text, materialize, pick, scratch_path, ship

DATE = "1970-01-01T00:00:00Z"
INDEX = "id string, file string, offset bigint, length bigint, url string, digest string, record_type string"
RECORD = ("page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to string, payload binary")
_GAP, _RANGE = 1 << 16, 8 << 20  # bytes skipped inside, and length of, one read
_TASK = 16 << 20  # archive bytes that a reading task takes
_NO_HEADER = re.compile("[\x00-\x1f\x7f]|^ +| +$")  # of a url, what a header line cannot hold
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: str | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: str | None, url: str | None, payload: bytes, sha1: str, refers: str | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit that keeps the HTTP
    header (with the full payload's length) and leaves the payload out."""
    block = _HTTP.format(len(payload)).encode() + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
            f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _NO_HEADER.sub(lambda m: quote(m[0]), url))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _page(urn: str) -> str | None:
    return urn[len("<urn:page:"):-1] or None


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, refers): refers is the least id of an equal payload
    of at least ``min_bytes``, null where the row itself is the response."""
    rows = pages.select(F.col("id").cast("bigint").alias("id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = F.sha1("payload")
    first = (rows.where(F.length("payload") >= min_bytes).groupBy(key.alias("k"))
             .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "first"))
    return rows.withColumn("k", key).join(first, "k", "left").select(
        "id", "url", "payload", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers"))


def write_archives(records: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write (id, url, payload, refers) rows and return the index.  The name
    of an archive holds the attempt that wrote it, so attempts never touch each
    other's; the index, which is written once from the attempts that counted,
    says which archives are meant.  Others that are left behind are not read."""
    ship(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, at, out = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0, None
        for b in batches:
            rows = []
            for page, url, payload, refers in zip(b["id"], b["url"], b["payload"], b["refers"]):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                sha1 = digest(payload)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record(page, url, payload, sha1, refers, date)) + pack.flush()
                out.write(member)
                rows.append((page, f"{folder}/{name}", at, len(member), url, sha1,
                             "response" if refers is None else "revisit"))
                at += len(member)
            yield pd.DataFrame(rows, columns=["id", "file", "offset", "length", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    return materialize(records.select(ids_as_text("id"), "url", "payload", ids_as_text("refers")).mapInPandas(
        run, INDEX).withColumn("id", F.col("id").cast("bigint")), "warc-index")


def read_records(index: DataFrame, verify: bool = True, ranges: int | None = None) -> DataFrame:
    """The records that the index rows name.  Rows are dealt by ranges of
    (file, offset), sorted, and read in joined byte ranges.  ``verify``:
    raise when a stored payload does not have its digest."""
    ship(index.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans: list[list] = []
            for file, offset, length in zip(b["file"], b["offset"], b["length"]):
                last = spans[-1] if spans else None
                if last and last[0] == file and offset - last[2] <= _GAP and offset + length - last[1] <= _RANGE:
                    last[2] = max(last[2], offset + length)
                    last[3].append((offset, length))
                else:
                    spans.append([file, offset, offset + length, [(offset, length)]])
            for file, lo, hi, wanted in spans:
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    data = f.read_at(hi - lo, lo)
                rows = []
                for offset, length in wanted:
                    fields, http, payload = parse(zlib.decompress(data[offset - lo:offset - lo + length], 31))
                    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if verify and kind == "response" and digest(payload) != sha1:
                        raise ValueError(f"{file}: the payload at {offset} does not have its digest")
                    refers = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                    rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"),
                                 int(http["Content-Length"]), sha1, kind, refers,
                                 payload if kind == "response" else None))
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                                  "refers_to", "payload"])

    keys = [F.col("file"), F.col("offset")]
    dealt = index.select("file", "offset", "length")
    if ranges is None:  # by what is read, not by the size of the index rows, which would all fit in one task
        ranges = 1 + (dealt.agg(F.sum("length")).first()[0] or 0) // _TASK
    dealt = dealt.repartitionByRange(ranges, *keys)
    return dealt.sortWithinPartitions("file", "offset").mapInPandas(run, RECORD).withColumns(
        {c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive every row of ``pages`` and return the index.

    A null html is an empty payload, and empty payloads equal each other.  Of
    equal payloads the least id is the response; repeated rows of that id, and
    rows with a null id, are responses too (a null id cannot be compared).  A
    null url has no target header; others are kept as given, but for control characters
    and spaces at the ends, which are percent-encoded.  Other columns are not read."""
    rows = pick(pages, id=id_col, url=url_col, html=html_col)
    return write_archives(plan_records(rows, min_bytes), folder or scratch_path(pages.sparkSession, "warc"))
