"""WARC archives: segmented writing, reading, and reassembly of segmented records."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, shared_folder, stage

#: A record's block is cut into segments of this many bytes.
SEGMENT = 16_384
#: Size of the chunks of the transfer framing.
CHUNK = 4_096
#: With SEGMENT this bounds an archive file, which one task reads at once: 64 MB before compression.
RECORDS_PER_FILE = 4_096
#: Payloads below this size are never revisits.
LEAST_REVISIT = 0

_RECORD = "origin string, segment int, total long, kind string, page_id long, refers_to long, target string, digest string, payload_length long, block binary"
_READ = pa.schema(
    [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
     ("target", pa.string()), ("digest", pa.string()), ("payload_length", pa.int64()), ("block", pa.binary())]
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Transfer framing: each chunk after its length in hexadecimal, then an empty chunk."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header is not ended")
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return unchunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def _header(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _plain(url: str | None) -> str | None:
    """A target URI for a header line: without control characters."""
    return None if url is None else "".join(c for c in url if c.isprintable()).strip() or None


def records_of(seq: int, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, run: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The WARC records of one page, each without the blank lines that end it."""
    name = f"<urn:x-page:{run}:{seq}>"
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", _plain(url)), ("X-Page-ID", page_id)]
    digest = ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, profile, digest, ("X-Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response")]
        yield _header(fields, len(block)) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) > 1 else []
        if k == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, digest, ("Content-Type", "application/http; msgtype=response")]
            fields += [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k)]
        yield _header(fields + last, len(part)) + part


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write a record for each page to gzipped WARC files below path, by Spark's committing text writer.

    Of equal payloads of at least `least` bytes, the one with the largest page id is written in full and the others
    as revisits of it. Rows with equal largest ids are all written in full; a null id counts as the smallest.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("length", F.octet_length("payload"))
    same = rows.where(F.col("length") >= least).groupBy("sha", "length").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    copies = stage(same.where("n > 1").drop("n"), "copies")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    linked = rows.join(copies, ["sha", "length"], "left").select(F.monotonically_increasing_id().alias("seq"), "page_id", "url", "payload", refers.alias("refers_to"))
    run = path.rstrip("/").rpartition("/")[0].rpartition("/")[2] or "run"

    def render(batches):
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for record in records_of(*row, run):
                    out.append(record)
                    size += len(record)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # the line separator of the writer is the end of a WARC record
    records = linked.mapInArrow(lean(render), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a byte stream; ValueError where it is not WARC or cut short."""
    buffer = bytearray()

    def need(n: int) -> bool:
        while len(buffer) < n:
            more = next(data, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while need(2) and buffer[:2] == b"\r\n":
            del buffer[:2]
        if not need(1):
            return
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not need(len(buffer) + 1):
                raise ValueError("record header is cut short")
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(head.get("content-length", "0"))
        if not need(end + 4 + length):
            raise ValueError("record block is cut short")
        block = bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 4 + length]
        yield head, block


def gunzipped(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The content of gzip members in pieces; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        rest = data
        while rest and not member.eof:
            if out := member.decompress(rest, step):
                yield out
            rest = member.unconsumed_tail
        data = member.unused_data


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below path. Only Spark's reader touches the files."""

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in parse(gunzipped(data.as_py())):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    origin = head.get("warc-segment-origin-id") or head.get("warc-record-id")
                    content = None
                    if kind == "revisit":
                        content = _number(dict(x.lower().split(b":", 1) for x in block.split(b"\r\n") if b":" in x).get(b"content-length", b"").strip().decode())
                    rows.append((origin, _number(head.get("warc-segment-number")) or 1, _number(head.get("warc-segment-total-length")), kind, _number(head.get("x-page-id")),
                                 _number(head.get("x-refers-to-page-id")), head.get("warc-target-uri"), (head.get("warc-payload-digest") or "sha1:")[5:] or None, content, block))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(lean(read), _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each original record: its fields, the block put together again, and what is wrong with it.

    Segments meet by the id of their first record and are ordered by number. error is null, or says that
    the first segment or another is missing or repeated, or that the total length differs from the declared one.
    """
    first = F.struct("segment", "total", "kind", "page_id", "refers_to", "target", "digest", "payload_length", "block")
    met = records.groupBy("origin").agg(F.sort_array(F.collect_list(first)).alias("s"))
    numbers, total = F.transform("s", lambda x: x["segment"]), F.element_at("s", -1)["total"]
    block = F.when(F.size("s") == 1, F.element_at("s", 1)["block"]).otherwise(F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["block"])), "")))
    head = F.element_at("s", 1)
    met = met.select("origin", *(head[c].alias(c) for c in ("kind", "page_id", "refers_to", "target", "digest", "payload_length")), numbers.alias("numbers"), total.alias("total"), block.alias("block"))
    wrong = (
        F.when(F.col("numbers") != F.sequence(F.lit(1), F.size("numbers")), "segments missing or repeated")
        .when((F.size("numbers") > 1) & F.col("total").isNull(), "last segment missing")
        .when(F.col("total") != F.octet_length("block"), "total length differs")
        .when(F.col("kind") == "continuation", "first segment missing")
    )
    return met.withColumn("error", wrong).drop("numbers", "total")


def payloads(whole: DataFrame) -> DataFrame:
    """(page_id, target, record_type, refers_to, payload, payload_bytes, payload_digest, error) of reassembled records.

    The payload of a response is decoded from its transfer framing and digested; error also says where that fails or where the
    digest differs from the declared one. A revisit has no payload of its own and gives the length and digest it declares.
    """
    return whole.mapInArrow(lean(_decode(True)), f"{_PAGE}, payload binary")


def payload_digests(whole: DataFrame) -> DataFrame:
    """As payloads, without the payloads themselves."""
    return whole.mapInArrow(lean(_decode(False)), _PAGE)


_PAGE = "page_id long, target string, record_type string, refers_to long, payload_bytes long, payload_digest string, error string"


def _decode(keep: bool):
    def run(batches):
        for batch in batches:
            rows = []
            columns = ("kind", "page_id", "refers_to", "target", "digest", "payload_length", "block", "error")
            for kind, page, refers, target, digest, length, block, error in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                payload = None
                if kind != "revisit" and error is None:
                    try:
                        payload = http_payload(block)
                        found, length = base32_sha1(payload), len(payload)
                        if digest not in (None, found):
                            error = "payload digest differs"
                        digest = found
                    except ValueError as broken:
                        error = str(broken)
                rows.append((page, target, kind, refers, length, digest, error, payload)[: 7 + keep])
            names = ["page_id", "target", "record_type", "refers_to", "payload_bytes", "payload_digest", "error", "payload"][: 7 + keep]
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 7 + keep]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to an archive in the shared folder, read it back and digest the reassembled payloads.

    One row for each page, repeated and null ids included. Null html is an empty payload. Pages of any length are written whole, in
    segments. An empty table gives an empty result. Columns other than page_id, url and html are ignored.
    """
    path = f"{shared_folder(pages.sparkSession)}/warc"
    write_archive(pages, path)
    return payload_digests(reassemble(read_records(pages.sparkSession, path)))
