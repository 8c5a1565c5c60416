"""WARC archives: whole-file gzip streams rewritten to one gzip member per record, with a sidecar index of offsets.

``write_archives`` writes pages as WARC records, each archive one gzip stream (the monolithic form that random access
cannot use). ``normalise`` inflates such a stream once, front to back, writes every record as its own gzip member into a
new archive and a line per record (offset, length, record id, type, digest, target) into ``<archive>.idx``. ``read_back``
opens the members through that index.

Files go to a shared folder under names of their own for every attempt of a task; a table of the names that finished
attempts report says which files count, so a lost executor leaves at most a file that nothing refers to.

Among pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is the response and the
others are revisits of it, without payload; a revisit's header carries the digest and length of the full payload.

Defined results: a null html is an empty payload; a null url is an empty target; rows that repeat the smallest page_id are
all responses; a null page_id counts as larger than any other, and if all ids of a payload are null all are responses;
an empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import pick, shared_dir, small_batches, written

ARCHIVE_BYTES = 32 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long, target string, intact boolean"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, first: the page_id of the response with this payload (null where the page is a response)."""
    rows = pick(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("payload", F.sha2(F.col("html").cast("binary"), 256))
    keys = rows.filter(F.octet_length("html") >= least).select("page_id", "payload")
    first = keys.groupBy("payload").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # ids and digests alone are decided; pages then meet the verdict by their own id, so a popular payload is spread
    revisits = keys.join(first, "payload").filter("page_id is null or page_id > first").select(F.col("page_id").alias("id"), F.col("payload").alias("digest"), "first").distinct()
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload") == F.col("digest")), "left")
    return joined.select("page_id", "url", "html", "first")


def _header(value) -> str:
    return "".join(c for c in value or "" if c >= " " and c != "\x7f")


def record(page_id, url, html: str, first) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    block = HTTP + (payload if first is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}",
        *([] if first is None else [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(folder: str):
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    fs, path = pyarrow.fs.FileSystem.from_uri(folder.replace("file:///", "file:///", 1))
    return fs, path


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives below ``folder`` and returns their names (column archive), one row each."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        out = None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name = f"{path}/part-{uuid.uuid4().hex}.warc.gz"
                    out, size, deflate = fs.open_output_stream(name, compression=None), 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(*row)
                out.write(deflate.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name]})
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name]})

    return written(marked(pages, least).mapInArrow(run, "archive string"), "archives")


def inflated(read, size: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a gzip file's content, inflated once; a file of several members is read on to its end."""
    inflate, some = zlib.decompressobj(31), read(size)
    while some:
        piece = inflate.decompress(some)
        if piece:
            yield piece
        if inflate.eof:
            some, inflate = inflate.unused_data or read(size), zlib.decompressobj(31)
        else:
            some = read(size)


def records_in(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header, block, whole record) of every record of a WARC stream."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            lines = held[at:end].decode().split("\r\n")
            header = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
            stop = end + 4 + int(header["content-length"])
            if len(held) < stop + 4:
                break
            yield header, bytes(held[end + 4 : stop]), bytes(held[at : stop + 4])
            at = stop + 4
        del held[:at]
    if held:
        raise ValueError("the archive ends inside a record")


def _page(value: str | None) -> int | None:
    inner = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """One row per archive: source, archive (the new file), idx (its sidecar), records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        for b in batches:
            for source in b.column("archive").to_pylist():
                name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                offset = count = 0
                with fs.open_input_stream(source, compression=None) as file, fs.open_output_stream(name, compression=None) as out, fs.open_output_stream(f"{name}.idx") as idx:
                    for header, _, whole in records_in(inflated(file.read)):
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = deflate.compress(whole) + deflate.flush()
                        out.write(member)
                        line = [offset, len(member), header["warc-record-id"], header["warc-type"], header["warc-payload-digest"], header["warc-target-uri"]]
                        idx.write("\t".join(map(str, line)).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_pydict({"source": [source], "archive": [name], "idx": [f"{name}.idx"], "records": [count]})

    spread = archives.select("archive").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), "archive")
    return written(spread.mapInArrow(run, "source string, archive string, idx string, records long"), "normalised")


def read_back(normalised: DataFrame, folder: str) -> DataFrame:
    """One row per record, each read as a member of its own at the place that the sidecar names; see RECORDS.

    intact: the payload has the digest and length that the header states (revisits carry none: true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for b in batches:
            for archive, idx in zip(b.column("archive").to_pylist(), b.column("idx").to_pylist(), strict=True):
                with fs.open_input_stream(idx) as file:
                    lines = file.read().decode().split("\n")[:-1]  # addresses may hold other line separators
                rows = []
                with fs.open_input_file(archive) as file:
                    for line in lines:
                        offset, length = map(int, line.split("\t", 2)[:2])
                        file.seek(offset)
                        ((header, block, _),) = records_in(iter([zlib.decompress(file.read(length), 31)]))
                        payload, kind = block[len(HTTP) :], header["warc-type"]
                        stated = header["warc-payload-digest"].removeprefix("sha1:")
                        whole = kind == "revisit" or digest_of(payload) == stated and len(payload) == int(header["x-payload-length"])
                        rows.append((_page(header["warc-record-id"]), int(header["x-payload-length"]), stated, kind, _page(header.get("warc-refers-to")), archive, offset, length, header["warc-target-uri"], whole))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    spread = normalised.select("archive", "idx").repartition(max(1, normalised.sparkSession.sparkContext.defaultParallelism * 4), "archive")
    return spread.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to archives, archives to members with an index, members back to rows."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, f"{folder}/whole", least, archive_bytes)
    return read_back(normalise(archives, f"{folder}/members"), f"{folder}/members")


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "length", "intact")
