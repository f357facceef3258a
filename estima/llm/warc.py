"""WARC archives: a writer, and a sequential reader that checks framing and digests.

Archives are real files, one gzip member a record, in a folder that all executors reach through pyarrow's file
systems (a shared mount, HDFS or an object store).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, shared_folder, small_batches, written

READ_BYTES = 1 << 16
MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is cut off, wrongly framed, or doesn't match its digests."""


def _clean(value: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) if b < 128 else f"%{b:02X}" for b in value.encode())


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, serial: str) -> bytes:
    """One gzip member: the record of a page, a revisit without payload if refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{serial}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [] if page_id is None else [f"WARC-Page-ID: {page_id}"]
    head += [] if url is None else [f"WARC-Target-URI: {_clean(url)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += [] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def members(read: Callable[[int], bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream one after the other, each as its decompressed pieces of bounded size."""
    rest = b""

    def pieces() -> Iterator[bytes]:
        nonlocal rest
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            data = unpack.unconsumed_tail or rest or read(READ_BYTES)
            if not unpack.unconsumed_tail:
                rest = b""
            if not data:
                raise WarcError("the archive ends within a gzip member")
            try:
                out = unpack.decompress(data, READ_BYTES)
            except zlib.error as error:
                raise WarcError(f"not a gzip member: {error}") from error
            if out:
                yield out
        rest = unpack.unused_data

    while True:
        rest = rest or read(READ_BYTES)
        if not rest:
            return
        own = pieces()
        yield own
        for _ in own:  # what the caller left unread
            pass


def read_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields in lower case, HTTP head, payload) of a member that must hold exactly one record."""
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
        if (end := buffer.find(b"\r\n\r\n")) >= 0:
            break
    else:
        raise WarcError("no end of the record's header")
    lines = bytes(buffer[:end]).decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("the record doesn't begin with its version")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as error:
        raise WarcError("the record has no content length") from error
    digest, body = hashlib.sha256(), bytearray()
    tail = bytearray()

    def take(piece: bytes) -> None:
        own = piece[: max(0, length - len(body))]
        digest.update(own)
        body.extend(own)
        tail.extend(piece[len(own) :])
        if len(tail) > 4:
            raise WarcError("the record is longer than its content length")

    take(bytes(buffer[end + 4 :]))
    for piece in pieces:
        take(piece)
    if len(body) != length or tail != b"\r\n\r\n":
        raise WarcError("the record is shorter than its content length")
    if fields.get("warc-block-digest", "").lower() not in ("", f"sha256:{digest.hexdigest()}"):
        raise WarcError("the block doesn't match its digest")
    head, gap, payload = bytes(body).partition(b"\r\n\r\n")
    if fields.get("content-type", "").startswith("application/http") and not gap:
        raise WarcError("the block has no HTTP head")
    return fields, head, payload


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name, buffer_size=READ_BYTES, compression=None) as stream:
        for pieces in members(stream.read):
            yield read_record(pieces)


def with_revisits(pages: DataFrame, id_col: str, html_col: str, url_col: str | None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, length, refers_to): refers_to is the smallest id among rows of equal payload of
    at least min_bytes, null on the row or rows that hold it.

    A payload with over a thousandth of all rows is looked up in a table of a thousand rows at most, which is
    broadcast; the rest are joined by digest, where no key is larger than that."""
    small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), (F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")).alias("url"), payload.alias("html")).withColumns({"digest": F.sha2("html", 256), "length": F.octet_length("html").cast("long")})
    groups = written(base.where(F.col("length") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if total[1] <= MAX_BROADCAST_ROWS // 5:
        found = base.join(F.broadcast(groups), "digest", "left")
    else:
        hot = groups.where(F.col("n") > total[0] // 1000)
        cold = groups.where(F.col("n") <= total[0] // 1000)
        found = base.join(F.broadcast(hot), "digest").unionByName(base.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest", "left"), allowMissingColumns=True)
    return found.select("page_id", "url", "html", "digest", "length", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition of with_revisits' rows; returns a table (path, records) of them.

    A task writes under a name of its own and then moves the file to the partition's name, so that an attempt
    that is repeated leaves one whole file."""

    def archive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get(), 0
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}.warc.gz"
        own = f"{name}.{task.taskAttemptId()}.tmp"
        with system.open_output_stream(own, compression=None) as out:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    page, refers = (None if x is None or x != x else int(x) for x in (row.page_id, row.refers_to))
                    out.write(record_bytes(page, row.url, row.html or b"", row.digest, int(row.length), refers, f"{task.partitionId()}-{n}"))
                    n += 1
        system.move(own, name)
        scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
        yield pd.DataFrame({"path": [folder.rstrip("/") + name[len(base) :] if scheme else name], "records": [n]})

    ids = {"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")}
    return written(records.withColumns(ids).mapInPandas(archive, "path string, records long"))


def read(spark: SparkSession, archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row per record of the archives listed in the column path: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, with keep_payload, payload. A broken archive raises WarcError."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * keep_payload
    number = lambda value: int(value.strip("<>").rpartition(":")[2]) if value else None

    def parse(fields: dict[str, str], head: bytes, payload: bytes) -> tuple:
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").rpartition(":")[2]
        length = int(named.get("content-length", len(payload)))
        if kind == "response":
            if len(payload) != length:
                raise WarcError("the payload is not as long as its HTTP head says")
            if digest != hashlib.sha256(payload).hexdigest():
                raise WarcError("the payload doesn't match its digest")
        row = (number(fields.get("warc-page-id")), fields.get("warc-target-uri"), length, digest, kind, number(fields.get("warc-refers-to")))
        return row + (payload,) * keep_payload

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for record in read_file(path):
                    if record[0].get("warc-type") not in ("response", "revisit"):
                        continue
                    held.append(parse(*record))
                    size += len(record[2]) * keep_payload
                    if len(held) >= 4096 or size > 1 << 23:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    files = max(1, archives.count())
    return archives.select("path").repartition(files).mapInArrow(rows, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", keep_payload: bool = False) -> DataFrame:
    """Writes every row of pages to archives in the shared folder and reads them back: see read() for the columns.

    A null html counts as an empty one. Payloads of under 100 bytes are all responses. A null id is kept and
    never refers or is referred to by number; a repeated id gives as many records; an empty table gives none;
    other columns of pages are not read.
    """
    spark = pages.sparkSession
    records = with_revisits(pages, id_col, html_col, url_col)
    return read(spark, write(records, shared_folder(spark)), keep_payload)
