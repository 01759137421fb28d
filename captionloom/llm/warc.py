"""WARC archives: one gzip member per record, written and read as streams.

Writing: one record per page; the first page of a payload is its response, later ones revisit it.
Reading: members are inflated block by block, headers framed by their empty line, blocks by
Content-Length, and every digest is computed anew and compared.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.session import fresh_dir, materialize
from captionloom.sources.paths import open_fs

#: A new archive is begun beyond so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
HEADER_BYTES = 1 << 20
#: Payload bytes and rows handed to Spark at a time.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class WarcError(ValueError):
    """An archive that is cut off, badly framed, or whose digests do not hold."""


def sha1_base32(data: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex, in column functions: five hex digits give four letters."""

    def letters(i: Column) -> Column:
        n = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        cut = [F.shiftright(n, k).bitwiseAND(F.lit(31)) + 1 for k in (15, 10, 5, 0)]
        return F.concat(*[F.substring(F.lit(BASE32), c, F.lit(1)) for c in cut])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, first_id, first_here`` for the writer.

    ``digest`` is of the payload (null: empty). The response of a digest is its smallest page_id,
    null last; ``first_id`` is null on that page's rows. Rows alike in page_id and payload stay
    together and in one task, where the writer takes the first of them as the response.
    Digests and ids are counted without the payloads; payloads are exchanged once, by page and
    digest, so that many pages of equal payload spread over the tasks.
    """
    payload = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    ids = materialize(base.groupBy("digest", "page_id").agg(F.lit(1).alias("one")).drop("one"), "ids")
    order = F.struct(F.col("page_id").isNull().alias("missing"), F.col("page_id").alias("first_id"))
    firsts = materialize(ids.groupBy("digest").agg(F.min(order).alias("first")), "firsts")
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest")
    same = F.col("first.first_id").eqNullSafe(F.col("page_id"))
    roles = ids.join(firsts, "digest").select(
        key.alias("key"), F.col("first.first_id").alias("first_id"), same.alias("first_here")
    )
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by number, so that no later step splits the rows of a key.
    dealt = base.withColumn("key", key).repartition(parts, "key")
    return dealt.join(roles, "key").sortWithinPartitions("key").drop("key")


def _uri(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, not compressed. ``refers_to`` makes it a revisit, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", _uri(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (``page_id, url, html``) as archives below ``folder``; gives ``path, records``.

    A task writes files of its own name and reports them when they are whole. The list is written
    down, and only files on it are read: what a lost or repeated task left behind is not.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = open_fs(folder)
        system.create_dir(inner, recursive=True)
        out, path, records, size, last = None, "", 0, 0, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [records]})

        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode("utf-8", "surrogatepass")
                key = (row["page_id"], row["digest"])
                response = row["first_here"] and key != last
                last = key
                base32 = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                refers = None if response else _uri(row["first_id"])
                if out is None:
                    path, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{inner}/{path}", compression=None)
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(record_bytes(row["page_id"], row["url"], payload, base32, refers))
                member += deflate.flush()
                out.write(member)
                records += 1
                size += len(member)
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    written = with_roles(pages).mapInArrow(write, "path string, records long")
    return materialize(written, "archives")


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of inflated pieces."""
    rest = b""

    def inflate(first: bytes) -> Iterator[bytes]:
        nonlocal rest
        state = zlib.decompressobj(31)
        data = first
        while True:
            try:
                piece = state.decompress(data, READ_BYTES)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from None
            if piece:
                yield piece
            if state.eof:
                rest = state.unused_data
                return
            data = state.unconsumed_tail or stream.read(READ_BYTES)
            if not data and not piece:
                raise WarcError("the archive ends inside a record")

    while True:
        rest = rest or stream.read(READ_BYTES)
        if not rest:
            return
        pieces = inflate(rest)
        rest = b""
        yield pieces
        for _ in pieces:
            raise WarcError("a record was not read to its end")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive, checked.

    Only the record at hand is held. The block digest is checked here, the payload digest of a
    response as well; a revisit's payload is another record's.
    """
    for pieces in _members(stream):
        buffer = bytearray()
        for piece in pieces:
            buffer += piece
            end = buffer.find(b"\r\n\r\n")
            if end >= 0 or len(buffer) > HEADER_BYTES:
                break
        else:
            end = -1
        if end < 0:
            raise WarcError("a record has no end of header")
        version, *lines = bytes(buffer[:end]).decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {version[:40]}")
        fields = {}
        for line in lines:
            name, colon, value = line.partition(":")
            if not colon:
                raise WarcError(f"bad header line: {line[:40]}")
            fields[name.strip().lower()] = value.strip()
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError):
            raise WarcError("a record has no valid Content-Length") from None
        rest = buffer[end + 4 :]
        for piece in pieces:
            rest += piece
            if len(rest) > length + 4:
                break
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise WarcError(f"a record of {length} bytes is framed as {len(rest) - 4}")
        block = bytes(rest[:length])
        if (said := fields.get("warc-block-digest")) and said != f"sha1:{sha1_base32(block)}":
            raise WarcError("a block digest does not hold")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message."""
    head, empty, body = block.partition(b"\r\n\r\n")
    if not empty:
        raise WarcError("an HTTP block has no end of header")
    return body


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``archives`` (``path``): one task reads an archive in sequence.

    Gives ``page_id, url, record_type, refers_to, digest, payload_bytes, payload``; for revisits the
    last two are null. Fails on any frame or digest that does not hold. ``payloads=False`` leaves
    the payloads out.
    """
    schema = "page_id string, url string, record_type string, refers_to string, digest string, payload_bytes long, payload binary"

    def name(uri: str | None) -> str | None:
        page = uri and uri.removeprefix("<urn:page:").removesuffix(">")
        return None if page == "none" else page

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in schema.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for paths in batches:
            for path in paths.column(0).to_pylist():
                system, inner = open_fs(path)
                with system.open_input_stream(inner, compression=None) as stream:
                    for fields, block in read_records(stream):
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        body = payload_of(block) if kind == "response" else None
                        if body is not None and sha1_base32(body) != digest:
                            raise WarcError("a payload digest does not hold")
                        length = None if body is None else len(body)
                        who, other = name(fields.get("warc-record-id")), name(fields.get("warc-refers-to"))
                        kept = body if payloads else None
                        rows.append((who, fields.get("warc-target-uri"), kind, other, digest, length, kept))
                        size += len(kept or b"")
                        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()

    files = archives.select("path")
    return files.repartition(max(1, archives.count()), F.xxhash64("path")).mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives, reads them back: one row per page, in the contract's columns.

    Null html is an empty payload. A null page_id sorts last among equals and is named null. A
    revisit has length and digest of the response that it refers to, and must have its digest.
    """
    archives = write_archives(pages.select("page_id", "url", "html"), fresh_dir(spark, "warc"))
    records = materialize(read_archives(archives, payloads=False).drop("payload", "url"), "records")
    whole = records.filter("record_type = 'response'").select(
        F.col("digest").alias("whole_digest"), F.col("payload_bytes").alias("whole_bytes")
    )
    joined = records.join(whole, F.col("digest") == F.col("whole_digest"), "left")
    checked = F.when(
        F.col("whole_bytes").isNull(), F.raise_error(F.concat(F.lit("no response holds the payload of page "), "page_id"))
    ).otherwise(F.col("whole_bytes"))
    return joined.select(
        F.col("page_id").cast("long").alias("page_id"),
        checked.cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
