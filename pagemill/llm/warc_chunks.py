"""WARC archives, written and read as a chunked record table.

Writing: every task writes one archive, a gzip member for each record, into the
shared folder. Payloads go to the archive and the digest in slices of
`CHUNK_BYTES`, straight from the column's buffer. Reading: a record comes as
rows (record identifier, chunk number, bytes) with the digest of the payload so
far, so no task holds more of a record than one chunk.

Of records with equal payloads of at least `revisit_bytes` bytes, the one with
the smallest page_id is a response; the others are revisits that name it and
carry no payload. Only names go through the join that decides this; each page's
markup is shuffled once, by its own key.

A file belongs to the result only if the task that wrote it ended well: its
path comes back as the task's output, so a lost or repeated task leaves a file
that nobody reads.

Defined results: a null payload is empty; pages without page_id are written and
read, are never named by another record while one with page_id has the same
payload, and refer to nothing when none has; rows that repeat page_id and
payload share one record type; an empty table gives no archives and an empty
table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_folder
from .common import materialise

CHUNK_BYTES = 1 << 18
REVISIT_BYTES = 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_record_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is set for revisits."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest")
    )
    names = materialise(rows.select("page_id", "digest", F.octet_length("payload").alias("n")).distinct(), "warc-names")
    first = names.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m"))
    first = first.where("m > 1 and first is not null").drop("m")
    later = names.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    later = materialise(
        later.select(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("~")), "digest").alias("key"), F.col("first").alias("refers_to")),
        "warc-revisits",
    )
    keyed = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("~")), "digest"))
    typed = keyed.join(later, "key", "left")
    return typed.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("n"), "digest", "refers_to")


def _text_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode("ascii")


def _record_id(page_id: int | None) -> str:
    return f"<urn:pagemill:page:{'none' if page_id is None else page_id}>"


def _write(file, page_id, url, payload, size: int, sha1: str, refers_to) -> None:
    """One record as one gzip member."""
    kind = "response" if refers_to is None else "revisit"
    length = size if kind == "response" else 0
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url or "urn:pagemill:unknown")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{_text_digest(bytes.fromhex(sha1))}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {length}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-X-Payload-Length: {size}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    file.write(pack.compress(("\r\n".join(lines) + "\r\n\r\n").encode("ascii")))
    if length:
        view = memoryview(payload)
        for at in range(0, length, CHUNK_BYTES):
            file.write(pack.compress(view[at : at + CHUNK_BYTES]))
    file.write(pack.compress(b"\r\n\r\n"))
    file.write(pack.flush())


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Writes the records of `with_record_types`; (path, records) of every archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = _filesystem(folder)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        count, file = 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "n", "digest", "refers_to")]
            for i in range(len(batch)):
                if file is None:
                    filesystem.create_dir(path, recursive=True)
                    file = filesystem.open_output_stream(name, compression=None)
                payload = columns[2][i].as_buffer() if columns[2][i].is_valid else b""
                _write(file, columns[0][i].as_py(), columns[1][i].as_py(), payload or b"", *(columns[k][i].as_py() for k in (3, 4, 5)))
                count += 1
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["path", "records"])

    return materialise(typed.mapInArrow(run, "path string, records long"), "warc-files")


def _members(stream, chunk: int) -> Iterator[bytes | None]:
    """Inflated pieces of an archive of at most `chunk` bytes; None ends a gzip member."""
    inflate, rest = zlib.decompressobj(31), b""
    while True:
        data = rest or stream.read(chunk)
        if not data:
            return
        piece = inflate.decompress(data, chunk)
        if piece:
            yield piece
        rest = inflate.unconsumed_tail
        if inflate.eof:
            rest = inflate.unused_data
            inflate = zlib.decompressobj(31)
            yield None


def records(stream, chunk: int = CHUNK_BYTES) -> Iterator[tuple[dict[str, str], int, bytes, str, bool]]:
    """(headers, chunk number, bytes, digest so far, whether it is the last) of every chunk of an archive.

    An empty payload has one empty chunk.
    """
    head, buffer, number, left = None, b"", 0, 0
    digest = hashlib.sha1()
    for piece in _members(stream, chunk):
        if piece is None:
            head, buffer = None, b""
            continue
        if head is None:
            buffer += piece
            at = buffer.find(b"\r\n\r\n")
            if at < 0:
                continue
            lines = buffer[:at].decode("ascii").split("\r\n")
            head = {k: v for k, v in (x.split(": ", 1) for x in lines[1:])}
            piece, left, number, digest = buffer[at + 4 :], int(head["Content-Length"]), 0, hashlib.sha1()
            if left == 0:
                yield head, 0, b"", _text_digest(digest.digest()), True
        if left and piece:
            part = piece[:left]
            left -= len(part)
            digest.update(part)
            yield head, number, part, _text_digest(digest.copy().digest()), left == 0
            number += 1
    return


def read_archives(files: DataFrame, folder: str, chunk: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """The chunked record table of archives.

    (record_id, page_id, record_type, refers_to, chunk_no, chunk, bytes_so_far,
    digest_so_far, last, stated_digest, stated_bytes); without `payload` the
    chunk column is null, and all else is the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _filesystem(folder)
        rows: list[tuple] = []
        held = 0

        def number(name: str | None) -> int | None:
            tail = name.rsplit(":", 1)[1][:-1] if name else "none"
            return None if tail == "none" else int(tail)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNKS)], schema=_CHUNKS)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with filesystem.open_input_stream(path, compression=None) as stream:
                    total = 0
                    for head, no, data, digest, last in records(stream, chunk):
                        total = len(data) + (total if no else 0)
                        rows.append((head["WARC-Record-ID"], number(head["WARC-Record-ID"]), head["WARC-Type"], number(head.get("WARC-Refers-To")), no, data if payload else None, total, digest, last, head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head.get("WARC-X-Payload-Length", head["Content-Length"]))))
                        held += len(data) if payload else 0
                        if held > 16 * chunk or len(rows) >= 10_000:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    each = max(1, files.count())  # a task for each archive, however small the table of paths is
    return files.select("path").repartition(each).mapInArrow(run, "record_id string, page_id long, record_type string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean, stated_digest string, stated_bytes long")


_CHUNKS = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64())]
)


def archive(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, folder: str | None = None, payload: bool = True, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Writes `pages(page_id, url, html)` to archives and returns their chunked record table."""
    folder = folder or work_folder(pages.sparkSession, "warc")
    files = write_archives(with_record_types(pages, revisit_bytes), folder)
    return read_archives(files, folder, chunk, payload)


def record_table(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the last chunk of every record.

    Responses give what was counted and digested while reading; revisits what
    they state of the payload they stand for.
    """
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        "page_id",
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
