"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Reading tasks get byte ranges of archives. A task looks for gzip magic in its range, accepts a
place as a member if it inflates to a WARC header, and owns the records that start inside the
range; the last one is read to its end beyond it. So an archive of any size is read by as many
tasks as it has ranges, without an index. Archives lie in the shared folder and are opened
through its URI.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 18
#: A payload of more than 1 / HOT of all pages is joined by a broadcast: there are fewer than HOT of them.
HOT = 1000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, path string, start long"

def _clean(text: str | None) -> str:
    """Header values hold no control characters."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text or "")


def record(row: dict, date: str) -> bytes:
    """One gzip member. row: record_id, url, record_type, refers_to, digest, payload_bytes, payload."""
    block = _HTTP + (row["payload"] or b"" if row["record_type"] == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(row['url'])}",
        f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row["refers_to"] is not None:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gzip.flush()


def parse(raw: bytes) -> dict:
    """Headers (lower-case names, type under 'warc') and payload of an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    out: dict = {"warc": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    block = rest[: int(out.get("content-length", 0))]
    out["payload"] = block.partition(b"\r\n\r\n")[2] if out.get("content-type", "").startswith("application/http") else block
    return out


def members(f, lo: int, hi: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(start, inflated bytes) of each record that starts in [lo, hi)."""
    data, at = b"", lo  # data: bytes of the file from at

    def more() -> bool:
        nonlocal data
        got = f.read_at(min(STEP, size - at - len(data)), at + len(data)) if at + len(data) < size else b""
        data += got
        return bool(got)

    while at < hi:
        found = data.find(MAGIC)
        if found < 0:
            keep = min(len(data), len(MAGIC) - 1)
            at, data = at + len(data) - keep, data[len(data) - keep :]
            if not more():
                return
            continue
        at, data = at + found, data[found:]
        if at >= hi:
            return
        inflate, out, fed = zlib.decompressobj(31), [], 0
        try:
            while not inflate.eof:
                if fed == len(data) and not more():
                    raise zlib.error("cut off")
                out.append(inflate.decompress(data[fed:]))
                fed = len(data)
                if not b"".join(out[:2])[:7].startswith(b"WARC/1."[: sum(map(len, out[:2]))]):
                    raise zlib.error("no WARC header")
        except zlib.error:
            at, data = at + 1, data[1:]
            continue
        whole = b"".join(out)
        used = len(data) - len(inflate.unused_data)
        if whole.startswith(b"WARC/1.") and b"\r\n\r\n" in whole:
            yield at, whole
            at, data = at + used, data[used:]
        else:
            at, data = at + 1, data[1:]


def write_archives(records: DataFrame, folder: str, file_bytes: int = 1 << 28, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes rows (record_id, url, record_type, refers_to, digest, payload_bytes, payload); returns path and bytes of each file.

    The file list is stored, so that a later failure does not write archives anew. A repeated
    task writes other files, and only those of the task that succeeded are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        sink, name, size, done = None, "", 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    name, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    sink = system.open_output_stream(name, compression=None)
                data = record(row, date)
                sink.write(data)
                size += len(data)
                if size >= file_bytes:
                    sink.close()
                    sink = None
                    done.append((name, size))
        if sink is not None:
            sink.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "bytes"])

    return stored(records.mapInArrow(run, "path string, bytes long"), "warc-files")


def read_archives(files: DataFrame, folder: str, split_bytes: int = 1 << 22) -> DataFrame:
    """Records of the listed archives (path, bytes), one task for each byte range of split_bytes."""
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("start", pa.int64())])
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out, held = [], 0
                with system.open_input_file(row["path"]) as f:
                    for start, raw in members(f, row["start"], min(row["start"] + split_bytes, row["bytes"]), row["bytes"]):
                        x = parse(raw)
                        strip = lambda v: v.strip("<>") if v else None
                        digest, length = x.get("warc-payload-digest"), x.get("x-payload-length")
                        out.append({"record_id": strip(x.get("warc-record-id")), "record_type": x.get("warc-type"), "target_uri": x.get("warc-target-uri"), "refers_to": strip(x.get("warc-refers-to")), "payload_digest": digest.rpartition(":")[2] if digest else None, "payload_length": int(length) if length else len(x["payload"]), "payload": x["payload"], "path": row["path"], "start": start})
                        held += len(raw)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    return ranges.repartition(int(n), "path", "start").mapInArrow(run, RECORDS)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Rows for write_archives: of equal payloads of at least `least` bytes all but that of the smallest id are revisits."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    many = base.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    many = stored(many, "warc-firsts")
    hot = many.where(F.col("n") * HOT > pages.count())
    rest = base.join(F.broadcast(hot.select("digest", F.col("first").alias("often"))), "digest", "left")
    found = rest.join(many.join(hot, "digest", "left_anti").select("digest", "first"), "digest", "left").withColumn("first", F.coalesce("often", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"), "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"), "digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, folder: str | None = None, split_bytes: int = 1 << 22, **columns) -> DataFrame:
    """Writes pages as WARC records and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, payload, path, start.

    A null html is an empty payload; payloads under 100 bytes are never revisits. Rows that
    repeat the smallest id of their payload are all responses; a null id loses to any other
    and is read back as null. An empty table gives no archives and no rows; further columns of
    the input are not archived.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    read = read_archives(write_archives(page_records(pages, **columns), folder), folder, split_bytes)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    response = F.col("record_type") == "response"
    return read.select(
        number("record_id").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "payload", "path", "start",
    )
