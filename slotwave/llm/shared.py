"""Helpers shared by the operators: durable intermediate tables, and numpy views of text columns."""

from __future__ import annotations

import ctypes
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy block holds at most, unless a single text is longer.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see (spark.checkpoint.dir); a temporary one only where all run on this machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("slotwave.tmp.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="slotwave-")
        spark.conf.set("slotwave.tmp.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_key(name: str = "source"):
    """Nulls form a source of their own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(name)), F.lit("n"))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_JOIN = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
#: Low bytes of eight that belong to a word of so many bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_CHUNKED = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range: its length, then eight bytes after the other, each mixed in."""
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    h = mix64((sizes.astype(np.uint64) + np.uint64(1)) * np.uint64(_SEEDS[which]))
    h = mix64(h ^ (eight[starts] & _MASKS[np.minimum(sizes, 8)]))
    left = np.flatnonzero((sizes > 8) & (sizes <= _CHUNKED))
    for at in range(8, _CHUNKED, 8):
        if not len(left):
            break
        h[left] = mix64(h[left] * np.uint64(_JOIN[which]) + (eight[starts[left] + at] & _MASKS[np.minimum(sizes[left] - at, 8)]))
        left = left[sizes[left] > at + 8]
    for i in np.flatnonzero(sizes > _CHUNKED):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), _SEEDS[which])
    return h


class Words:
    """Words of a block of texts as flat arrays: byte ranges, text index, hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        self.offsets = ends - ends[0]
        self.n = len(texts)
        self.space = space = separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        first, last = ~space, ~space
        first[1:] &= space[:-1] | edge[1:-1]
        last[:-1] &= space[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        bounds = np.searchsorted(self.starts, self.offsets)
        #: Words of text i are numbered first[i] to first[i + 1].
        self.first = bounds
        self.counts = np.diff(bounds)
        self.text = np.repeat(np.arange(self.n), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        return word_hashes(self.data, self.starts, self.ends, which)

    def windows(self, width: int, which: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of `width` words inside one text.

        Hashes of 2, 4, 8, ... words are made of two halves each, and a run of the powers in its width.
        """
        run = self.hashes(which) if hashes is None else hashes
        n = len(run) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        join = lambda a, b: mix64(a * np.uint64(_JOIN[which]) + b)
        found, done, size = None, 0, 1
        while True:
            if width & size:
                found = run if found is None else join(found[: len(run) - done], run[done:])
                done += size
            if done == width:
                break
            run = join(run[:-size], run[size:])
            size *= 2
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        return at, found[at]


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES):
    """Slices of a batch whose texts together hold `most` bytes at most (or one text)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def per_text(counts_at: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How often (or with what weight) each of n texts is named."""
    return np.bincount(counts_at, weights=weights, minlength=n).astype(np.int64)


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after the other."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def release() -> None:
    """Gives freed memory of a Python worker back to the system, since workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f, sides: int = 1):
    """A group function that gives its memory back when it ends."""

    def one(t):
        try:
            return f(t)
        finally:
            release()

    def two(t, other):
        try:
            return f(t, other)
        finally:
            release()

    return one if sides == 1 else two


_ZSTD = pa.Codec("zstd", compression_level=1)
#: Packed bytes up to which compression would cost more than it saves.
_PLAIN = 64


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned integers as compressed byte planes; rising values as their differences."""
    x = values.astype(np.uint64)
    if rising and len(x):
        x = np.diff(x, prepend=np.uint64(0))
    planes = x.view(np.uint8).reshape(-1, 8).T
    used = 8 - int(np.argmax(np.append(planes.any(axis=1)[::-1], True)))
    body = np.ascontiguousarray(planes[:used]).tobytes()
    return struct.pack("<IB", len(x), used) + (_ZSTD.compress(body, asbytes=True) if len(body) > _PLAIN else body)


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    n, used = struct.unpack_from("<IB", data)
    x = np.zeros((n, 8), np.uint8)
    if n and used:
        body = _ZSTD.decompress(data[5:], n * used, asbytes=True) if n * used > _PLAIN else data[5:]
        x[:, :used] = np.frombuffer(body, np.uint8).reshape(used, n).T
    x = x.view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


def runs(labels: np.ndarray):
    """(label, first place, end) of each run of equal labels; the time depends on the labels' number only."""
    edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)] if len(labels) else [0]
    return ((int(labels[a]), a, z) for a, z in zip(edges[:-1], edges[1:], strict=True))


def bucketed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False, least: int = 1 << 22, most: int = 1 << 24) -> tuple[DataFrame, int, int]:
    """(doc_id, text, bucket), the number of buckets, and the bytes of all texts.

    With carry, the other columns of the input stand in a struct, rest. A bucket holds about
    `least` to `most` bytes of text. It is drawn by id and text, so rows without an id, or many
    texts of one id, spread over the buckets.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    size = int(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    n = max(1, -(-size // most), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // least))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n, size


def text_blocks(texts: pa.ChunkedArray, most: int = BLOCK_BYTES):
    """(rows, texts) of consecutive blocks of a column."""
    flat = pa.concat_arrays([c.cast(pa.large_binary()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.large_binary())
    total = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(flat), 0), dtype=np.int64))])
    lo = 0
    while lo < len(flat):
        hi = min(len(flat), max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1))
        yield slice(lo, hi), flat.slice(lo, hi - lo)
        lo = hi
