"""Substring deduplication with a count-min prefilter.

A window is `width` consecutive words of one document. Each bucket of documents sketches its
windows: every row of the sketch is a list of the cells that its windows fall into, each with
a count of one or more. Slices of cells are merged over all buckets, which gives the count-min
sketch of the corpus; a window whose smallest merged count is one cannot repeat, so only the
others are grouped exactly, by 128 bits of hash (of each word, and of the order of the words;
two different windows among 10**14 share them with probability below 10**-10). Estimates are never too small: no repeated
window is lost, whatever the width of the sketch.

Sketches and windows travel packed, one row for each bucket and slice that has any of its
windows (never more rows than cells or windows, however many slices there are), and each bucket
gets back only what concerns it. Documents meet their bucket's answers by one shuffle that Spark
reuses, and a window in very many documents costs each bucket one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .shared import Words, bucketed, mix64, pack, runs, text_blocks, tidy, unpack

U = np.uint64
ROWS = 2
#: Text of a bucket, whose windows one task holds as arrays (some 25 times as large).
BUCKET_BYTES = 1 << 23
OUT = "doc_id long, n_words long, n_removed long, kept string"


def _sorted_by_id(t: pa.Table) -> pa.Table:
    """Rows in order of id (null last) and text: the order that decides which window is the earlier one."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def _grouped(h0: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal pairs together, earlier places first; whether each place of it repeats the one before)."""
    order = np.argsort(h0, kind="stable")
    a, b = h0[order], h1[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h1, h0))
        a, b = h0[order], h1[order]
    again = np.zeros(len(h0), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, again


def _among(h0: np.ndarray, h1: np.ndarray, g0: np.ndarray, g1: np.ndarray) -> np.ndarray:
    """Which pairs (h0, h1) are among the pairs (g0, g1)."""
    if not len(g0):
        return np.zeros(len(h0), bool)
    order = np.lexsort((g1, g0))
    g0, g1 = g0[order], g1[order]
    at = np.minimum(np.searchsorted(g0, h0), len(g0) - 1)
    found = (g0[at] == h0) & (g1[at] == h1)
    for i in np.flatnonzero(g0[1:] == g0[:-1]) + 1:  # pairs that share a first hash
        found |= (h0 == g0[i]) & (h1 == g1[i])
    return found


def _windows(t: pa.Table, width: int) -> Iterator[tuple[slice, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words, first word of each window, and two hashes of it) by block."""
    for rows, texts in text_blocks(t["text"]):
        w = Words(texts)
        at, h0 = w.windows(width, 0)
        yield rows, w, at, h0, w.windows(width, 1)[1]


def _hashes(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes and the row of each window of a bucket, in order."""
    found = [(h0, h1, rows.start + w.text[at]) for rows, w, at, h0, h1 in _windows(t, width)]
    if not found:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    h0, h1, row = (np.concatenate(x) for x in zip(*found, strict=True))
    return h0, h1, row


def _cells(h0: np.ndarray, h1: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Cell of each window, one row of the sketch after the other."""
    return (mix64(h0 + U(r) * h1) >> U(64 - bits) for r in range(ROWS))


def _slices(x: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Slice of each number of so many bits: equal ranges of the numbers' first 32 bits, in order."""
    first = x >> U(max(bits - 32, 0))
    return first * U(parts) >> U(min(bits, 32))


def _sketch(width: int, bits: int, parts: int):
    def run(t: pa.Table) -> pa.Table:
        h0, h1, _ = _hashes(t, width)
        bucket, out = t["bucket"][0].as_py(), []
        for r, cells in enumerate(_cells(h0, h1, bits)):
            cells, n = np.unique(cells, return_counts=True)
            for p, a, z in runs(_slices(cells, bits, parts)):
                mine = slice(a, z)
                out.append((r * parts + p, bucket, pack(cells[mine], True), np.packbits(n[mine] > 1).tobytes()))
        return _table(out, ("slice", "bucket", "cells", "many"))

    return tidy(run)


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = [pa.int32() if n in ("slice", "bucket") else pa.binary() for n in names]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def _merge(t: pa.Table) -> pa.Table:
    """A slice of the corpus's sketch; each bucket hears which of its cells count more than one."""
    cells = [unpack(x, True) for x in t["cells"].to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool) for x, c in zip(t["many"].to_pylist(), cells, strict=True)]
    u, at, n = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    repeated = n > 1
    repeated[at[np.concatenate(many)]] = True
    said = np.split(repeated[at], np.cumsum([len(c) for c in cells])[:-1])
    return pa.table([t["slice"], t["bucket"], pa.array([np.packbits(x).tobytes() for x in said], pa.binary())], names=["slice", "bucket", "said"])


def _suspects(width: int, bits: int, parts: int):
    """First occurrences in a bucket of the windows whose estimate is above one, packed by slice of the hash."""

    def run(t: pa.Table, said: pa.Table) -> pa.Table:
        t = _sorted_by_id(t)
        h0, h1, row = _hashes(t, width)
        answer = dict(zip(said["slice"].to_pylist(), said["said"].to_pylist(), strict=True))
        doubtful = np.ones(len(h0), bool)
        for r, cells in enumerate(_cells(h0, h1, bits)):
            u, at = np.unique(cells, return_inverse=True)
            flags = np.zeros(len(u), bool)
            for p, a, z in runs(_slices(u, bits, parts)):
                flags[a:z] = np.unpackbits(np.frombuffer(answer[r * parts + p], np.uint8), count=z - a)
            doubtful &= flags[at]
            del u, at, cells
        at = np.flatnonzero(doubtful)
        order, again = _grouped(h0[at], h1[at])
        at = at[order[~again]]  # sorted by h0
        ids, bucket, out = t["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy(), t["bucket"][0].as_py(), []
        for p, a, z in runs(_slices(h0[at], 64, parts)):
            mine = at[a:z]
            # ids shifted to be unsigned, order kept
            out.append((p, bucket, pack(h0[mine], True), pack(h1[mine]), pack(ids[row[mine]].view(U) ^ U(1 << 63))))
        return _table(out, ("slice", "bucket", "h0", "h1", "ids"))

    return tidy(run, 2)


def _decide(t: pa.Table) -> pa.Table:
    """Exact groups of a slice: each bucket hears which of its windows start in an earlier document elsewhere."""
    t = t.sort_by("bucket")  # texts of one id in different buckets stand in order of these
    parts = [tuple(unpack(x, rising) for x, rising in zip(xs, (True, False, False), strict=True)) for xs in zip(t["h0"].to_pylist(), t["h1"].to_pylist(), t["ids"].to_pylist(), strict=True)]
    h0, h1, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    by_id = np.argsort(ids, kind="stable")
    order, again = _grouped(h0[by_id], h1[by_id])
    late = np.zeros(len(h0), bool)
    late[by_id[order]] = again
    cuts = np.cumsum([0, *[len(p[0]) for p in parts]])
    out = [(b, pack(h0[a:z][late[a:z]], True), pack(h1[a:z][late[a:z]])) for b, a, z in zip(t["bucket"].to_pylist(), cuts[:-1], cuts[1:], strict=True)]
    return _table(out, ("bucket", "h0", "h1"))


def _remove(width: int, digest: bool, layout: bool):
    def run(t: pa.Table, late: pa.Table) -> pa.Table:
        t = _sorted_by_id(t)
        g0, g1 = (np.concatenate([unpack(x, k == "h0") for x in late[k].to_pylist()] or [np.zeros(0, U)]) for k in ("h0", "h1"))
        h0, h1, _ = _hashes(t, width)
        order, again = _grouped(h0, h1)
        removed = _among(h0, h1, g0, g1)
        removed[order] |= again
        counts, cut, kept, done = [], [], [], 0
        for _, w, at, _, _ in _windows(t, width):
            bad = at[removed[done : done + len(at)]]
            done += len(at)
            edge = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(edge, bad, 1)
            np.add.at(edge, bad + width, -1)
            gone_words = np.cumsum(edge[:-1]) > 0
            counts.append(w.counts)
            cut.append(np.bincount(w.text[gone_words], minlength=w.n))
            for i in range(w.n):
                a, z = w.first[i], w.first[i + 1]
                text = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                words = text.split()
                if cut[-1][i]:
                    words = [x for x, g in zip(words, gone_words[a:z].tolist(), strict=True) if not g]
                if cut[-1][i] or not layout:
                    text = b" ".join(words)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        columns = {"doc_id": t["doc_id"], "n_words": pa.array(np.concatenate(counts), pa.int64()), "n_removed": pa.array(np.concatenate(cut), pa.int64()), "kept": pa.array(kept, pa.string())}
        if "rest" in t.column_names:
            columns["rest"] = t["rest"]
        return pa.table(columns)

    return tidy(run, 2)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, digest: bool = False, carry: bool = False, layout: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window that covers it occurs earlier: in a document of smaller id, or
    earlier in the same document. Windows are judged on the input. With digest, kept is the
    sha256 of the words left; with layout, texts that lose nothing keep their white space; with
    carry, the struct `rest` holds the other columns. Null and empty texts have no words; texts shorter than a window
    lose none. Rows with equal ids stand in a fixed order of their texts (by bucket, then by
    text), so of fully equal rows one keeps its words; null ids come last. An empty table gives no
    rows; further columns of the input may have any names.

    A task holds one bucket of bucket_bytes of text. Exchanges have at most one row for each pair
    of bucket and slice, and at most one for each distinct window of a bucket: the first grows as
    the square of the corpus up to some TB, the second in proportion.
    """
    rows, parts, size = bucketed(docs, id_col, text_col, carry, most=bucket_bytes)
    bits = max(16, int(4 * size / 6).bit_length())  # some four cells a word
    by = rows.groupBy("bucket")
    sketches = by.applyInArrow(_sketch(width, bits, parts), "slice int, bucket int, cells binary, many binary")
    said = sketches.groupBy("slice").applyInArrow(_merge, "slice int, bucket int, said binary")
    windows = by.cogroup(said.groupBy("bucket")).applyInArrow(_suspects(width, bits, parts), "slice int, bucket int, h0 binary, h1 binary, ids binary")
    late = windows.groupBy("slice").applyInArrow(_decide, "bucket int, h0 binary, h1 binary")
    schema = StructType.fromDDL(OUT)
    if carry:
        schema = schema.add(rows.schema["rest"])
    return by.cogroup(late.groupBy("bucket")).applyInArrow(_remove(width, digest, layout), schema)
