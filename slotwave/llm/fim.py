"""Fill-in-middle transformation as a pipeline of pyarrow compute functions.

A block of texts becomes one list array of units (code points, or words with the white space
after them) over the bytes of the block. The lists are flattened with the index of each
unit's parent, the ordinal of a unit in its text gives its role (prefix, middle or suffix), the
units of a role are filtered and put into lists again, and binary_join turns these into pieces
that are joined with the sentinels. A text longer than a block goes through as several lists, so
that the arrays of units never hold more than a block; only its pieces are as long as itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import BLOCK_BYTES, blocks, release

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("chars", "words")
_NOTHING = pa.scalar(b"", pa.large_binary())
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _starts(data: np.ndarray, unit: str) -> pa.Array:
    """Whether a unit may start at each byte of a block."""
    b = pa.array(data)
    if unit == "chars":
        return pc.not_equal(pc.bit_wise_and(b, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
    space = pc.is_in(b, pa.array([0x20, *range(0x09, 0x0E)], pa.uint8()))
    before = pa.concat_arrays([pa.array([False]), space.slice(0, len(space) - 1)]) if len(space) else space
    return pc.and_not(before, space)


def _lists(data: np.ndarray, lead: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Consecutive byte ranges, cut at `cuts`, as lists of units."""
    at = np.flatnonzero(lead[cuts[0] : cuts[-1]]) + cuts[0]
    offsets = np.append(at, cuts[-1]).astype(np.int64) - cuts[0]
    units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[cuts[0] : cuts[-1]])])
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(at, cuts), pa.int64()), units)


def _pieces(lists: pa.Array, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each list; first is the ordinal of its first unit in its text, low and high are the text's cuts."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    shift = pc.subtract(pa.array(first), lists.offsets.slice(0, len(lists)))
    ordinal = pc.add(pa.array(np.arange(len(flat))), pc.take(shift, parent))
    role = pc.add(*(pc.cast(pc.greater_equal(ordinal, pc.take(pa.array(x), parent)), pa.int8()) for x in (low, high)))
    out = []
    for r in range(3):
        mine = pc.equal(role, pa.scalar(r, pa.int8()))
        ends = np.searchsorted(pc.filter(parent, mine).to_numpy(), np.arange(len(lists) + 1))
        out.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pc.filter(flat, mine)), _NOTHING))
    return out


def _cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of units of each text, and its prefix, middle and suffix."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    lead = _starts(data, unit).to_numpy(zero_copy_only=False).copy()
    lead[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    total = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(lead, False), bounds[:-1]) * (bounds[1:] > bounds[:-1]))])
    n = np.diff(total)
    one, two = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    if len(data) <= BLOCK_BYTES:
        return n, _pieces(_lists(data, lead, bounds), np.zeros(len(n), np.int64), low, high)
    # a single long text: lists of about a block each
    cuts, parts, seen = [0], [], 0
    while cuts[-1] < len(data):
        goal = cuts[-1] + BLOCK_BYTES
        cuts.append(min(goal + int(np.argmax(np.append(lead[goal : goal + BLOCK_BYTES], True))), len(data)) if goal < len(data) else len(data))
        some = _lists(data, lead, np.array(cuts[-2:]))
        parts.append(_pieces(some, np.array([seen]), low, high))
        seen += len(some.values)
    return n, [pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(parts)], pa.int64()), pa.concat_arrays([p[r] for p in parts])), _NOTHING) for r in range(3)]


def _joined(pieces: list[pa.Array], *order: bytes | int) -> pa.Array:
    return pc.binary_join_element_wise(*[pieces[x] if isinstance(x, int) else pa.scalar(x, pa.large_binary()) for x in order], _NOTHING)


def _check(sentinels: tuple[str, str, str], unit: str) -> None:
    """Sentinels must not overlap, or a piece that ends like the start of one could hide where it stands."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    if not all(sentinels) or len(set(sentinels)) < 3 or any(a.endswith(b[:k]) for a in sentinels for b in sentinels for k in range(1, len(b) + (a != b)) if k <= len(a)) or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("sentinels must differ, and no end of one may start another or itself")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, unit: str = "chars", fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """One row per input row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points) and output.

    The first eight-digit groups of the sha256 of seed, a colon and the id decide: two of them
    are the cuts, the third whether the text stays plain, the fourth the order of the pieces.
    Null texts count as empty ones; these, and texts that hold a sentinel, stay plain (chars are
    null). Rows with equal ids are cut at the same hashes, rows without an id draw from the word
    null, so equal rows give equal rows; an empty table gives none. A text of any length is cut
    whole. Further columns of the input, whatever their names, are ignored.
    """
    _check(sentinels, unit)
    p, s, m = (x.encode() for x in sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", *[F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                h1, h2, h3, h4 = (part[f"h{i}"].to_numpy() for i in range(1, 5))
                text = part["text"].cast(pa.large_binary())
                n, pieces = _cut(part["text"], h1, h2, unit)
                plain = pa.array((n == 0) | (h3 % 100 >= fim_percent))
                for x in (p, s, m):
                    plain = pc.or_(plain, pc.match_substring(text, x))
                form = pc.if_else(plain, "plain", pc.if_else(pa.array(h4 % 100 < spm_percent), "spm", "psm"))
                output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "spm"), _joined(pieces, s, 2, p, 0, m, 1), _joined(pieces, p, 0, s, 2, m, 1)))
                chars = [pc.if_else(plain, None, pc.cast(pc.utf8_length(pieces[k].cast(pa.large_string())), pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), form, *chars, output.cast(pa.large_string()).cast(pa.string())], names=[c.split()[0] for c in _OUT.split(", ")])
            release()

    return rows.mapInArrow(run, _OUT)


def _halves(x: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first mark."""
    both = pc.split_pattern(x, mark, max_splits=1)
    return pc.list_element(both, 0), pc.list_element(both, 1)


def _text(form: str, output: pa.Array, sentinels: tuple[str, str, str]) -> pa.Array:
    p, s, m = sentinels
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = _halves(_halves(output, first)[1], second)
    two, middle = _halves(rest, m)
    return pc.binary_join_element_wise(*((one, middle, two) if form == "psm" else (two, middle, one)), "")


def restore(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """rows (form, output and any other columns) with `restored`, the exact text that a row was made from.

    Nothing but form and output is used. Null outputs give null; a column named restored is
    replaced.
    """
    _check(sentinels, "chars")
    keep = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "restored"])
    schema = StructType([*keep.schema, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "output"):
                restored = pa.nulls(part.num_rows, pa.string())
                for form in ("plain", "psm", "spm"):
                    mine = pc.fill_null(pc.equal(part["form"], form), False)
                    restored = pc.replace_with_mask(restored, mine, _text(form, pc.filter(part["output"], mine), sentinels))
                yield pa.RecordBatch.from_arrays([*part.columns, restored], names=schema.names)

    return keep.mapInArrow(run, schema)
