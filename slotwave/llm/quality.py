"""Quality rules by cross-document line frequency.

Each document's lines are normalised (lower case, digits to 0, words joined by one space) and
hashed. The distinct documents that hold a line are counted per host; a line in more than
`max_docs` of them is boilerplate and is removed, and a document that keeps too little is
rejected. Two refinements, off unless asked for, spare clean text among many copies: documents
that consist of the same lines count once, and the first document of a host that holds a line
keeps it, so a group of copies never loses its last member to its own copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import Words, blocks, mix64, per_text, release, source_key, stored

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODE_POINT = np.ones(256, bool)
_CODE_POINT[0x80:0xC0] = False
_FACTS = "doc_id long, host string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>, content long"


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often the key of each place occurs, whether the place is the first of its key)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(keys)))
    times, first = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    times[order] = np.repeat(counts, counts)
    first[order] = new
    return times, first


class Lines:
    """Lines with a word of a block of texts: text, number of words, bounds without the newline, first word."""

    def __init__(self, w: Words):
        starts = np.unique(np.concatenate([w.offsets[:-1], np.flatnonzero(w.data == 0x0A) + 1]))
        line = np.searchsorted(starts, w.starts, "right") - 1  # of each word
        self.heads = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        self.words = np.diff(np.append(self.heads, len(line)))
        at = line[self.heads]
        self.starts, ends = starts[at], np.append(starts[1:], len(w.data))[at]
        self.ends = ends - (w.data[ends - 1] == 0x0A)
        self.text = w.text[self.heads]

    def normal(self, hashes: np.ndarray) -> np.ndarray:
        """A hash of each line's words (given theirs) and their places."""
        if not len(self.heads):
            return np.zeros(0, np.uint64)
        place = np.arange(len(hashes)) - np.repeat(self.heads, self.words)
        return mix64(np.add.reduceat(mix64(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), self.heads))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        release()
        for part in blocks(batch, "text"):
            w = Words(part["text"])
            chars, symbols = (np.concatenate([[0], np.cumsum(x)]) for x in (~w.space & _CODE_POINT[w.data], _SYMBOL[w.data]))
            own = mix64(w.text.astype(np.uint64) + np.uint64(1))
            at, grams = w.windows(3)
            again = at[_runs(grams ^ own[at])[0] > 1] if len(at) else at
            covered = np.zeros(len(w.starts), bool)
            for k in range(3):
                covered[again + k] = True
            lines, raw = Lines(w), w.data.tobytes()
            whole = np.array([xxhash.xxh64_intdigest(raw[a:z], 42) for a, z in zip(lines.starts.tolist(), lines.ends.tolist(), strict=True)], np.uint64)
            dup = ~_runs(whole ^ mix64(lines.text.astype(np.uint64) + np.uint64(1)))[1] if len(whole) else np.zeros(0, bool)
            w.data = _LOWER[w.data]
            normal = lines.normal(w.hashes())
            cuts = np.searchsorted(lines.text, np.arange(w.n + 1)).astype(np.int32)
            content = mix64(per_sum(lines.text, mix64(normal), w.n))
            lists = lambda x, kind, c=cuts: pa.ListArray.from_arrays(c, pa.array(x, kind))
            counts = [w.counts, *(np.diff(x[w.offsets]) for x in (chars, symbols)), per_text(lines.text[dup], w.n), per_text(w.text[covered], w.n)]
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in ("doc_id", "host", "th")), *(pa.array(x, pa.int64()) for x in counts), lists(normal.view(np.int64), pa.int64()), lists(lines.words.astype(np.int32), pa.int32()), pa.array(content.view(np.int64))],
                names=[x.split()[0] for x in _FACTS.split(", ")],
            )


def per_sum(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2**64 of the values named by each of n places."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, at, values)
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 50, min_left: float = 0.3, min_words: int = 50, max_repeat: float = 0.5, by_content: bool = False, first_keeps: bool = False) -> DataFrame:
    """One row per input row with its counts, n_line_words_removed, base_failed and kept.

    base_failed: under min_words words, or over max_repeat of the words in repeated 3-word
    windows. kept: not base_failed, and at least min_left of the words are left without the
    lines that more than max_docs distinct documents of the host hold. Two refinements are off
    unless asked for: by_content counts documents of the same lines once, and with first_keeps
    the smallest id that holds a line keeps it.

    Null and empty texts have no words and fail; a null host is a host of its own. Rows with
    equal ids count as one document for a line but are judged each by its own text; rows without
    an id count as a document for each different text. Fully equal rows get equal verdicts. An
    empty table gives no rows; further columns of the input, whatever their names, are ignored.
    """
    facts, lost = _judge(docs, id_col, text_col, host_col, max_docs, by_content, first_keeps)
    return _verdicts(facts, lost, min_left, min_words, max_repeat).drop("host", "th")


#: What tells the rows of a corpus apart; rows that agree in it share a verdict.
_ROW = ["doc_id", "host", "th"]
#: A line that holds more than 1 / HOT of all lines is joined by a broadcast: there are fewer than HOT of them.
HOT = 1000


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["host"] == b["host"]) & (a["th"] == b["th"])


def _judge(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int, by_content: bool, first_keeps: bool) -> tuple[DataFrame, DataFrame]:
    """Facts of each row, and the lines above the limit: row, words of such lines, their hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), source_key(host_col).alias("host")).withColumn("th", F.xxhash64("text"))
    facts = stored(rows.mapInArrow(_facts, _FACTS), "quality-facts")
    document = F.col("content") if by_content else F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(0), "doc_id")).otherwise(F.xxhash64(F.lit(1), "th"))
    lines = facts.where("size(lines) > 0").select(*_ROW, document.alias("document"), F.posexplode(F.arrays_zip("lines", "line_words")).alias("nth", "l")).select(*_ROW, "document", "nth", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    holders = lines.groupBy("host", "line", "document").agg(F.min("doc_id").alias("doc_id"))
    often = holders.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first")).where(F.col("n_docs") > max_docs)
    rows = lines.groupBy("host", "line").agg(F.count("*").alias("n_rows"))
    often = stored(often.join(rows, ["host", "line"]), "quality-often")
    n = facts.agg(F.coalesce(F.sum(F.size("lines").cast("long")), F.lit(0))).first()[0]
    hot = F.col("n_rows") * HOT > n
    named = lines.join(F.broadcast(often.where(hot)), ["host", "line"]).unionByName(lines.join(often.where(~hot), ["host", "line"]))
    lost = named.drop("n_docs", "n_rows")
    if first_keeps:
        lost = lost.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    # fully equal rows name each line once
    lost = lost.groupBy(*_ROW, "nth").agg(F.first("words").alias("words"), F.first("line").alias("line"))
    return facts, stored(lost.groupBy(*_ROW).agg(F.sum("words").alias("n_line_words_removed"), F.collect_set("line").alias("gone")), "quality-lines")


def _verdicts(facts: DataFrame, lost: DataFrame, min_left: float, min_words: int, max_repeat: float) -> DataFrame:
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    found = facts.drop("lines", "line_words", "content")
    return (
        found.join(lost, _same_row(found, lost), "left")
        .select(*[found[c] for c in found.columns], F.coalesce("n_line_words_removed", F.lit(0)).alias("n_line_words_removed"))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words_removed") >= F.lit(min_left) * F.col("n_words")))
    )


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text without the lines whose normalised words have one of the hashes in `gone`."""
    for batch in batches:
        for part in blocks(batch, "text"):
            texts, gone = part["text"].to_pylist(), part["gone"].to_pylist()
            for i in [i for i, g in enumerate(gone) if g and texts[i]]:
                lines = texts[i].split("\n")
                w = Words(pa.array(lines, pa.string()))
                w.data = _LOWER[w.data]
                found = Lines(w)
                bad = set(found.text[np.isin(found.normal(w.hashes()).view(np.int64), gone[i])].tolist())
                texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in bad)
            yield pa.RecordBatch.from_arrays([part["row"], pa.array(texts, pa.string())], names=["row", "text"])
        release()


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 50, min_left: float = 0.3, min_words: int = 50, max_repeat: float = 0.5, by_content: bool = False, first_keeps: bool = False) -> DataFrame:
    """The rows that quality() keeps, without the lines it removes; the input's columns.

    Rows without an id and rows of one id are judged each by itself, as there. Columns of the
    input may have any names.
    """
    facts, lost = _judge(docs, id_col, text_col, host_col, max_docs, by_content, first_keeps)
    verdicts = _verdicts(facts, lost, min_left, min_words, max_repeat)
    rejected = verdicts.where("not kept").select(*_ROW, F.lit(True).alias("rejected"), F.lit(None).cast("array<long>").alias("gone"))
    marks = rejected.unionByName(lost.select(*_ROW, F.lit(None).cast("boolean").alias("rejected"), "gone"))
    marks = stored(marks.groupBy(*_ROW).agg(F.bool_or("rejected").alias("rejected"), F.first("gone", ignorenulls=True).alias("gone")), "quality-marks")
    inner = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), source_key(host_col).alias("host"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    # one exchange of the texts at every size of the corpus
    left = inner.join(marks.hint("merge"), _same_row(inner, marks), "left").where("rejected is null").select("row", "text", "gone")
    out = left.mapInArrow(_without_lines, StructType([inner.schema["row"], StructField("text", StringType())]))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
