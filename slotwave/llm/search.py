"""Ranked lexical search over a length-stratified index.

A document's score depends on its length through one whole number, the normaliser m, only.
Documents are dealt into ranges of m; inside a range those of one m form a stratum, and the
postings of a term stand by stratum and by tf. An impact is computed once for each (m, tf) and
holds for all postings there. The largest impact of a query's terms in a stratum bounds the score
of its documents: strata are visited from the highest bound on, and those whose bound cannot
reach the ranks any more are left out. Nothing else is: results are those of scoring every
document.

Queries are taken in blocks of bounded size, each a broadcast of its terms; a task returns at
most k documents for each query, and these are ranked by query.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Words, blocks, ranges, release, stored, word_hashes

#: Bytes between terms: all of ASCII but digits and letters.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:0x80] = True
for _a, _z in (b"09", b"AZ", b"az"):
    SEPARATORS[_a : _z + 1] = False
#: Bytes of query texts that one broadcast stands for, unless a single text is longer.
BLOCK_QUERIES = 1 << 23
#: Documents that a task ranks, about.
TASK_DOCS = 1 << 15
#: Postings that are held as arrays at once, unless a single document has more.
HELD = 1 << 21
#: The largest impact of a posting of weight 1.
UNIT = 1_000_000
#: Sums below are exact in doubles.
EXACT = float(1 << 53)

_DOCS = "doc_id long, n long, terms array<int>, tfs array<long>"
_FOUND = "query int, doc_id long, score long"


class Queries:
    """Query texts as terms: distinct terms in order of their hash, and for each query its terms and their numbers."""

    def __init__(self, texts: list[str | None]):
        w = Words(pa.array(texts, pa.large_string()), lower=True, separators=SEPARATORS)
        h = w.hashes()
        self.h0, first, at = np.unique(h, return_index=True, return_inverse=True)
        self.h1 = word_hashes(w.data, w.starts[first], w.ends[first], 1)
        pairs, times = np.unique(w.text * (len(self.h0) + 1) + at, return_counts=True)
        query, term = np.divmod(pairs, len(self.h0) + 1)
        cuts = np.searchsorted(query, np.arange(len(texts) + 1))
        self.terms = [(term[a:z], times[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]

    def among(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of each word of a block that is a term of some query."""
        if not len(self.h0) or not len(w.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.h0, h), len(self.h0) - 1)
        mine = np.flatnonzero(self.h0[at] == h)
        same = word_hashes(w.data, w.starts[mine], w.ends[mine], 1) == self.h1[at[mine]]
        return w.text[mine[same]], at[mine[same]]


def _lists(cuts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _documents(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                w = Words(part["text"], lower=True, separators=SEPARATORS)
                text, term = shared.value.among(w)
                width = len(shared.value.h0) + 1
                pairs, tf = np.unique(text * width + term, return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(w.n + 1) * width)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(w.counts, pa.int64()), _lists(cuts, pairs % width, pa.int32()), _lists(cuts, tf, pa.int64())], names=["doc_id", "n", "terms", "tfs"])
            release()

    return run


def _held_by(width: int):
    """Documents of a task's share that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(batch["terms"].flatten().to_numpy(), minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "df"])

    return run


def _sums(at: np.ndarray, values: np.ndarray, n: int, exact: bool) -> np.ndarray:
    """Sum of the whole numbers named by each of n places."""
    if exact:
        return np.bincount(at, weights=values, minlength=n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


class Strata:
    """The index of a run of documents in order of m: postings by term, stratum and tf."""

    def __init__(self, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, width: int):
        new = np.append(True, m[1:] != m[:-1])
        stratum = np.cumsum(new) - 1  # of each document
        self.n_docs, self.n = len(m), int(new.sum())
        self.first = np.append(np.flatnonzero(new), len(m))
        doc = np.repeat(np.arange(len(m)), sizes)
        cell = terms.astype(np.int64) * self.n + stratum[doc]
        order = np.lexsort((tfs, cell))
        self.doc, cell, tf = doc[order], cell[order], tfs[order]
        # one impact for each (m, tf)
        values, at = np.unique(np.stack([m[self.doc], tf]), axis=1, return_inverse=True)
        self.impact = ((1000 * UNIT * values[1]) // (1000 * values[1] + 8 * values[0]))[at.ravel()]
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.begin, self.end = begin, np.append(begin[1:], len(cell))
        self.top = self.impact[self.end - 1]  # impacts rise with tf
        self.stratum = cell[begin] % self.n
        self.cells = np.searchsorted(cell[begin] // self.n, np.arange(width + 1))

    def visit(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a query that may be among its k best; documents below `least` may be left out."""
        cells = ranges(self.cells[terms], self.cells[terms + 1])
        if not len(cells):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        weight = np.repeat(weights, self.cells[terms + 1] - self.cells[terms])
        exact = float(weights.sum()) * UNIT < EXACT
        bound = _sums(self.stratum[cells], weight * self.top[cells], self.n, exact)
        order = np.argsort(-bound, kind="stable")
        # a few strata first, whose scores may rule out others, then four times as many, ...
        scores, done, wave, least = np.zeros(self.n_docs, np.int64), 0, max(1, self.n // 16), max(least, 1)
        while done < self.n and bound[order[done]] >= least:
            now = order[done : done + wave]
            chosen = np.zeros(self.n, bool)
            chosen[now[bound[now] >= least]] = True
            mine = chosen[self.stratum[cells]]
            begin, end = self.begin[cells[mine]], self.end[cells[mine]]
            at = ranges(begin, end)
            scores += _sums(self.doc[at], np.repeat(weight[mine], end - begin) * self.impact[at], self.n_docs, exact)
            done, wave = done + wave, 4 * wave
            if done < self.n and self.n_docs > k:
                least = max(least, int(np.partition(scores, -k)[-k]))
        found = np.flatnonzero(scores >= least)
        return found, scores[found]


def _best(score: np.ndarray, doc: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, highest score first, then smallest id, rows without an id last."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return at[np.lexsort((doc[at], ~known[at], -score[at]))[:k]]
    return np.lexsort((doc, ~known, -score))[:k]


def _ranked(shared, k: int):
    """The k best documents of a task's share for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries.terms)
        for batch in batches:
            sizes = np.diff(batch["terms"].offsets.to_numpy())
            total = np.cumsum(sizes)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HELD, "right")))
                part = batch.slice(lo, hi - lo)
                ids, known = part["doc_id"].fill_null(0).to_numpy(), part["doc_id"].is_valid().to_numpy(zero_copy_only=False)
                index = Strata(part["m"].to_numpy(), part["terms"].flatten().to_numpy(), part["tfs"].flatten().to_numpy(), sizes[lo:hi], len(queries.h0))
                for q, (terms, times) in enumerate(queries.terms):
                    score, doc, there = found[q]
                    at, new = index.visit(terms, times * weight[terms], int(score[-1]) if len(score) == k else 1, k)
                    if len(at):
                        score, doc, there = np.append(score, new), np.append(doc, ids[at]), np.append(there, known[at])
                        best = _best(score, doc, there, k)
                        found[q] = score[best], doc[best], there[best]
                lo = hi
            release()
        query = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found])
        score, doc, known = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc, pa.int64(), mask=~known.astype(bool)), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    return run


def _block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """(query, rank, doc_id, score) of a block of query texts, numbered from 0."""
    spark, queries = docs.sparkSession, Queries(texts)
    width = len(queries.h0)
    rows = stored(docs.mapInArrow(_documents(spark.sparkContext.broadcast(queries)), _DOCS), "search-documents")
    total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"), F.count_if(F.size("terms") > 0).alias("held")).first()
    held = rows.mapInArrow(_held_by(width), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the block
    weight = np.zeros(width, np.int64)
    for t, df in zip(held["term"].to_pylist(), held["df"].to_pylist(), strict=True):
        weight[t] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df + 1)))
    parts = max(-(-total.held // TASK_DOCS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total.held // 1024), 1)
    m = F.lit(25).cast("long") + F.expr(f"(75 * n * {total.docs}L) div {max(total.terms or 0, 1)}L")
    # the second key splits a stratum that holds many documents
    strata = rows.where(F.size("terms") > 0).withColumn("m", m).withColumn("deal", F.xxhash64("doc_id", "terms")).repartitionByRange(parts, "m", "deal").sortWithinPartitions("m").drop("deal", "n")
    found = strata.mapInArrow(_ranked(spark.sparkContext.broadcast((queries, weight)), k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_QUERIES) -> DataFrame:
    """The k best documents of each item with a score above 0: item id, rank (from 1), doc_id, score.

    Equal scores stand in order of doc_id, documents without an id last. Null and empty texts have
    no terms: such documents count nowhere and are never found, such items find nothing. Repeated
    documents count each by itself, so an id may be found twice; items of equal text get equal
    results each, as do items without or with equal ids. An empty table on either side gives no
    rows; further columns of both, whatever their names, are ignored. Terms are told apart by 128
    bits of hash. A text of any length is read whole.

    The driver and the broadcasts hold one block of query texts, about block_bytes (a text longer
    than that is a block of its own); each further block is another pass over the documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    texts = stored(wanted.select("text").distinct(), "search-queries")
    size = int(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    n, out = -(-size // block_bytes), []
    for b in range(n):
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).toArrow()["text"].to_pylist()
        names = docs.sparkSession.createDataFrame(pa.table({"query": pa.array(range(len(mine)), pa.int32()), "text": pa.array(mine, pa.string())}))
        out.append(_block(rows, mine, k).join(names, "query").select("text", "rank", "doc_id", "score"))
    if not out:
        return wanted.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return wanted.join(functools.reduce(DataFrame.unionAll, out), "text").select("item_id", "rank", "doc_id", "score")
