"""Context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words joined by one space and closed by a newline. Each byte is
decided in eight binary steps; the node of a step is the context (the last d bytes, d from 0
to `depth`) and the bits already known. Each node has a Krichevsky-Trofimov estimate from its
counts in the training texts, and the weighted probability of a node is half its estimate plus
half the product over its longer contexts. After training, a byte's probability mixes the
estimates of all depths with the weights that the training texts give them; a context not
met in training takes no part. The score of a text is the log10 of that, so the code length
is score / log10(1/2) bits.

What the corpus yields grows with it: every bucket of documents sends each distinct string of
depth + 1 bytes, and each distinct token, once; totals are made by key, contexts that share
their last three bytes are worked out together, and each bucket gets back the values it asked
for. Keys travel packed, one row for each bucket and part that has any of its keys: never more
rows than keys, however many parts there are. Only nodes of at most two bytes of context are broadcast (65,793 contexts of 255 nodes at
most, whatever the corpus).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, bucketed, mix64, pack, runs, stored, text_blocks, tidy, unpack

TOP = 2
U = np.uint64
#: Key of the end token.
END = U(1)
_LOG_HALF = np.log(0.5)
_SMALL = 1 << 12
_LG_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_LG_ONE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; used above _SMALL only, where it is exact to double precision."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""

    def part(n: np.ndarray, table: np.ndarray, shift: float, start: float) -> np.ndarray:
        small = n < _SMALL
        return np.where(small, table[np.where(small, n, 0)], _log_gamma(np.maximum(n, _SMALL) + shift) - start)

    half = 0.5 * np.log(np.pi)  # log gamma(1/2)
    return part(n0, _LG_HALF, 0.5, half) + part(n1, _LG_HALF, 0.5, half) - part(n0 + n1, _LG_ONE, 1.0, 0.0)


class Level:
    """Nodes of one context length: sorted keys (context << 8 | known bits), counts, log of the weighted probability."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        own = kt_log(n0, n1)
        self.weighted = own if below is None else np.logaddexp(_LOG_HALF + own, _LOG_HALF + below)
        #: What is left of a node's weight for its own estimate.
        self.stay = np.ones(len(keys)) if below is None else np.exp(_LOG_HALF + own - self.weighted)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the node was met in training) of each key."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return at, np.zeros(len(keys), bool)
        return at, (self.keys[at] == keys) & (self.n0[at] + self.n1[at] > 0)


def _steps(grams: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node key, bit) of the eight steps of each gram's last byte, with d bytes of context."""
    byte = grams & U(255)
    context = (grams >> U(8)) & U((1 << 8 * d) - 1)
    for j in range(8):
        yield context << U(8) | U(1 << j) | byte >> U(8 - j), (byte >> U(7 - j)) & U(1)


def parent(keys: np.ndarray, d: int) -> np.ndarray:
    """Keys at depth d of nodes at depth d + 1: the oldest byte goes."""
    return ((keys >> U(8)) & U((1 << 8 * d) - 1)) << U(8) | keys & U(255)


def deep_levels(grams: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """Levels TOP + 1 to depth of the grams' trees, deepest first."""
    out: list[Level] = []
    seen = counts > 0
    grams, counts = grams[seen], counts[seen]
    for d in range(depth, TOP, -1):
        keys, bits = (np.concatenate(x) for x in zip(*_steps(grams, d), strict=True))
        nodes, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, np.tile(counts, 8), len(nodes)).astype(np.int64)
        n1 = np.bincount(at, np.tile(counts, 8) * bits.astype(np.float64), len(nodes)).astype(np.int64)
        below = None
        if out:
            below = np.bincount(np.searchsorted(nodes, parent(out[-1].keys, d)), out[-1].weighted, len(nodes))
        out.append(Level(nodes, n - n1, n1, below))
    return out


def top_levels(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[Level]:
    """Levels TOP to 0 from the nodes of level TOP and what lies below them."""
    out: list[Level] = []
    for d in range(TOP, -1, -1):
        if out:
            nodes, at = np.unique(parent(out[-1].keys, d), return_inverse=True)
            n0, n1, below = (np.bincount(at, x, len(nodes)) for x in (out[-1].n0, out[-1].n1, out[-1].weighted))
            keys, n0, n1 = nodes, n0.astype(np.int64), n1.astype(np.int64)
        out.append(Level(keys, n0, n1, below))
    return out


def log10_probability(grams: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """log10 of the probability of each gram's last byte; levels: deepest first, down to 0."""
    total = np.zeros(len(grams))
    steps = [list(_steps(grams, d)) for d in range(depth, -1, -1)]
    for j in range(8):
        one = np.full(len(grams), 0.5)
        any_below = np.zeros(len(grams), bool)
        for level, step in zip(levels, steps, strict=True):
            at, met = level.find(step[j][0])
            if len(level.keys):
                stay = np.where(any_below, level.stay[at], 1.0)
                one = np.where(met, stay * level.one[at] + (1 - stay) * one, one)
            any_below |= met
        total += np.log10(np.where(steps[0][j][1] == 1, one, 1 - one))
    return total


class Strings:
    """Normalised bytes of a block of texts, each after `depth` newlines of context."""

    def __init__(self, words: Words, depth: int):
        w, n = words, words.n
        inside = ~w.space
        tokens = w.counts + 1
        seps = np.maximum(w.counts, 1)  # a space between words, a newline at the end
        length = np.add.reduceat(np.append(inside, False).astype(np.int64), w.offsets[:-1]) * (np.diff(w.offsets) > 0) if n else np.zeros(0, np.int64)
        sizes = length + seps + depth
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(self.offsets[-1], 10, np.uint8)
        spans = w.ends - w.starts
        # a word starts after its text's context and the words and separators before it
        before = np.cumsum(spans + 1) - (spans + 1)
        if len(before):
            head = np.append(before, 0)[np.minimum(w.first[:-1], len(before) - 1)]
            to = self.offsets[w.text] + depth + before - head[w.text]
            shift = np.repeat(to - w.starts, spans)
            source = np.flatnonzero(inside)
            out[source + shift] = w.data[source]
            last = np.zeros(len(before), bool)
            last[w.first[1:][w.counts > 0] - 1] = True
            out[(to + spans)[~last]] = 32
        self.bytes, self.tokens, self.n = out, tokens, n
        self.lengths = sizes - depth
        self.text = np.repeat(np.arange(n), self.lengths)
        self.depth = depth

    def grams(self) -> np.ndarray:
        """depth + 1 bytes ending at each byte of the texts."""
        wide = self.bytes.astype(U)
        g = wide.copy()
        for k in range(1, self.depth + 1):
            g[k:] |= wide[:-k] << U(8 * k)
        keep = np.ones(len(g), bool)
        keep[(self.offsets[:-1, None] + np.arange(self.depth)).ravel()] = False
        return g[keep]


def _blocks(texts: pa.ChunkedArray, depth: int) -> Iterator[tuple[slice, Words, Strings]]:
    for rows, part in text_blocks(texts):
        w = Words(part, lower=True)
        yield rows, w, Strings(w, depth)


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(at, np.concatenate(counts), len(u)).astype(np.int64)


def _tally(texts: pa.ChunkedArray, train: np.ndarray, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """kind (0 grams, 1 tokens) -> distinct keys of the texts and their counts in training texts."""
    found: dict[int, list] = {0: [], 1: []}
    for rows, w, s in _blocks(texts, depth):
        learn = train[rows]
        tokens = np.append(w.hashes(), np.full(w.n, END)), np.append(learn[w.text], learn)
        for kind, keys, mask in ((0, s.grams(), learn[s.text]), (1, *tokens)):
            seen, n = np.unique(keys[mask], return_counts=True)
            rest = np.unique(keys[~mask])
            found[kind].append((np.concatenate([seen, rest]), np.concatenate([n, np.zeros(len(rest), np.int64)])))
    empty = (np.zeros(0, U), np.zeros(0, np.int64))
    return {k: _sums(*zip(*v, strict=True)) if v else empty for k, v in found.items()}


def _part(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """Part in which a key is worked out: contexts with the same last TOP + 1 bytes stay together."""
    own = (keys >> U(8)) & U((1 << 8 * (TOP + 1)) - 1) if kind == 0 else keys
    return (mix64(own) % U(parts)).astype(np.int64)


def _is_train(ids: np.ndarray, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(str(int(i)).encode()) % folds != fold for i in ids], bool)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
_ASKED = "part int, bucket int, kind int, keys binary, counts binary"


def _ask(depth: int, parts: int, folds: int, fold: int):
    """Distinct keys of a bucket, packed by part."""

    def run(t: pa.Table) -> pa.Table:
        bucket, out = t["bucket"][0].as_py(), []
        for kind, (keys, counts) in _tally(t["text"], _train_rows(t, folds, fold), depth).items():
            part = _part(kind, keys, parts)
            order = np.argsort(part, kind="stable")  # keys stay sorted within a part
            for p, a, z in runs(part[order]):
                mine = order[a:z]
                out.append((p, bucket, kind, pack(keys[mine], True), pack(counts[mine])))
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "bucket", "kind", "keys", "counts"])

    return tidy(run)


def _train_rows(t: pa.Table, folds: int, fold: int) -> np.ndarray:
    """Rows to learn from; a null id is held out."""
    known = np.asarray(t["doc_id"].is_valid())
    ids = np.asarray(t["doc_id"].fill_null(0))
    return _is_train(ids, folds, fold) & known


def _totals(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """kind -> distinct keys of a part and their counts over all buckets."""
    found: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
    for kind, keys, counts in zip(t["kind"].to_pylist(), t["keys"].to_pylist(), t["counts"].to_pylist(), strict=True):
        found[kind][0].append(unpack(keys, True))
        found[kind][1].append(unpack(counts))
    return {k: _sums(*v) if v[0] else (np.zeros(0, U), np.zeros(0, np.int64)) for k, v in found.items()}


def _tops(depth: int):
    """Of a part: nodes of level TOP with what lies below them; key -1 holds the tokens' total and number."""

    def run(t: pa.Table) -> pa.Table:
        got = _totals(t)
        low = deep_levels(*got[0], depth)[-1]
        nodes, at = np.unique(parent(low.keys, TOP), return_inverse=True)
        sums = [np.bincount(at, x, len(nodes)) for x in (low.n0, low.n1, low.weighted)]
        tokens = got[1][1]
        extra = [int(tokens.sum()), int((tokens > 0).sum()), 0.0]
        return pa.table([pa.array(np.append(nodes.astype(np.int64), -1)), *(pa.array(np.append(s, e).astype(k)) for s, e, k in zip(sums, extra, (np.int64, np.int64, np.float64), strict=True))], names=["node", "n0", "n1", "below"])

    return tidy(run)


def _answer(depth: int, shared):
    """Values of a part's keys, for each bucket that asked: log10 probabilities of grams, counts of tokens."""

    def run(t: pa.Table) -> pa.Table:
        got = _totals(t)
        levels = deep_levels(*got[0], depth) + top_levels(*shared.value)
        values = {0: log10_probability(got[0][0], levels, depth).astype("<f4").view(np.uint32), 1: got[1][1]}
        kinds, keys = t["kind"].to_pylist(), t["keys"].to_pylist()
        out = [pack(values[k][np.searchsorted(got[k][0], unpack(x, True))]) for k, x in zip(kinds, keys, strict=True)]
        return pa.table([t["bucket"], t["kind"], t["keys"], pa.array(out, pa.binary())], names=["bucket", "kind", "keys", "found"])

    return tidy(run)


def _score(depth: int, n: int, v: int, folds: int, fold: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        table = {}
        for kind in (0, 1):
            rows = [(unpack(k, True), unpack(x)) for k, x, q in zip(answers["keys"].to_pylist(), answers["found"].to_pylist(), answers["kind"].to_pylist(), strict=True) if q == kind]
            keys, values = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, U), np.zeros(0, U))
            order = np.argsort(keys)
            table[kind] = keys[order], values[order]
        grams, chance = table[0][0], table[0][1].astype(np.uint32).view(np.float32).astype(np.float64)
        words, count = table[1][0], table[1][1].astype(np.float64)
        size = n + 0.5 * (v + 1)
        facts = np.zeros((5, len(t)))
        for rows, w, s in _blocks(t["text"], depth):
            c = count[np.searchsorted(words, np.append(w.hashes(), END))]
            c, end = c[:-1], c[-1]
            facts[0, rows] = w.counts + 1
            facts[1, rows] = np.bincount(w.text[c > 0], minlength=w.n) + (end > 0)
            facts[2, rows] = np.bincount(w.text, np.log10((c + 0.5) / size), w.n) + np.log10((end + 0.5) / size)
            facts[4, rows] = s.lengths
            facts[3, rows] = np.bincount(s.text, chance[np.searchsorted(grams, s.grams())], w.n)
        held = ~_train_rows(t, folds, fold)
        whole = lambda x: pa.array(x.astype(np.int64))
        return pa.table([t["doc_id"], pa.array(held), whole(facts[0]), whole(facts[1]), whole(np.full(len(t), n)), pa.array(facts[2]), pa.array(facts[3]), whole(facts[4]), pa.array(-facts[3] * np.log2(10) / np.maximum(facts[4], 1))], names=[x.split()[0] for x in _SCORES.split(", ")])

    return tidy(run, 2)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, folds: int = 5, fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Training texts are those whose crc32(id as text) mod folds is not fold. score is the log10
    probability of the normalised text, which has n_bytes bytes and takes bits_per_byte bits of
    code for each; base_score that of a unigram model of its tokens. Null
    and empty texts have one token, the end. A row with a null id is scored and held out. Equal
    rows score alike and each counts in training. An empty table gives no rows. Tokens are told
    apart by 64-bit hashes. Further columns of the input, whatever their names, are ignored.
    """
    rows, n_buckets, _ = bucketed(docs, id_col, text_col)
    asked = stored(rows.groupBy("bucket").applyInArrow(_ask(depth, n_buckets, folds, fold), _ASKED), "ctw-asked")
    tops = asked.groupBy("part").applyInArrow(_tops(depth), "node long, n0 long, n1 long, below double")
    # at most 65,536 contexts of 255 nodes, whatever the corpus
    top = tops.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toArrow().sort_by("node")
    node, n0, n1, below = (top[c].to_numpy() for c in top.column_names)
    first = int(np.searchsorted(node, 0))
    n, v = (int(n0[0]), int(n1[0])) if first else (0, 0)
    shared = docs.sparkSession.sparkContext.broadcast((node[first:].astype(U), n0[first:], n1[first:], below[first:]))
    answers = asked.groupBy("part").applyInArrow(_answer(depth, shared), "bucket int, kind int, keys binary, found binary")
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score(depth, n, v, folds, fold), _SCORES)
