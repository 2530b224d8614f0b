"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language label, so code-switched texts are labelled piece by piece.
Emission features are prefixes and suffixes, byte n-grams of the word with its ends marked
(all hashed into one table of fixed size) and the word's class in a learned lexicon;
transitions between the languages of neighbouring words are learned too. Marginals come from
forward-backward, and the language of a text is the one with the largest sum of them.

The model is fitted on a sample of about `per_label` texts for each language (hash-selected,
whole texts); half of them make the lexicon, the others train the field on chunks of words
joined in pairs, so that changes of language are seen. Everything else covers all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, blocks, mix64

U = np.uint64
#: Rows of the hashed feature table.
SLOTS = 1 << 18
#: Words that forward-backward takes as one piece.
PIECE = 128
CHUNK = 40
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # SLOTS x labels
    lexicon: np.ndarray  # sorted word hashes
    kinds: np.ndarray  # class of each: 0 to labels - 1, or labels for a word of several languages
    by_kind: np.ndarray  # (labels + 2) x labels; the last row is for words not in the lexicon
    move: np.ndarray  # labels x labels


def word_features(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among `which`, slot) of each affix and n-gram of the named words."""
    starts, ends = w.starts[which], w.ends[which]
    sizes = ends - starts
    # each word between two zero bytes
    to = np.concatenate([[0], np.cumsum(sizes + 2)])
    data = np.zeros(to[-1], U)
    data[np.arange(sizes.sum()) + np.repeat(to[:-1] + 1 - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else []] = w.data[np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else []]
    owner = np.repeat(np.arange(len(which)), sizes + 2)
    places, slots = [], []

    def add(at: np.ndarray, code: np.ndarray, kind: int) -> None:
        places.append(at)
        slots.append(mix64(code * U(16) + U(kind)) & U(SLOTS - 1))

    code = data
    for n in (2, 3):
        code = code[:-1] * U(256) + data[n - 1 :]
        inside = owner[: len(code)] == owner[n - 1 :]
        add(owner[: len(code)][inside], code[inside], n)
    for n in range(1, 5):  # the first and last n bytes, shorter words as they are
        first, last = np.zeros(len(which), U), np.zeros(len(which), U)
        for k in range(n):
            first = first * U(256) + data[np.minimum(to[:-1] + 1 + k, to[1:] - 1)]
            last = last * U(256) + data[np.maximum(to[1:] - 2 - k, to[:-1])]
        if n < 4:
            add(np.arange(len(which)), first, 3 + n)
        add(np.arange(len(which)), last, 6 + n)
    return np.concatenate(places), np.concatenate(slots).astype(np.int64)


def _kinds(model: Model, hashes: np.ndarray) -> np.ndarray:
    n = len(model.labels)
    if not len(model.lexicon):
        return np.full(len(hashes), n + 1)
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    return np.where(model.lexicon[at] == hashes, model.kinds[at], n + 1)


def _by_place(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(places, values[:, k], n) for k in range(values.shape[1])], 1)


def emissions(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(log emission of each word, whether the word has a letter); words without one say nothing."""
    hashes = w.hashes()
    kinds, at = np.unique(hashes, return_inverse=True)
    which = np.zeros(len(kinds), np.int64)
    which[at] = np.arange(len(hashes))
    places, slots = word_features(w, which)
    out = _by_place(places, model.table[slots], len(which)) + model.by_kind[_kinds(model, kinds)]
    letters = np.concatenate([[0], np.cumsum(_LETTER_BYTE[w.data])])
    letter = letters[w.ends[which]] > letters[w.starts[which]]
    return np.where(letter[:, None], out, 0.0)[at], letter[at]


def marginals(log_emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Posterior of each word's label; sequence i holds words first[i] to first[i + 1].

    Sequences are cut into pieces. The product of a piece's steps is found for all pieces at
    once, messages then pass from piece to piece, and a second sweep inside the pieces gives
    the marginals; so a very long text takes no more steps than its number of pieces.
    """
    n, labels = log_emit.shape
    if not n:
        return np.zeros((0, labels))
    emit = np.exp(log_emit - log_emit.max(1, keepdims=True))
    step = np.exp(move - move.max())
    counts = np.diff(first)
    pieces = -(-counts // PIECE)
    owner = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[:-1][owner] + nth * PIECE
    size = np.minimum(PIECE, first[1:][owner] - start)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    live = np.searchsorted(-size, -np.arange(PIECE), "left")  # pieces with a word number t
    product = np.repeat(np.eye(labels)[None], len(start), 0)
    for t in range(int(size[0])):
        k = live[t]
        p = (product[:k] @ step) * emit[start[:k] + t][:, None, :]
        product[:k] = p / p.sum((1, 2), keepdims=True)
    into, out_of = np.full((len(start), labels), 1 / labels), np.full((len(start), labels), 1 / labels)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))  # place of each piece, in order of the text
    for k in range(1, int(pieces.max())):
        now = np.flatnonzero(nth == k)
        f = np.einsum("ij,ijk->ik", into[back[now - 1]], product[back[now - 1]])
        into[back[now]] = f / f.sum(1, keepdims=True)
    for k in range(int(pieces.max()) - 1, 0, -1):
        now = np.flatnonzero(nth == k)
        f = np.einsum("ijk,ik->ij", product[back[now]], out_of[back[now]])
        out_of[back[now - 1]] = f / f.sum(1, keepdims=True)
    alpha = np.empty((n, labels))
    f = into
    for t in range(int(size[0])):
        k = live[t]
        at = start[:k] + t
        f = (f[:k] @ step) * emit[at]
        f /= f.sum(1, keepdims=True)
        alpha[at] = f
    b = out_of
    for t in range(int(size[0]) - 1, -1, -1):
        k = live[t]
        at = start[:k] + t
        alpha[at] *= b[:k]
        g = (emit[at] * b[:k]) @ step.T
        b[:k] = g / g.sum(1, keepdims=True)
    return alpha / alpha.sum(1, keepdims=True)


def _lexicon(w: Words, label: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words seen at least twice, and the language that four fifths of them stand in (n: none)."""
    words, at = np.unique(w.hashes(), return_inverse=True)
    seen = np.stack([np.bincount(at, label[w.text] == k, len(words)) for k in range(n)], 1)
    total, best = seen.sum(1), seen.argmax(1)
    kind = np.where(seen.max(1) >= 0.8 * total, best, n)
    often = total >= 2
    return words[often], kind[often]


def fit(texts: list[bytes], labels: list[str], epochs: int = 6, batches: int = 6, rate: float = 0.3, penalty: float = 1e-6, seed: int = 5) -> Model:
    """Fits the field by AdaGrad on the log-likelihood of the chunks."""
    names = sorted(set(labels))
    n = len(names)
    label = np.array([names.index(x) for x in labels], np.int64)
    model = Model(names, np.zeros((SLOTS, n)), np.zeros(0, U), np.zeros(0, np.int64), np.zeros((n + 2, n)), np.zeros((n, n)))
    if n < 2:
        return model
    half = np.array([zlib.crc32(t) % 2 == 0 for t in texts])
    if 0 < half.sum() < len(texts):
        model.lexicon, model.kinds = _lexicon(Words(pa.array([t for t, h in zip(texts, half, strict=True) if h], pa.binary()), lower=True), label[half], n)
    else:
        half[:] = False
    w = Words(pa.array([t for t, h in zip(texts, half, strict=True) if not h], pa.binary()), lower=True)
    gold = label[~half][w.text]
    words, at = np.unique(w.hashes(), return_inverse=True)
    which = np.zeros(len(words), np.int64)
    which[at] = np.arange(len(at))
    places, slots = word_features(w, which)
    kinds = _kinds(model, words)
    # chunks of one text, joined in pairs at random
    heads = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(w.first[:-1], w.first[1:], strict=True) if b > a] or [np.zeros(0, np.int64)])
    if not len(heads):
        return model
    tails = np.minimum(heads + CHUNK, w.first[1:][w.text[heads]])
    rng = np.random.default_rng(seed)
    other = rng.permutation(len(heads))
    length = 2 * CHUNK
    tokens = np.full((len(heads), length), -1)
    for i, j in enumerate(other):
        run = np.concatenate([np.arange(heads[i], tails[i]), np.arange(heads[j], tails[j])])
        tokens[i, : len(run)] = run
    squares = [np.full(x.shape, 1e-8) for x in (model.table, model.by_kind, model.move)]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(heads)), batches):
            log_emit = _by_place(places, model.table[slots], len(words)) + model.by_kind[kinds]
            grad_word, grad_move = _gradient(tokens[rows], at, gold, log_emit, model.move)
            grads = _by_place(slots, grad_word[places], SLOTS), _by_place(kinds, grad_word, n + 2), grad_move
            for x, g, s in zip((model.table, model.by_kind, model.move), grads, squares, strict=True):
                g = g / len(rows) - penalty * x
                s += g * g
                x += rate * g / np.sqrt(s)
    return model


def _gradient(tokens: np.ndarray, kind: np.ndarray, gold: np.ndarray, log_emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood by word type and by transition."""
    n, length = tokens.shape
    labels = log_emit.shape[1]
    there = tokens >= 0
    types = np.where(there, kind[np.maximum(tokens, 0)], 0)
    truth = np.where(there, gold[np.maximum(tokens, 0)], 0)
    emit = np.exp(log_emit - log_emit.max(1, keepdims=True))[types]
    step = np.exp(move)
    alpha, beta = np.zeros((length, n, labels)), np.ones((length, n, labels))
    f = np.full((n, labels), 1 / labels)
    for t in range(length):
        g = (f @ step) * emit[:, t]
        f = np.where(there[:, t, None], g / g.sum(1, keepdims=True), f)
        alpha[t] = f
    b = np.ones((n, labels))
    for t in range(length - 1, -1, -1):
        beta[t] = b
        g = (emit[:, t] * b) @ step.T
        b = np.where(there[:, t, None], g / g.sum(1, keepdims=True), b)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    grad_word = np.zeros_like(log_emit)
    for k in range(labels):
        diff = (truth.T == k) - post[:, :, k]
        grad_word[:, k] = np.bincount(types.T[there.T], diff[there.T], len(log_emit))
    grad_move = np.zeros_like(move)
    for t in range(1, length):
        on = there[:, t]
        if not on.any():
            break
        pair = alpha[t - 1][on][:, :, None] * step[None] * (emit[on, t] * beta[t][on])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        grad_move -= pair.sum(0)
        np.add.at(grad_move, (truth[on, t - 1], truth[on, t]), 1.0)
    return grad_word, grad_move


def training_sample(docs: DataFrame, per_label: int, folds: int, fold: int, longest: int) -> tuple[list[bytes], list[str]]:
    """About per_label labelled texts of at most `longest` bytes of each language, chosen by a hash of the id and the text."""
    train = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= longest) & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != fold))
    counts = train.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return [], []
    chance = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_label / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = train.where(draw < F.element_at(chance, F.col("lang"))).select("text", "lang").collect()
    rows = sorted((r["text"].encode(), r["lang"]) for r in rows)
    return [t for t, _ in rows], [x for _, x in rows]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 300, folds: int = 4, fold: int = 2, longest: int = 1 << 17) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_switches.

    Learns from rows whose crc32(id as text) mod folds is not fold and whose label is known; a
    null id is never learned from. A text that is null or has no letter is 'und' with score 0,
    as is every text when no label is known. score is the mean marginal of the predicted
    language over words with a letter, n_switches the number of changes of the most probable
    label between such words. Equal texts get equal results; an empty table gives no rows;
    further columns of the input, whatever their names, are ignored.

    The driver holds the sample: about per_label texts of `longest` bytes at most for each
    language. Longer texts are not learned from, but predicted like any other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    texts, labels = training_sample(rows, per_label, folds, fold, longest)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, labels) if texts else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in blocks(batch, "text"):
                n = part.num_rows
                lang, score, switches = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, np.int64)
                known = np.array([t is not None and _LETTER.search(t) is not None for t in part["text"].to_pylist()], bool)
                if model is not None and n:
                    w = Words(part["text"], lower=True)
                    log_emit, letter = emissions(model, w)
                    post = marginals(log_emit, w.first, model.move)[letter]
                    text = w.text[letter]
                    votes = _by_place(text, post, n) if len(post) else np.zeros((n, len(model.labels)))
                    best, total = votes.argmax(1), np.bincount(text, minlength=n)
                    known &= total > 0
                    lang = np.where(known, np.array(model.labels, object)[best], UNKNOWN)
                    score = np.where(known, votes[np.arange(n), best] / np.maximum(total, 1), 0.0)
                    top = post.argmax(1)
                    switches = np.bincount(text[1:][(top[1:] != top[:-1]) & (text[1:] == text[:-1])], minlength=n)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(switches, pa.int64())], names=["doc_id", "lang_pred", "score", "n_switches"])

    out = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_switches long")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_switches")
