"""Packing of token sequences into bins: best fit, then a swap-based local search.

Documents are cut into pieces of at most `size` tokens. What decides where a piece can go is
its length alone, so bins are planned on the counts of the lengths: bins alike (holding the
same lengths) are one class with a number, and a step is taken by as many bins of a class as can
take it. Best fit goes through the lengths from the longest; the local search then moves a
piece, exchanges one for one, or two for one, between underfull bins whenever the sum of squared
fills grows, until no such step is left; bins that lose their last piece vanish. There are at
most `size` lengths and a few classes for each, whatever the number of documents.

The pieces of a length are numbered by counts of small cells and running totals of these; which
bin a number falls into, and where, is read from the plan inside the tasks. Only slim rows are
exchanged unless the caller carries the ids along.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Words, blocks, per_text, ranges, release, stored, word_hashes
from .sharding import numbered

SIZE = 2048
#: Words and pre-tokens whose ids a worker remembers; beyond that the memory is emptied, which changes no result.
REMEMBERED, REMEMBERED_PIECES = 2_000_000, 400_000
#: Longer words are not remembered.
LONG = 64
#: Bytes of text that are cut into words at once.
SEGMENT = 1 << 20
_OUT = "doc_id long, piece int, start long, length long, ids binary"

#: Words of such characters need no other normalisation than lower case.
_PLAIN = re.compile("[\x21-\x7e¡-įı-ſ]+").fullmatch


class WordTokens:
    """Ids of texts by a tokenizer that drops white space and encodes each word by itself.

    Words are told apart by hash (64 bits in a block, 128 between blocks) and each distinct one
    is encoded once, many in one call: words of Latin letters, digits and
    signs are cut by the tokenizer's own pattern and go through its BPE model in one text, whose
    ids fall apart again at the ends of words; all others go through the whole tokenizer. Ids of
    words lie in one array, from which those of a block of texts are gathered.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(model)
        self.whole = Tokenizer.from_str(model)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        cut = spec["pre_tokenizer"]["pretokenizers"][0]
        self.cut = regex.compile(cut["pattern"]["Regex"]).findall
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.whole.get_vocab(), spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, bytes] = {}
        # first hashes of known words in order, and the words' numbers; by number: second hash, where its ids end
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.other, self.ends_at, self.pool = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _cut(self, word: str) -> list[str]:
        """The tokenizer's own pre-tokens of a word, in lower case."""
        if word.isalpha():
            return [word.lower()]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1].lower(), word[-1]]
        return self.cut(word.lower())

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        cuts, odd, found = [], [], []
        for i, w in enumerate(words):
            s = w.decode("utf-8", "replace")
            cuts.append(self._cut(s) if _PLAIN(s) else ())
            if not cuts[-1]:
                odd.append((i, s))
        new = list({p for c in cuts for p in c}.difference(self.codes))
        if new:
            ids = np.array(self.pieces.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(new):
                raise ValueError("the tokenizer does not end each word by itself")
            raw, at = ids.tobytes(), [0, *(4 * at).tolist()]
            self.codes.update(zip(new, map(raw.__getitem__, map(slice, at, at[1:])), strict=False))
        found = [b"".join(map(self.codes.__getitem__, c)) for c in cuts]
        if odd:
            for (i, _), e in zip(odd, self.whole.encode_batch_fast([s for _, s in odd], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, "<u4").tobytes()
        for p in new:
            if len(p) > LONG:
                del self.codes[p]
        return found

    def _numbers(self, w: Words, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The number of each distinct word of a block; new ones are encoded and get the next numbers."""
        other = word_hashes(w.data, w.starts[first], w.ends[first], 1)
        at, number = np.searchsorted(self.keys, hashes), np.full(len(hashes), -1)
        there = np.flatnonzero(at < len(self.keys))
        there = there[self.keys[at[there]] == hashes[there]]
        number[there] = self.number[at[there]]
        number[there[self.other[number[there]] != other[there]]] = -1
        new = np.flatnonzero(number < 0)
        if len(new):
            data = w.data.tobytes()
            ids = self._learn([data[a:z] for a, z in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)])
            number[new] = len(self.other) + np.arange(len(new))
            add = np.setdiff1d(new, there, assume_unique=True)  # a hash that two words share stays with the first
            self.keys, self.number = np.insert(self.keys, at[add], hashes[add]), np.insert(self.number, at[add], number[add])
            self.other = np.append(self.other, other[new])
            self.ends_at = np.append(self.ends_at, self.ends_at[-1] + np.cumsum([len(x) // 4 for x in ids]))
            self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        if len(self.other) > REMEMBERED or len(self.pool) > 16 * REMEMBERED:
            self.forget()
        if len(self.codes) > REMEMBERED_PIECES:
            self.codes.clear()
        w = Words(texts)
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(w.n, np.int64)
        hashes, first, at = np.unique(w.hashes(), return_index=True, return_inverse=True)
        number = self._numbers(w, hashes, first)[at]
        begin, end = self.ends_at[number], self.ends_at[number + 1]
        return self.pool[ranges(begin, end)], per_text(w.text, w.n, end - begin)


_MODELS: dict[str, WordTokens] = {}
_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _segments(text: bytes) -> Iterator[bytes]:
    """A text in parts of about SEGMENT bytes that end at white space."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _SPACES.search(text, at + SEGMENT)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def _ended(words: WordTokens, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block of texts, each with its end, and their numbers; a single long text goes through in segments."""
    if len(texts) == 1 and texts[0].is_valid:
        parts = [words.encode(pa.array([s], pa.large_binary()))[0] for s in _segments(texts.cast(pa.large_binary())[0].as_py())]
        return np.concatenate([*parts, np.zeros(1, np.uint32)]), np.array([sum(map(len, parts)) + 1])
    ids, n = words.encode(texts)
    return np.insert(ids, np.cumsum(n), 0), n + 1


def _pieces(batch: pa.RecordBatch, ids: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows of the pieces of a block of documents that hold n ids each."""
    per = -(-n // size)
    row = np.repeat(np.arange(len(n)), per)
    piece = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(size, n[row] - piece * size)
    offsets = np.append(0, 4 * np.cumsum(length)).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
    columns = [batch["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(length, pa.int64()), data]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of each document: doc_id, piece (from 0), start, length, ids (unsigned 32-bit, little-endian).

    A document's ids are those of the tokenizer file (one whose model encodes words apart and
    drops white space) without special tokens, then id 0. Documents over `size` ids are cut; only
    their last piece may be shorter. A null text counts as an empty one: the single id 0. Every
    row is encoded by itself, whatever its id; a text of any length is read whole, in segments.
    An empty table gives no rows; further columns of the input are ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    name = hashlib.sha256(model.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = WordTokens(shared.value)
        words = _MODELS[name]  # kept with what it remembers for the worker's next task
        for batch in batches:
            for part in blocks(batch, "text", SEGMENT):
                yield _pieces(part, *_ended(words, part["text"]), size)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _OUT)


Bin = tuple[int, ...]  # lengths, longest first


def best_fit(lengths: dict[int, int], size: int) -> Counter[Bin]:
    """{length: number of pieces} -> {lengths of a bin: number of such bins}: best fit from the longest piece on.

    All pieces of a length are placed at once: the fullest bins that can take one take as many as
    fit, which is what best fit does with one piece after the other.
    """
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [bin, how many]
    rooms: list[int] = []

    def put(room: int, bin_: Bin, n: int) -> None:
        if not open_[room]:
            insort(rooms, room)
        open_[room].append([bin_, n])

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        if length > size:
            raise ValueError(f"a piece of {length} does not fit into {size}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bin_, n = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, bin_, n = size, (), left
            fit = room // length
            full = min(n, left // fit)
            left -= full * fit
            if full:
                put(room - fit * length, bin_ + (length,) * fit, full)
            n -= full
            if n and left and left < fit:
                put(room - left * length, bin_ + (length,) * left, 1)
                n, left = n - 1, 0
            if n and bin_:
                put(room, bin_, n)
    out: Counter[Bin] = Counter()
    for classes in open_.values():
        for bin_, n in classes:
            out[bin_] += n
    return out


def _without(bin_: Bin, *gone: int) -> list[int]:
    left = list(bin_)
    for x in gone:
        left.remove(x)
    return left


def _given(bin_: Bin) -> list[tuple[int, int, int]]:
    """(sum, piece, second piece or 0): what a bin can give in one step, one of its pieces or two."""
    own = Counter(bin_)
    return [(x, x, 0) for x in own] + [(x + y, x, y) for x in own for y in own if x > y or (x == y and own[x] > 1)]


class _Underfull:
    """Classes of underfull bins, and all that they could give as flat arrays."""

    def __init__(self, bins: Counter[Bin], size: int):
        self.size, self.full = size, Counter()
        self.bins: list[Bin] = []
        self.number: dict[Bin, int] = {}
        self.n = np.zeros(1024, np.int64)
        self.fill = np.zeros(1024, np.int64)
        self.offers = np.zeros((4, 4096), np.int64)  # sum, class, piece, second piece
        self.used = 0
        for b, n in bins.items():
            self.add(b, n)

    def add(self, bin_: Bin, n: int) -> int | None:
        """Adds n bins (or takes them away); the number of the class unless it is full or empty."""
        fill = sum(bin_)
        if fill in (0, self.size):
            self.full[bin_] += n * (fill > 0)
            return None
        i = self.number.get(bin_)
        if i is None:
            i = self.number[bin_] = len(self.bins)
            self.bins.append(bin_)
            if i == len(self.n):
                self.n, self.fill = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.n, self.fill))
            self.fill[i] = fill
            rows = [(v, i, x, y) for v, x, y in _given(bin_)]
            while self.used + len(rows) > self.offers.shape[1]:
                self.offers = np.concatenate([self.offers, np.zeros_like(self.offers)], axis=1)
            self.offers[:, self.used : self.used + len(rows)] = np.array(rows, np.int64).T
            self.used += len(rows)
        self.n[i] += n
        return i

    def step(self, i: int) -> int | None:
        """The step that fills class i most, taken by as many bins as can; the number of the class made of it if that is underfull."""
        bin_, room = self.bins[i], int(self.size - self.fill[i])
        value, donor, x, y = self.offers[:, : self.used]
        there = self.n[donor] > (donor == i)
        # the sum of squares grows if the receiver ends up fuller than the donor was
        most = np.where(there, room, 0)
        need = self.fill[donor] - self.fill[i]
        best = (0, 0, 0, 0)
        for v, a, b in [(0, 0, 0), *_given(bin_)]:
            gain = value - v
            ok = (gain > np.maximum(need, 0)) & (gain <= most)
            if b:
                ok &= y == 0  # two for one, not two for two
            k = int(np.argmax(np.where(ok, gain, 0)))
            if ok[k] and gain[k] > best[0]:
                best = (int(gain[k]), k, a, b)
                if best[0] == room:
                    break
        if not best[0]:
            return None
        _, k, a, b = best
        d, mine, theirs = int(donor[k]), [z for z in (a, b) if z], [int(z) for z in (x[k], y[k]) if z]
        n = int(self.n[i] // 2 if d == i else min(self.n[i], self.n[d]))
        fuller, emptier = ([*_without(self.bins[j], *out), *into] for j, out, into in ((i, mine, theirs), (d, theirs, mine)))
        self.n[i] -= n
        self.n[d] -= n
        self.add(tuple(sorted(emptier, reverse=True)), n)
        found = self.add(tuple(sorted(fuller, reverse=True)), n)
        return i if found is None else found


def local_search(bins: Counter[Bin], size: int) -> Counter[Bin]:
    """Steps between underfull bins that increase the sum of squared fills, until none is left.

    The fullest bins receive first. A bin takes one piece or two of another one (a move), or takes
    them for its own: one for one, two for one, or one for two. Of all its steps the one that
    fills it most is taken, by as many bins of both classes as there are. Each step raises the sum
    of squares, a bounded whole number, so the search ends.
    """
    state, moved = _Underfull(bins, size), True
    while moved:
        moved = False
        for i in sorted(np.flatnonzero(state.n).tolist(), key=lambda i: (-state.fill[i], state.bins[i])):
            at: int | None = i
            while at is not None and state.n[at]:
                at = state.step(at)
                moved |= at is not None
    return state.full + Counter({state.bins[i]: int(state.n[i]) for i in np.flatnonzero(state.n)})


def plan(lengths: dict[int, int], size: int) -> Counter[Bin]:
    return local_search(best_fit(lengths, size), size)


def _table(bins: Counter[Bin], lengths: dict[int, int]) -> dict[str, np.ndarray]:
    """For runs of numbered pieces of a length: first place in the order of (length, number), first bin, pieces of the length in a bin, their offset there."""
    first = dict(zip(sorted(lengths), np.cumsum([0, *[lengths[x] for x in sorted(lengths)]]).tolist(), strict=False))
    rows, base = [], 0
    for bin_ in sorted(bins):
        at = 0
        for length in sorted(set(bin_), reverse=True):
            m = bin_.count(length)
            rows.append((first[length], base, m, at))
            first[length] += m * bins[bin_]
            at += m * length
        base += bins[bin_]
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"from": table[:, 0], "base": table[:, 1], "m": table[:, 2], "at": table[:, 3]}


def place(rows: DataFrame, size: int = SIZE, length_col: str = "length", cell_rows: int = 1000) -> DataFrame:
    """rows, each of a length from 1 to `size`, with sequence_id and offset: bins of at most `size`, gapless from 0.

    Any further columns come along. Equal rows are packed each by itself; which of the rows of
    one length stands where is not said. A null or non-positive length, or one over `size`, is an
    error. An empty table gives no rows. The driver gets one row for each length.
    """
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(length_col).cast("long").alias("length"), F.monotonically_increasing_id().alias("uid"))
    base = stored(kept, "packing-rows")  # numbers stay as they are from here on
    found = base.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    lengths = dict(zip(found["length"].to_pylist(), found["n"].to_pylist(), strict=True))
    if any(x is None or x < 1 for x in lengths):
        raise ValueError("a piece needs a length of at least 1")
    bins = plan(lengths, size)
    shared = spark.sparkContext.broadcast(_table(bins, lengths))  # some rows for each length
    start = np.zeros(size + 2, np.int64)
    for x, n in lengths.items():
        start[x + 1] = n
    start = np.cumsum(start)
    cells = max(1, -(-sum(lengths.values()) // cell_rows))
    order = numbered(base, "length", F.pmod(F.xxhash64("uid"), F.lit(cells)), ["uid"], "number").select("row", "length", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            length = batch["length"].to_numpy()
            k = start[length] + batch["number"].to_numpy()
            e = np.searchsorted(t["from"], k, "right") - 1
            nth = k - t["from"][e]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(t["base"][e] + nth // t["m"][e]), pa.array(t["at"][e] + nth % t["m"][e] * length)], names=["row", "sequence_id", "offset"])

    out = order.mapInArrow(run, StructType([order.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their ids and places (see pieces and place)."""
    return place(pieces(docs, tokenizer, size, id_col, text_col), size)
