"""SimHash near-duplicates with pivot distance tables.

Documents with the same fingerprint form a class; only classes are compared. For each class
the Hamming distances to many reference fingerprints are computed beforehand. Two fingerprints
at distance d differ by at most d in every such coordinate, so a pair whose largest coordinate
difference is above the limit is discarded without being compared, and survivors are verified.

Coordinates alone would have to be compared for all pairs. The pairs put to the test are
therefore those that agree on some set of bit blocks: with m blocks and at most k differing
bits, m - k blocks agree, so grouping by every choice of m - k blocks loses no pair. m is
chosen from the number of classes such that groups stay small. Groups above `group_rows` are
cut into parts, and each pair of parts is a group of its own.

With a similarity in place of a bit limit, fingerprints decide nothing: bands of min-hashes name
the candidates, the pivot tables with a loose bit limit discard strangers, and each pair left is
verified by the exact Jaccard similarity of the two shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import connected_components, join_labels
from .shared import Words, blocks, mix64, release, stored, tidy

BITS = 64
#: Min-hash bands and values in each: a pair of Jaccard similarity 0.8 shares no band once in 2,800.
BANDS, ROWS = 20, 5
#: Standard deviations that the bit limit of candidates lies above the expected distance.
LOOSE = 4.5
#: Shingles of the documents that one side of a comparison in a task holds.
PART = 1 << 18
#: Reference fingerprints: the same for every run.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(24)], np.uint64)


def fingerprint(words: list[bytes], width: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of `width` words, repeats included; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = [e - 1 for e in accumulate([len(w) + 1 for w in words])]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    h = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts, ends[min(width, len(words)) - 1 :], strict=False)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):
        part = h[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """doc_id and one signed 64-bit fingerprint fp0, fp1, ... for each seed; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                words = [(t or b"").lower().split() for t in part["text"].cast(pa.binary()).to_pylist()]
                found = [pa.array(np.array([fingerprint(w, width, s) for w in words], np.uint64).view(np.int64)) for s in seeds]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *found], names=["doc_id", *names])
            release()

    names = [f"fp{i}" for i in range(len(seeds))]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


_VALUES = np.random.default_rng(20240611).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, by text; a text of fewer words is one shingle."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    at, found = words.windows(width, hashes=hashes)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    whole = [xxhash.xxh64_intdigest(hashes[words.first[i] : words.first[i] + words.counts[i]].tobytes(), 42) for i in short]
    text = np.concatenate([words.text[at], short])
    found = np.concatenate([found, np.array(whole, np.uint64)])
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[new], found[new]


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, n_fps: int) -> DataFrame:
    """doc_id, a 128-bit name of the shingle set (set0, set1), its size, fingerprints of the set and its min-hash bands."""

    def sketch(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        text, found = shingle_hashes(part["text"], width)
        size = np.bincount(text, minlength=n)
        full = np.flatnonzero(size)
        starts = np.concatenate([[0], np.cumsum(size[full])[:-1]]).astype(np.int64)

        def of_texts(ufunc, x: np.ndarray, dtype=None) -> np.ndarray:
            out = np.zeros((n, *x.shape[1:]), dtype or x.dtype)
            if len(full):
                out[full] = ufunc.reduceat(x, starts, axis=0, dtype=dtype)
            return out

        sets = [of_texts(np.add, mix64(found ^ np.uint64(c))) for c in _VALUES[0, :2]]
        fps = []
        for c in _VALUES[0, 2 : 2 + n_fps]:
            bits = np.unpackbits(mix64(found ^ c).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = of_texts(np.add, bits, np.int64)
            fps.append(np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel())
        bands = np.zeros((n, BANDS), np.uint64)
        for i in range(BANDS * ROWS):
            least = of_texts(np.minimum, (found ^ _VALUES[1, i]) * _VALUES[2, i])
            bands[:, i // ROWS] = mix64(bands[:, i // ROWS] + least + np.uint64(i))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
        longs = [pa.array(x.view(np.int64)) for x in (*sets, *fps)]
        return pa.RecordBatch.from_arrays([part["doc_id"], *longs, pa.array(size.astype(np.int64)), lists], names=["doc_id", *names, "size", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                yield sketch(part)
            release()

    names = ["set0", "set1", *[f"fp{i}" for i in range(n_fps)]]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", size long, bands array<long>")


def with_coordinates(classes: DataFrame) -> DataFrame:
    """classes with pivots: the Hamming distance of fp0 to each reference fingerprint, one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp0"].to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.uint8)
            rows = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer((np.arange(len(fp) + 1) * len(PIVOTS)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(table))])
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, "pivots"])

    return classes.mapInArrow(run, StructType([*classes.schema.fields, StructField("pivots", BinaryType())]))


def choose_blocks(n: int, k: int) -> int:
    """Number of bit blocks for n fingerprints: the fewest keys whose groups hold few strangers."""
    def cost(m: int) -> float:
        bits = BITS * (m - k) / m
        return comb(m, k) * (n * 40.0 + n * (n / 2**bits) / 2)

    return min(range(k + 1, k + 8), key=cost)


def block_masks(m: int, k: int) -> list[int]:
    edges = [BITS * i // m for i in range(m + 1)]
    one = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(m)]
    return [sum(one[i] for i in chosen) for chosen in combinations(range(m), m - k)]


def _linker(k: int, n_check: int, most: int, similarity: float | None = None):
    """Links inside groups of rows (group, side, rep, fp0, ...) that arrive sorted by group.

    With a similarity, pairs (group, a, b) to be verified: those that would span the group if all
    were links. Sizes of sets bound the similarity of a pair.
    """

    def close(t: pa.Table) -> pa.RecordBatch:
        group, side, rep = (t[c].to_numpy() for c in ("grp", "side", "rep"))
        fps = [t[f"fp{i}"].to_numpy().view(np.uint64) for i in range(n_check)]
        n = len(group)
        size = None if similarity is None else t["size"].to_numpy()
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        table = np.frombuffer(b"".join(t["pivots"].to_pylist()), np.uint8).reshape(n, len(PIVOTS)).astype(np.int8)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        ends = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1] if n else np.zeros(0, int)  # end of each row's group
        label = np.arange(n)
        left = np.arange(n)
        step = 1
        while len(left):
            left = left[left + step < ends[left]]
            a, b = left, left + step
            ok = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] < 0))
            a, b = a[ok], b[ok]
            if similarity is not None:
                ok = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6
                a, b = a[ok], b[ok]
            for p in range(table.shape[1]):  # largest coordinate difference
                if not len(a):
                    break
                ok = np.abs(table[a, p] - table[b, p]) <= k
                a, b = a[ok], b[ok]
            if len(a):
                ok = np.bitwise_count(fps[0][a] ^ fps[0][b]) <= k
                if n_check > 1:
                    ok &= sum(np.bitwise_count(f[a] ^ f[b]).astype(np.int64) for f in fps) <= most
                if similarity is not None:
                    pairs.append((a[ok], b[ok]))
                label = join_labels(n, a[ok], b[ok], label)
            step += 1
        if similarity is not None:
            a, b = (np.concatenate([np.zeros(0, int), *[p[i] for p in pairs]]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (group[a], np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b]))], names=["grp", "a", "b"])
        far = label != np.arange(n)
        return pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[label[far]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            last = np.searchsorted(t["grp"].to_numpy(), t["grp"][-1].as_py())  # where the last group starts
            if rows and held[-1]["grp"][-1].as_py() == t["grp"][-1].as_py():
                held.append(t)
                rows += len(t)
                continue
            held.append(t.slice(0, last))
            yield close(pa.concat_tables(held).combine_chunks())
            held, rows = [t.slice(last)], len(t) - last
        if held:
            yield close(pa.concat_tables(held).combine_chunks())

    return run


def links(classes: DataFrame, k: int, group_rows: int = 4096, most: int | None = None) -> DataFrame:
    """Spanning links a-b between classes (rep, fp0, ..., pivots) whose fp0 differ in at most k bits.

    With further fingerprints fp1, ... the distance over all of them is at most `most` (k for each).
    """
    fps = [c for c in classes.columns if c.startswith("fp")]
    n = classes.count()
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp0").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m))) for i, m in enumerate(block_masks(choose_blocks(n, k), k))])
    grouped = _grouped(classes.select("rep", *fps, "pivots", F.explode(keys).alias("key")), group_rows)
    return grouped.repartition("grp").sortWithinPartitions("grp").mapInArrow(_linker(k, len(fps), k * len(fps) if most is None else most), "a long, b long")


def _grouped(keyed: DataFrame, group_rows: int) -> DataFrame:
    """Rows (key, rep, ...) of keys that occur again, as (grp, side, rep, ...)."""
    rest = [c for c in keyed.columns if c != "key"]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = stored(sizes.withColumn("parts", F.ceil(F.col("n") / group_rows).cast("int")).select("key", "parts"), "simhash-keys")
    keyed = keyed.join(parts, "key")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    # parts = 1: one group, no sides; otherwise a group for each pair of parts that holds this one
    alone = keyed.where("parts = 1").select(F.col("key").alias("grp"), F.lit(-1).alias("side"), *rest)
    cut = keyed.where("parts > 1").withColumn("own", own).select("key", "own", *rest, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cut = cut.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), *rest)
    # rows of a part meet each other in the group (own, own), rows of two parts in theirs
    return alone.unionByName(cut)


def _jaccard(width: int, similarity: float):
    """Whether two texts (a, b, x, y) have the similarity, by their sets of shingles."""

    def shingles(text: bytes | None) -> set:
        words = (text or b"").lower().split()
        return set(zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else {tuple(words)} if words else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(*[batch[c].cast(pa.binary()).to_pylist() for c in ("x", "y")], strict=True):
                x, y = shingles(x), shingles(y)
                both = len(x & y)
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
            release()

    return run


def verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(a, b, ok) of distinct pairs of ids. Of rows with equal ids, any may make the link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")
    texts = stored(texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h"), "simhash-texts")
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_jaccard(width, similarity), "a long, b long, ok boolean").groupBy("a", "b").agg(F.max("ok").alias("ok")), "simhash-verified")


def similar(docs: DataFrame, known: DataFrame, ties: DataFrame, id_col: str, text_col: str, width: int, similarity: float, group_rows: int = 4096) -> DataFrame:
    """Links a-b between classes (rep, fp0, ..., size, bands) of at least this Jaccard similarity.

    First the pairs that would span each group are verified on the texts. Where one fails, pairs
    that were passed over since they seemed tied by it may still be links: the groups of such
    failures are joined to blocks, and inside a block documents of different components are compared.
    """
    fps = [c for c in known.columns if c.startswith("fp")]
    differ = acos(2 * similarity / (1 + similarity)) / pi
    k, most = (ceil(n * differ + LOOSE * sqrt(n * differ * (1 - differ))) for n in (BITS, BITS * len(fps)))
    keyed = known.where("size > 0").select("rep", *fps, "pivots", "size", F.posexplode("bands").alias("band", "hash")).withColumn("key", F.xxhash64("band", "hash")).drop("band", "hash")
    grouped = stored(_grouped(keyed, group_rows), "simhash-groups")
    first = stored(grouped.repartition("grp").sortWithinPartitions("grp", "rep").mapInArrow(_linker(k, len(fps), most, similarity), "grp long, a long, b long"), "simhash-pairs")
    tested = verified(docs, first.select("a", "b").distinct(), id_col, text_col, width, similarity)
    failed = tested.where("not ok")
    if not failed.take(1):
        return tested.select("a", "b")
    links = tested.where("ok").select("a", "b")
    again = grouped.join(first.join(failed, ["a", "b"], "left_semi").select("grp").distinct(), "grp", "left_semi").select("grp", "rep")
    hubs = again.groupBy("grp").agg(F.min("rep").alias("hub"))
    blocks_ = connected_components(again.join(hubs, "grp").select(F.col("rep").alias("a"), F.col("hub").alias("b"))).toDF("rep", "block")
    parts = connected_components(links.unionByName(ties)).toDF("rep", "component")
    members = blocks_.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = stored(members.join(known.select("rep", *fps, "pivots", "size"), "rep"), "simhash-members")
    return links.unionByName(_passed_over(docs, members, id_col, text_col, width, similarity, k, most))


def _passed_over(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int, similarity: float, k: int, most: int) -> DataFrame:
    """Spanning links between documents of one block and different components (rows block, rep, component, fp0, ..., pivots, size).

    The component with most shingles of a block never meets itself, so a block of one large
    component and a few other documents costs no more than it holds. Sets of shingle hashes are
    compared inside tasks; no pair leaves one but spanning links.
    """
    fps = [c for c in members.columns if c.startswith("fp")]
    sizes = members.groupBy("block", "component").agg(F.sum("size").alias("n"))
    plan = sizes.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("components")).where("components > 1")
    few, many = (F.ceil(c / PART).cast("int") for c in (F.col("all") - F.col("most"), F.col("most")))
    plan = stored(plan.select("block", "main", few.alias("few"), many.alias("many")), "simhash-plan")
    rows = members.join(plan, "block")
    main = F.col("component") == F.col("main")
    own = F.when(main, F.col("few") + F.pmod(F.xxhash64("rep"), F.col("many")).cast("int")).otherwise(F.pmod(F.xxhash64("rep"), F.col("few")).cast("int"))
    # parts of the other components come first and meet every part, those of the main one only these
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
    rows = rows.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "component", *fps, "pivots")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(members.join(plan, "block", "left_semi").select("rep").distinct(), "rep", "left_semi")
    sets = stored(texts.mapInArrow(_shingle_sets(width), "rep long, shingles array<long>").dropDuplicates(["rep", "shingles"]), "simhash-sets")
    return stored(rows.join(sets, "rep").groupBy("block", "i", "j").applyInArrow(_compare(similarity, k, most, len(fps)), "a long, b long"), "simhash-late")


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                text, found = shingle_hashes(part["text"], width)
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["rep"], pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.view(np.int64)))], names=["rep", "shingles"])
            release()

    return run


def _compare(similarity: float, k: int, most: int, n_check: int):
    """Links between the documents of two parts, or of one with itself, that join two components."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("rep", "ascending")]).combine_chunks()
        n, rep, side = len(t), t["rep"].to_numpy(), t["side"].to_numpy()
        table = np.frombuffer(b"".join(t["pivots"].to_pylist()), np.uint8).reshape(n, len(PIVOTS)).astype(np.int8)
        fps = [t[f"fp{i}"].to_numpy().view(np.uint64) for i in range(n_check)]
        lists = t["shingles"].chunk(0) if n else pa.array([], pa.list_(pa.int64()))
        sizes = np.diff(np.asarray(lists.offsets))
        words, ids = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        label, own = np.unique(t["component"].to_numpy(), return_inverse=True)[1], bool(n) and side[0] == side[-1]
        marked, links = np.zeros(len(words), np.uint8), []
        left = np.arange(n) if own else np.flatnonzero(side == side[0])
        for a in left.tolist():
            b = np.arange(a + 1, n) if own else np.arange(len(left), n)
            b = b[(label[b] != label[a]) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-6)]
            b = b[np.abs(table[b] - table[a]).max(1, initial=0) <= k] if len(b) else b  # largest coordinate difference
            b = b[np.bitwise_count(fps[0][b] ^ fps[0][a]) <= k]
            if n_check > 1:
                b = b[sum(np.bitwise_count(f[b] ^ f[a]).astype(np.int64) for f in fps) <= most]
            if not len(b):
                continue
            mine = ids[starts[a] : starts[a + 1]]
            marked[mine] = 1
            total = sizes[b]
            at = np.repeat(starts[b] - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum())
            both = np.add.reduceat(marked[ids[at]], np.concatenate([[0], np.cumsum(total)[:-1]]), dtype=np.int64)
            marked[mine] = 0
            for x in b[both >= similarity * (sizes[a] + total - both) - 1e-9].tolist():
                if label[x] != label[a]:
                    links.append((rep[a], rep[x]))
                    label[label == label[x]] = label[a]
        return pa.table([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return tidy(run)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4, seeds: tuple[int, ...] = (42,), similarity: float | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Links need max_bits or fewer differing bits. With `similarity` instead, they need that exact
    Jaccard similarity of the sets of shingles, and the fingerprint is that of the set.
    Fingerprints only discard candidates: the angle between two sets of similarity s has cosine
    2s / (1 + s) at least, and each bit differs with probability angle / pi.

    component_id is the smallest doc_id reachable over links, the document included. Null and
    empty texts have fingerprint zero and link like any other. Rows with equal ids count as one
    document; rows with a null id belong to the component of their fingerprint and never name
    one (a component without any id is null). An empty table gives no rows; further columns of
    the input, whatever their names, are ignored.
    """
    exact = similarity is not None
    found = stored(sketches(docs, id_col, text_col, width, len(seeds)) if exact else fingerprints(docs, id_col, text_col, width, seeds), "simhash-fp")
    fps = ["set0", "set1"] if exact else [c for c in found.columns if c != "doc_id"]
    kept = [F.first(c).alias(c) for c in found.columns if exact and c not in ("doc_id", *fps)]
    classes = stored(with_coordinates(found.groupBy(*fps).agg(F.min("doc_id").alias("rep"), *kept)), "simhash-classes")
    known = classes.where("rep is not null")
    ties = found.select(F.col("doc_id").alias("a"), *fps).join(known.select(F.col("rep").alias("b"), *fps), fps).where("a <> b").select("a", "b").join(_repeated_ids(found, fps[0]), F.col("a") == F.col("doc_id"), "left_semi")
    edges = (similar(docs, known, ties, id_col, text_col, width, similarity) if exact else links(known, max_bits)).unionByName(ties)
    parts = stored(connected_components(edges), "simhash-components")
    labels = classes.join(parts, classes["rep"] == parts["node"], "left").select(*fps, F.coalesce("component", "rep").alias("component_id"))
    labels = stored(labels, "simhash-labels")
    return found.join(labels, fps).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def _repeated_ids(found: DataFrame, name: str) -> DataFrame:
    """Ids that stand on rows with different fingerprints: these tie their classes together."""
    return found.groupBy("doc_id").agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y and doc_id is not null").select("doc_id")
