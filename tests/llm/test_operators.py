"""The ten operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from slotwave.llm import bpe, components, ctw, langid, mixing, quality, sharding, simhash, substrings, vectors, warc
from slotwave.llm.shared import Words, pack, runs, unpack

from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 700}" for i in range(9000))
PLAIN = " ".join(f"word{i}" for i in range(60))


def corpus(spark):
    """The small documents with odd rows, and a column whose name clashes with the operators' own."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(None, PLAIN, "en", None), (900001, None, None, "src1"), (900002, "", "en", "src1"), (900003, " \n\t", "en", None), (900004, PLAIN + " " + PLAIN, "en", "src2"), (900005, PLAIN, "en", "src2"), (900006, LONG, "en", "src3"), (900007, PLAIN, "en", "src2"), (900007, PLAIN, "en", "src2"), (-4, "É1 \x1f  b c !!", "fr", "src9"), (900008, "a\nb\na\n\n a \nx", "de", "src1")]
    extra = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    return extra.selectExpr("*", "1 as size", "'x' as bucket", "2 as shard", "3 as kept").cache()


def key(rows):
    return sorted(rows, key=str)


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_words_and_packing():
    texts = ["A b\n c", None, "", " ", "\xe9x\tq ", "z"]
    w = Words(pa.array(texts, pa.string()))
    got = [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in (t or "").encode().split()] and w.counts.tolist() == [3, 0, 0, 0, 2, 1]
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 999, dtype=np.uint64)) * np.uint64(2)
    assert (unpack(pack(x, True), True) == x).all() and (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0
    assert all((unpack(pack(x[:n], True), True) == x[:n]).all() for n in range(20))
    assert list(runs(np.array([4, 4, 7, 2]))) == [(4, 0, 2), (7, 2, 3), (2, 3, 4)] and not list(runs(np.zeros(0, int)))
    for bits in (16, 40, 64):  # more slices than numbers, and fewer
        y = x >> np.uint64(64 - bits)
        for parts in (1, 7, 4001, 10**7):
            p = substrings._slices(y, bits, parts)
            assert (np.diff(p.astype(np.int64)) >= 0).all() and p.max() < parts


def test_hashes_of_words_that_polynomials_confuse():
    """Thue-Morse words and their complements differ in all sums of powers modulo 2**64; long words and runs of words too."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    words = [a, b, "a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 64, "a" * 65, *("x" * n + c for n in range(70) for c in "yz")]
    w = Words(pa.array([" ".join(words)]))
    assert all(len(set(w.hashes(k).tolist())) == len(set(words)) for k in (0, 1)) and not set(w.hashes(0).tolist()) & set(w.hashes(1).tolist())
    again = Words(pa.array(["q", "\n".join(words[::-1])]))
    assert again.hashes()[1:].tolist() == w.hashes()[::-1].tolist()
    for width in (1, 2, 3, 5, 7, 20):
        runs = Words(pa.array([" ".join(rng.choice("ab") for _ in range(300)) for rng in (random.Random(1), random.Random(2))]))
        at, h = runs.windows(width)
        text = [bytes(runs.data[x:y]) for x, y in zip(runs.starts, runs.ends, strict=True)]
        want = [tuple(text[i : i + width]) for i in at]
        assert len(at) == 2 * (301 - width) and len(set(zip(want, h.tolist(), strict=True))) == len(set(want)) == len(set(h.tolist()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(60)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in union_find(edges).items())


@pytest.mark.parametrize(("k", "group_rows"), [(4, 4096), (4, 50), (6, 80)])
def test_simhash_links_lose_nothing(spark, k, group_rows):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for b in list(fps)[:20] * 8:
        for _ in range(rng.randint(1, k + 1)):
            b ^= 1 << rng.randrange(64)
        fps.add(b)
    fps = np.array(sorted(fps), np.uint64)
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    df = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64))], "rep long, fp0 long")
    got = union_find((r.a, r.b) for r in simhash.links(simhash.with_coordinates(df), k, group_rows).collect())
    assert got == union_find((int(a), int(b)) for a, b in zip(*np.where(far <= k), strict=True) if a < b)


def test_simhash(spark):
    docs = corpus(spark)
    want, rows = {}, docs.collect()
    for r in rows:
        w = (r.text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        want[r.doc_id, r.text] = f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and key((r.doc_id, r.fingerprint) for r in got) == key((k[0], want[k[0], r.text]) for r in rows for k in [(r.doc_id,)])
    ids = [(r.doc_id, int(want[r.doc_id, r.text], 16)) for r in rows]
    known = [(i, f) for i, f in ids if i is not None]
    parts = union_find((a, b) for a, f in known for b, g in known if (f ^ g).bit_count() <= 4)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == parts
    assert next(r for r in got if r.doc_id is None).component_id == parts[900005]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_similarity(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = base.copy()
    near[200] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400)))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, seeds=(42, 43), similarity=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("part", [simhash.PART, 400])
def test_simhash_exact_similarity(spark, monkeypatch, part):
    """Pairs of Jaccard similarity 0.7 to 0.95, a chain, and a crowd of near copies around the limit, against brute force."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(6)
    texts = []
    for edits in (1, 2, 3, 4, 5, 6) * 12:
        base = [f"w{rng.randrange(10**7)}" for _ in range(200)]
        near = base.copy()
        for i in range(edits):
            near[10 + 30 * i] = "Changed%d" % i
        texts += [base, near]
    for i in range(12):  # each three words further from the first
        texts.append([*(f"x{j}" for j in range(3 * i)), *(f"y{j}" for j in range(3 * i, 150))])
    crowd = [f"c{i}" for i in range(120)]
    for i in range(60):
        texts.append([*crowd[: 60 + i % 7], *(f"n{i}_{j}" for j in range(i % 7)), *crowd[60 + i % 7 :]])
        for at in rng.sample(range(len(texts[-1])), 1 + i % 3):
            texts[-1][at] = f"e{i}"
    texts += [["one", "two"], ["ONE", "two"], ["one", "three"], [], []]
    sets = [set(zip(*[[w.lower() for w in t][i:] for i in range(5)], strict=False)) if len(t) > 4 else {tuple(w.lower() for w in t)} for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = simhash.near_duplicates(df, width=5, seeds=(42, 43), similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == union_find(alike)


def test_ctw_counts_and_base(spark):
    docs = corpus(spark)
    rows, counts, total = docs.collect(), collections.Counter(), 0
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    for r in rows:
        if not held(r.doc_id):
            counts.update(tokens(r.text))
            total += len(tokens(r.text))
    size = total + 0.5 * (len(counts) + 1)
    want = [(r.doc_id, held(r.doc_id), len(tokens(r.text)), sum(counts[t] > 0 for t in tokens(r.text)), total, round(sum(math.log10((counts[t] + 0.5) / size) for t in tokens(r.text)), 5)) for r in rows]
    got = ctw.score_documents(docs).collect()
    assert key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == key(want)
    assert all(r.score < 0 for r in got)
    assert ctw.score_documents(docs.limit(0)).count() == 0


def test_ctw_is_a_probability_and_weights_by_evidence():
    text = pa.chunked_array([pa.array(["abab abab abab cdcd cdcd", "abab x"] * 5)])
    depth = 4
    grams, counts = ctw._tally(text, np.ones(10, bool), depth)[0]
    levels = ctw.deep_levels(grams, counts, depth)
    low = levels[-1]
    nodes, at = np.unique(ctw.parent(low.keys, 2), return_inverse=True)
    n0, n1, below = (np.bincount(at, x, len(nodes)) for x in (low.n0, low.n1, low.weighted))
    levels += ctw.top_levels(nodes, n0.astype(np.int64), n1.astype(np.int64), below)
    context = np.uint64(int.from_bytes(b"baba", "big") << 8)
    p = 10 ** ctw.log10_probability(context | np.arange(256, dtype=np.uint64), levels, depth)
    assert math.isclose(p.sum(), 1.0) and p[ord("b")] > 0.9
    unseen = np.uint64(int.from_bytes(b"zzzz", "big") << 8) | np.arange(256, dtype=np.uint64)
    assert math.isclose((10 ** ctw.log10_probability(unseen, levels, depth)).sum(), 1.0)
    # Krichevsky-Trofimov: sequential estimates multiply to the block probability
    want = math.log(0.5 / 1 * 1.5 / 2 * 0.5 / 3)
    assert math.isclose(float(ctw.kt_log(np.array([2]), np.array([1]))[0]), want)
    big = ctw.kt_log(np.array([5000]), np.array([9000]))[0]
    assert math.isclose(big, math.lgamma(5000.5) + math.lgamma(9000.5) - math.lgamma(14001) - math.log(math.pi), rel_tol=1e-12)


def test_ctw_score_against_recursion(spark):
    """Counts, weights and mixture of every node by dictionaries and recursion, for texts in several buckets."""
    depth, rng = 3, random.Random(9)
    rows = [(i, " ".join(rng.choice(["Ab", "abc", "b", "cab", "é"]) for _ in range(rng.randint(0, 12)))) for i in range(14)] + [(20, None), (21, "never zq seen"), (None, "ab abc")]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    normal = lambda t: b"\n" * depth + b" ".join(re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in (t or "").encode().split()) + b"\n"
    counts, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    places = lambda s: ((s[i - depth : i], s[i]) for i in range(depth, len(s)))
    for i, t in rows:
        if not held(i):
            for context, byte in places(normal(t)):
                for j in range(8):
                    known = (1 << j) | (byte >> (8 - j))
                    for d in range(depth + 1):
                        node = (context[depth - d :], known)
                        counts[node][byte >> (7 - j) & 1] += 1
                        if d:
                            children[node[0][1:], known].add(node)

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)

    def weighted(node):
        own = kt(counts[node])
        return own if len(node[0]) == depth else np.logaddexp(own, sum(weighted(c) for c in children[node])) - math.log(2)

    def chance(context, byte):
        total = 0.0
        for j in range(8):
            known, one, below = (1 << j) | (byte >> (8 - j)), 0.5, False
            for d in range(depth, -1, -1):
                node = (context[depth - d :], known)
                if node in counts and sum(counts[node]):
                    stay = math.exp(kt(counts[node]) - math.log(2) - weighted(node)) if below else 1.0
                    one = stay * (counts[node][1] + 0.5) / (sum(counts[node]) + 1) + (1 - stay) * one
                    below = True
            total += math.log10(one if byte >> (7 - j) & 1 else 1 - one)
        return total

    got = {(r.doc_id, r.n_bytes): r for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        s = normal(t)
        r = got[i, len(s) - depth]
        assert math.isclose(r.score, sum(chance(*p) for p in places(s)), rel_tol=1e-5) and math.isclose(r.bits_per_byte, -r.score * math.log2(10) / r.n_bytes)


def brute_quality(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality(spark):
    docs = corpus(spark)
    got = quality.quality(docs).collect()
    assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == key((r.doc_id, *brute_quality(r.text)) for r in docs.collect())
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.quality(docs.limit(0)).count() == 0


def body(i):
    return " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))


def test_quality_lines(spark):
    """Lines of more than five documents of a host, against brute force; nulls, repeated ids and repeated rows among them."""
    spam = "Buy  now 1 " + " ".join("s" + chr(97 + k) for k in range(20))
    rows = [(i, f"{body(i)}\n{spam}", "h") for i in range(8)] + [(50, "\n".join([spam.upper(), "another common line " * 20]), "h")] + [(60 + i, f"common copy\n{body(99)}", "h") for i in range(9)] + [(80, f"{body(80)}\n{spam}", "other")]
    rows += [(7, f"{body(7)}\n{spam}", "h"), (7, f"{body(31)}\n{spam}\n{spam}", "h"), (None, f"{body(32)}\n{spam}", "h"), (None, f"{body(33)}\n{spam}", None), (None, None, "h"), (90, "", None)]
    rows += [(200 + i, f"rare {i}\n{'five of them ' * 9}\n{body(40 + i)}", "h") for i in range(5)] + [(204, f"{'five of them ' * 9}\n{body(60)}", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as host", "1 as th", "2 as line", "3 as row", "4 as gone", "5 as salt")
    normal = lambda line: " ".join(re.sub("[0-9]", "0", w.lower()) for w in WORD.findall(line))
    holders = collections.defaultdict(set)
    for i, t, h in rows:
        for line in (t or "").split("\n"):
            holders[h, normal(line)].add(i if i is not None else t)
    want = []
    for i, t, h in rows:
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n, gone = len(WORD.findall(t or "")), sum(len(WORD.findall(x)) for x in lines if len(holders[h, normal(x)]) > 5)
        want.append((i, gone, n >= 5 and n - gone >= 0.5 * n))
    options = {"max_docs": 5, "min_words": 5, "max_repeat": 1.0, "min_left": 0.5}
    assert key((r.doc_id, r.n_line_words_removed, r.kept) for r in quality.quality(docs, **options).collect()) == key(want)
    cleaned = quality.clean(docs, **options)
    left = [(i, "\n".join(x for x in t.split("\n") if len(holders[h, normal(x)]) <= 5), h) for (i, t, h), (_, _, kept) in zip(rows, want, strict=True) if kept]
    assert cleaned.columns == docs.columns and key((r.doc_id, r.text, r.source) for r in cleaned.collect()) == key(left)
    # copies count once, and the first holder keeps the line
    spared = {r.doc_id: (r.n_line_words_removed, r.kept) for r in quality.quality(docs, by_content=True, first_keeps=True, **options).collect() if r.doc_id not in (None, 7)}
    assert spared[0] == (0, True) and spared[3] == (23, True) and spared[50][0] == 23 and spared[62] == (0, True) and spared[80] == (0, True)
    assert quality.clean(docs.limit(0)).count() == 0


def test_mixing(spark):
    docs = corpus(spark)
    rows = mixing.with_copies(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    assert len(rows) == docs.count()
    for r in rows:
        assert r.mix_size == size(r.text) and r.mix_source_size == sizes[r.source] and math.isclose(r.mix_target, target[r.source], rel_tol=1e-9) and 0 <= r.mix_copies <= 2
    assert key((r.doc_id, r.mix_copies) for r in mixing.with_copies(docs).collect()) == key((r.doc_id, r.mix_copies) for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.mix_copies for r in rows)
    assert mixing.with_copies(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 as mix_note", "2 as mix_rate", "3 as mix_source", "4 as mix_size", "5 as rate", "6 as id", "7 as own", "8 as target", "9 as nth", "10 as in0")
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).where("mix_rate = 2 and mix_size = 4 and rate = 5 and nth = 9 and in0 = 10 and mix_note = 1").count() == mixed.count()
    assert set(mixing.with_copies(clash).columns) == set(clash.columns) | set(mixing.ADDED) and mixing.with_copies(clash).where("mix_rate = 2").count() == len(rows)


@pytest.mark.parametrize("rows", ["null", "same", "repeated"])
def test_mixing_without_ids(spark, monkeypatch, rows):
    """Rows without an id, of one id, and fully equal rows are taken near their sources' targets too, the same on every run."""
    monkeypatch.setattr(mixing, "CELL_ROWS", 50)
    text = "'five words that repeat here'" if rows == "repeated" else "concat('these are five words ', id)"
    docs = spark.range(3000).repartition(7).selectExpr("cast(null as long) as doc_id" if rows == "null" else "7L as doc_id", f"{text} as text", "concat('src', id % 3) as source", "id as `n.th`")
    got = mixing.with_copies(docs).collect()
    again = mixing.with_copies(docs.repartition(3)).select("doc_id", "text", "source", "mix_copies")
    assert key((r.doc_id, r.text, r.source, r.mix_copies) for r in got) == key(tuple(r) for r in again.collect())
    for source in ("src0", "src1", "src2"):
        mine = [r for r in got if r.source == source]
        assert len(mine) == 1000 and abs(sum(r.mix_copies * r.mix_size for r in mine) / mine[0].mix_target - 1) < 0.08
    assert sorted(r["n.th"] for r in got) == list(range(3000))
    monkeypatch.setattr(mixing, "SMALL_ROWS", 0)  # by exchanges in place of broadcasts
    assert key((r.doc_id, r.text, r.source, r.mix_copies) for r in mixing.with_copies(docs).collect()) == key((r.doc_id, r.text, r.source, r.mix_copies) for r in got)


def test_mixing_sql(spark):
    import duckdb

    from slotwave.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found = con.execute(ORACLE_SQL["op4_mixing"])
    names = [x[0] for x in found.description]
    plain = lambda rows: key(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(found.fetchall()) == plain(tuple(r[c] for c in names) for r in QUERIES["op4_mixing"](spark, SMALL).collect())
    odd = "select * from documents union all select * from documents where doc_id < 5 union all select null, text, lang, source, n_chars from documents where doc_id < 9 union all select null, text, lang, source, n_chars from documents where doc_id < 4"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.createOrReplaceTempView("documents")
    got = mixing.with_copies(spark.sql(odd)).selectExpr("doc_id", "mix_size as size", "mix_source_size as source_size", "mix_target as target", "mix_size * mix_copies as taken").select(names)
    con.execute(f"create table t as {odd}; drop view documents; create view documents as select * from t")
    assert plain(con.execute(ORACLE_SQL["op4_mixing"]).fetchall()) == plain(tuple(r) for r in got.collect())


def test_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.read_ranks(path)
    know = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    docs = corpus(spark)
    rng = random.Random(0)
    pieces = ["a", " the", "é", "日本", "\U0001f642", "  ", "\n", "1", "!", "‍", "\xa0", "\x1c", "\x85", "'s", "<s>", "▁", "\x00"]
    odd = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(200)] + ["x" * 100_000, "".join(rng.choice("abc") for _ in range(50_000))]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = key((r.doc_id, np.array(know.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    got = bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()
    assert key((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want and all(r.n_tokens * 4 == len(r.ids) for r in got)
    digest = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, digests=True).collect()
    assert key((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in digest) == key((i, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) for i, a, b in want)


@pytest.mark.parametrize("chunk_rows", [8192, 60])
def test_vectors(spark, chunk_rows):
    rng = np.random.default_rng(0)
    base = rng.standard_normal(64)
    rows = [(i, (base + rng.standard_normal(64) * s).tolist()) for i, s in enumerate(np.linspace(0.05, 0.6, 60))] + [(100 + i, rng.standard_normal(64).tolist()) for i in range(150)]
    rows += [(500, None), (501, [0.0] * 64), (502, [1.0, float("nan")]), (503, []), (504, [1.0, 2.0]), (505, [2.0, 4.0]), (506, [1.0, 2.0]), (507, [float("inf")]), (508, [None, 1.0]), (None, [1.0, 2.0]), (510, [1e-200] * 64), (511, [1e200] * 64), (512, [-0.0, 1.0]), (513, [0.0, 1.0]), (514, [1.0] * 64), (514, (3 * base).tolist())]
    far, bit = rng.standard_normal(64), rng.standard_normal(64) * 0.1
    rows += [(601, far.tolist()), (None, (far + bit).tolist()), (610, (far * 1e180).tolist()), (611, ((far + bit) * 1e180).tolist()), (None, (far + 4.5 * bit).tolist()), (612, (far + 8 * bit).tolist()), (None, (-far).tolist())]
    good = [r[1] is not None and len(r[1]) > 0 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    links, edges = [0] * len(rows), []
    for i, (_, x) in enumerate(rows):
        for j in range(i):
            y = rows[j][1]
            if good[i] and good[j] and len(x) == len(y):
                a, b = (np.array(v) / np.abs(v).max() for v in (x, y))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    edges.append((i, j))
    edges += [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[i][0] == rows[j][0]]
    part = union_find(edges)
    group = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            group[part.get(i, i)].append(r[0])
    want = [(r[0], links[i], min(group[part.get(i, i)], default=None)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "2 as dims")
    got = vectors.near_duplicates(df, chunk_rows=chunk_rows).collect()
    assert key((r.vec_id, r.n_links, r.component_id) for r in got) == key(want)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    if chunk_rows == 60:
        assert vectors.near_duplicates(df.limit(0)).count() == 0


def plain_lpt(sizes, shards):
    """Groups of the same size in any order: the multiset of sizes that each shard takes."""
    load, out = [0] * shards, [collections.Counter() for _ in range(shards)]
    for s in sorted(sizes, reverse=True):
        i = min(range(shards), key=lambda j: (load[j], j))
        load[i] += s
        out[i][s] += 1
    return out


def test_deal():
    rng = random.Random(3)
    for _ in range(200):
        shards = rng.randint(1, 7)
        sizes = [rng.choice([1, 2, 3, 3, 7, 50, 1000]) for _ in range(rng.randint(1, 60))]
        plan = sharding.lpt(list(collections.Counter(sizes).items()), shards)
        assert [collections.Counter({s: t[i] for s, t in plan if t[i]}) for i in range(shards)] == plain_lpt(sizes, shards)
    assert sum(sharding.deal([10**15, 0, 5], 3, 10**12)) == 10**12


def test_sharding(spark):
    docs = corpus(spark)
    for size_cells, cell_rows in ((1024, 1000), (3, 3)):
        got = sharding.shard_documents(docs, 16, size_cells=size_cells, cell_rows=cell_rows).collect()
        text = lambda t: (t or "").encode()
        assert key((r.doc_id, r.size, r.text_crc32) for r in got) == key((r.doc_id, len(text(r.text)) + 1, zlib.crc32(text(r.text))) for r in docs.collect())
        slots, groups = collections.defaultdict(list), collections.Counter(text(r.text) for r in docs.collect())
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
        # each group on one shard, and on each shard the sizes that one group after the other would bring there
        where = {(r.size, r.text_crc32): r.shard for r in got}
        assert all(where[r.size, r.text_crc32] == r.shard for r in got)
        placed = [collections.Counter() for _ in range(16)]
        for t, n in groups.items():
            placed[where[len(t) + 1, zlib.crc32(t)]][n * (len(t) + 1)] += 1
        assert placed == plain_lpt([n * (len(t) + 1) for t, n in groups.items()], 16)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("split", [40, 300, 1 << 22])
def test_warc(spark, split):
    rows = [(1, "http://a/\n", "x" * 200), (2, "u", "x" * 200), (3, None, None), (4, "u", "é" * 60), (5, "u", "é" * 60), (6, "u", "short"), (7, "u", "short"), (None, "u", "x" * 200), (9, "u", "\x1fq\r\n\r\nWARC/1.1" * 500), (1, "again", "x" * 200), (11, "u", "".join(chr(33 + (i * i * 7 + i // 3) % 90) for i in range(700_000)))]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), split_bytes=split).collect()
    first = {"x" * 200: 1, "é" * 60: 4}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and html in first and i != first[html]
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == key(want)
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_substrings(spark):
    docs = corpus(spark)
    seen, want = set(), []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")):
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            x = tuple(w[s : s + 20])
            if x in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(x)
        want.append((r.doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    for most in (substrings.BUCKET_BYTES, 20000):
        got = substrings.deduplicate(docs, digest=True, bucket_bytes=most)
        assert key((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == key(want)
    carried = substrings.deduplicate(docs, carry=True, layout=True).where("doc_id = -4").first()
    assert carried.kept == "É1 \x1f  b c !!" and carried.rest.source == "src9"
    assert substrings.deduplicate(docs.limit(0)).count() == 0


def test_substrings_of_confusing_words(spark):
    """A Thue-Morse word and its complement, each before the same 19 words: no window is shared. Then many rows without an id."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    tail = " ".join(f"t{i}" for i in range(19))
    rows = [(i, "".join("ab"[x ^ i] for x in bits) + " " + tail) for i in (0, 1)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0}
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + " " + passage) for _ in range(40)] + [(3, passage)] * 2 + [(3, "x " + passage)]
    rows = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as bucket", "1 as rest", "2 as kept", "3 as slice")
    for kwargs in ({}, {"bucket_bytes": 500}):
        got = substrings.deduplicate(rows, carry=True, **kwargs).collect()
        assert len(got) == 43 and sorted((r.doc_id or 0, r.n_removed) for r in got)[:40] == [(0, 25)] * 40 and sorted(r.n_removed for r in got if r.doc_id == 3) == [0, 25, 25] and all(r.rest.slice == 3 for r in got)


def test_marginals_against_plain_forward_backward(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 5)
    rng = np.random.default_rng(0)
    first = np.cumsum([0, 0, 1, 3, 5, 6, 17, 0, 23])
    emit, move = rng.standard_normal((first[-1], 3)) * 2, rng.standard_normal((3, 3))
    got = langid.marginals(emit, first, move)
    for a, b in zip(first[:-1], first[1:], strict=True):
        e, f, alpha = np.exp(emit[a:b]), np.ones(3) / 3, []
        for t in range(b - a):
            f = (f @ np.exp(move)) * e[t]
            alpha.append(f)
        beta = np.ones(3)
        for t in range(b - a - 1, -1, -1):
            p = alpha[t] * beta
            assert np.allclose(got[a + t], p / p.sum())
            beta = np.exp(move) @ (e[t] * beta)


def test_gradient_by_differences():
    """The gradient of the log-likelihood against differences of a likelihood summed over all label paths."""
    rng = np.random.default_rng(3)
    tokens = np.array([[0, 1, 2, 1], [2, 0, -1, -1]])
    kind, gold = np.array([0, 1, 2]), np.array([0, 1, 1])
    emit, move = rng.standard_normal((3, 2)), rng.standard_normal((2, 2))

    def likelihood(e, m):
        total = 0.0
        for row in tokens:
            row = row[row >= 0]
            score = lambda path, r=row: sum(e[kind[t], k] for t, k in zip(r, path, strict=True)) + sum(m[a, b] for a, b in zip(path, path[1:], strict=False))
            # the first word is entered from either label with the same weight
            start = lambda path: math.log(np.exp(m[:, path[0]]).sum())
            paths = list(itertools.product((0, 1), repeat=len(row)))
            total += score(gold[row]) + start(gold[row]) - math.log(sum(math.exp(score(p) + start(p)) for p in paths))
        return total

    words, moves = langid._gradient(tokens, kind, gold, emit, move)
    for i in range(3):
        for k in range(2):
            step = np.zeros((3, 2))
            step[i, k] = 1e-5
            assert math.isclose(words[i, k], (likelihood(emit + step, move) - likelihood(emit - step, move)) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)
    # transitions inside the sequence only: the entry into the first word is not counted
    inner = lambda m: likelihood(emit, m)
    assert moves.shape == (2, 2) and abs(moves.sum()) < 1e-9 and np.isfinite(inner(move))


def test_language(spark):
    docs = corpus(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id is not None}
    truth = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None}
    # one text of a million words among short ones, and equal predictions for equal texts
    long = spark.createDataFrame([(1, " ".join([r.text for r in docs.where("lang = 'fr' and doc_id is not null").limit(3).collect()] * 3000), "fr"), (2, PLAIN, None), (3, PLAIN, None)], "doc_id long, text string, lang string")
    few = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", "lang").where("doc_id < 0 or doc_id > 3").unionByName(long)).where("doc_id between 1 and 3").collect()}
    assert few[1].lang_pred == "fr" and (few[2].lang_pred, few[2].score) == (few[3].lang_pred, few[3].score)
    held = [i for i, r in got.items() if r.held_out and r.lang_pred != "und" and i < 900000 and i >= 0]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.9 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900001, 900002, 900003))
    mixed = spark.createDataFrame([(1, next(r.text for r in docs.collect() if r.lang == "en" and r.doc_id) + " " + next(r.text for r in docs.collect() if r.lang == "fr" and r.doc_id), None)], "doc_id long, text string, lang string")
    switched = langid.identify(docs.select("doc_id", "text", "lang").unionByName(mixed)).where("doc_id = 1 and n_switches >= 1").count()
    assert switched >= 1
    assert langid.identify(docs.limit(0)).count() == 0 and {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def plain_posteriors(log_emit, move):
    """Forward-backward one word after the other, in exact enough sums of exponentials."""
    n, k = log_emit.shape
    forward, backward = [None] * n, [None] * n
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    before = [0.0] * k  # every label may come first
    for t in range(n):
        before = [add([before[i] + move[i][j] for i in range(k)]) + log_emit[t][j] for j in range(k)]
        forward[t] = before
    after = [0.0] * k
    for t in range(n - 1, -1, -1):
        backward[t] = after
        after = [add([move[i][j] + log_emit[t][j] + after[j] for j in range(k)]) for i in range(k)]
    out = []
    for f, b in zip(forward, backward, strict=True):
        total = add([x + y for x, y in zip(f, b, strict=True)])
        out.append([math.exp(x + y - total) for x, y in zip(f, b, strict=True)])
    return out


def test_langid_predictions_against_plain_forward_backward(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    mixed = [r.text for r in docs.where("doc_id in (3, 8, 14)").collect()]
    odd = [(None, " ".join(x.split()[k] for k in range(20) for x in mixed)), (-7, "12 34 !! a"), (-8, "--- ..."), (-9, mixed[0] + " " + mixed[1])]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None) for i, t in odd], docs.schema))
    rows = docs.select("doc_id", "text", "lang")
    model = langid.fit(*langid.training_sample(rows, 300, 4, 2, 1 << 17))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in docs.where("doc_id is null or doc_id < 12").collect():
        w = Words(pa.array([r.text or ""]), lower=True)
        log_emit, letter = langid.emissions(model, w)
        post = [p for p, there in zip(plain_posteriors(log_emit, model.move.tolist()), letter, strict=True) if there]
        if not post:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        votes = [sum(p[k] for p in post) for k in range(len(model.labels))]
        best = max(range(len(votes)), key=votes.__getitem__)
        top = [max(range(len(p)), key=p.__getitem__) for p in post]
        assert got[r.doc_id].lang_pred == model.labels[best] and math.isclose(got[r.doc_id].score, votes[best] / len(post), rel_tol=1e-6)
        assert got[r.doc_id].n_switches == sum(a != b for a, b in zip(top, top[1:], strict=False))
