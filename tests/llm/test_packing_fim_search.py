"""Packing, fill-in-middle and ranked search against brute force and SQL."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from slotwave.llm import fim, packing, search
from slotwave.llm import queries as Q

from ..conftest import SMALL

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n", "a<S>b", "<P>", "<M><P", "İstanbul ΣΑΣ ß ẞ", "a\x1cb c\x00d", "don't I'LL we'VE 12²½ x́y é", "<|endoftext|> a<|startoftext|>", "日本語 テキスト 𝒳", "q" * 5000, "ª º µ × ­soft ŉ\x7f \x85 x", "ﬁ Ǆ", "Same again.", "Same again."]


def corpus(spark):
    """The small documents with odd rows, repeated and null ids, and columns whose names clash with the operators' own."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(900000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (None, "no id here"), (900015, "Same again."), (-5, "the long one " * 30000), (900100, "w" * 1_500_000 + " end")]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 as length", "'x' as `a.b`", "2 as output", "3 as m", "4 as query", "5 as piece", "6 as form").cache()


@pytest.mark.parametrize("name", ["op12_fim", "op13_search"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = con.execute(Q.ORACLE_SQL[name])
    df = Q.QUERIES[name](spark, SMALL)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns) and sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.collect())


# ---- packing


def plain_best_fit(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if size - sum(b) >= x]
        if fits:
            max(fits, key=sum).append(x)
        else:
            bins.append([x])
    return bins


def steps_left(bins, size):
    """Whether some move, one-for-one, two-for-one or one-for-two exchange of two bins raises the sum of squares."""
    bins = [b for k, n in bins.items() for b in [k] * n if sum(k) < size]
    give = lambda b: [()] + [(x,) for x in b] + list(itertools.combinations(b, 2))
    for a, b in itertools.permutations(bins, 2):
        for x, y in itertools.product(give(a), give(b)):
            d = sum(y) - sum(x)
            if len(x) + len(y) <= 3 and 0 < d <= size - sum(a) and sum(a) + d > sum(b):
                return True
    return False


def test_local_search():
    rng, better = random.Random(1), 0
    for _ in range(200):
        size = rng.choice([7, 20, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 60))]
        first = packing.best_fit(collections.Counter(lengths), size)
        assert sorted(x for b, n in first.items() for x in b * n) == sorted(lengths) and sum(first.values()) == len(plain_best_fit(lengths, size))
        last = packing.local_search(first, size)
        assert sorted(x for b, n in last.items() for x in b * n) == sorted(lengths) and max(map(sum, last)) <= size and sum(last.values()) <= sum(first.values())
        squares = lambda bins: sum(sum(b) ** 2 * n for b, n in bins.items())
        assert squares(last) >= squares(first) and (len(lengths) > 30 or not steps_left(last, size))
        better += sum(last.values()) < sum(first.values())
    assert better  # bins were emptied that best fit needs
    assert packing.plan({3: 1, 4: 3, 5: 2, 7: 10**12}, 10).total() == 10**12 + 3
    with pytest.raises(ValueError, match="does not fit"):
        packing.best_fit({11: 1}, 10)


def checked_packing(rows, size):
    """Number of sequences, after a check that none is over full and offsets are gapless."""
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *itertools.accumulate(n for _, n in parts[:-1])] and sum(n for _, n in parts) <= size
    return len(seqs)


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(spark, size):
    from tokenizers import Tokenizer

    docs = corpus(spark).where("doc_id is null or doc_id < 60 or doc_id >= 900000 or doc_id = -5")
    whole = Tokenizer.from_file(MODEL)
    whole.encode_special_tokens = True
    rows = packing.pack(docs, MODEL, size).collect()
    want = []
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k // size, k, np.array(ids[k : k + size], "<u4").tobytes()) for k in range(0, len(ids), size)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, bytes(r.ids))) for r in rows) and all(len(r.ids) == 4 * r.length for r in rows)
    n, total = checked_packing(rows, size), sum(r.length for r in rows)
    assert n <= packing.best_fit(collections.Counter(r.length for r in rows), size).total() and n <= 1.02 * total / size + 1
    assert packing.pack(docs.limit(0), MODEL, size).count() == 0


def test_packing_segments(monkeypatch):
    """Long texts are read in segments, and memories emptied or hashes shared, without any change of the ids."""
    text = "some words of a long text, and " * 20 + "x" * 300 + " end"
    words = packing.WordTokens(open(MODEL, encoding="utf-8").read())  # noqa: SIM115
    want = words.whole.encode(text, add_special_tokens=False).ids
    assert packing._ended(words, pa.array([text]))[0].tolist() == [*want, 0]
    monkeypatch.setattr(packing, "SEGMENT", 50)
    assert len(list(packing._segments(text.encode()))) > 5
    for remembered in (10**6, 3):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        monkeypatch.setattr(packing, "REMEMBERED_PIECES", remembered)
        ids, n = packing._ended(words, pa.array([text]))
        assert ids.tolist() == [*want, 0] and n.tolist() == [len(ids)]
    ids, n = packing._ended(words, pa.array(["a b", None, "", text]))
    assert n.tolist() == [3, 1, 1, len(want) + 1] and ids.tolist() == [*words.whole.encode("a b", add_special_tokens=False).ids, 0, 0, 0, *want, 0]
    words.other[:] = 0  # as if all first hashes were shared by other words
    assert packing._ended(words, pa.array([text]))[0].tolist() == [*want, 0]


def test_place(spark):
    """One length held by most rows, other columns carried, errors for lengths that fit nowhere."""
    rows = spark.range(3000).selectExpr("id", "case when id % 3 < 2 then 40 else 1 + id % 97 end as length", "'q' as `x.y`", "7 as offset")
    out = packing.place(rows, 100, cell_rows=50)
    got = out.collect()
    assert out.columns == ["id", "length", "x.y", "sequence_id", "offset"] and sorted(r.id for r in got) == list(range(3000))
    assert checked_packing(got, 100) <= len(plain_best_fit([r.length for r in got], 100))
    for bad in (0, None, 101):
        with pytest.raises(ValueError, match="piece"):
            packing.place(spark.createDataFrame([(bad,)], "length long"), 100)


def test_packing_query(spark):
    rows = Q.QUERIES["op11_packing"](spark, SMALL)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in packing.pieces(spark.read.parquet(f"{SMALL}/documents.parquet"), MODEL).collect()}
    got = rows.collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == full and len(got) == len(full)
    assert checked_packing(got, 2048) <= 1 + 1.01 * sum(r.length for r in got) / 2048


# ---- fill in middle


def brute_fim(i, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, z = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(s in t for s in fim.SENTINELS) or h3 % 100 >= 90:
        return (i, len(t), "plain", None, None, t)
    p, m, s = t[:a], t[a:z], t[z:]
    return (i, len(t), "spm", a, z - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (i, len(t), "psm", a, z - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim(spark):
    docs = corpus(spark)
    out = fim.restore(fim.transform(docs)).collect()
    want = [brute_fim(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out)
    assert sorted((r.text or "") for r in docs.collect()) == sorted(r.restored for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0 and fim.restore(fim.transform(docs.limit(0))).count() == 0


@pytest.mark.parametrize("unit", fim.UNITS)
def test_fim_blocks(monkeypatch, unit):
    """A long text in many lists is cut like one in a single list; its pieces add up to it."""
    text, rng = "  Eén wörd 漢字 and\tmore 𝒳 words " * 9, np.random.default_rng(0)
    for _ in range(20):
        h = rng.integers(0, 2**32, 2)
        args = pa.array([text]), h[:1], h[1:], unit
        monkeypatch.setattr(fim, "BLOCK_BYTES", 1 << 20)
        n, one = fim._cut(*args)
        monkeypatch.setattr(fim, "BLOCK_BYTES", 23)
        same, many = fim._cut(*args)
        units = re.findall(r"(?s).", text) if unit == "chars" else re.findall(r"[^ \t]+[ \t]*|^[ \t]+", text)
        a, z = sorted((h % (n + 1)).tolist())
        want = ["".join(units[:a]), "".join(units[a:z]), "".join(units[z:])]
        assert n == same == len(units) and [[x[0].as_py().decode() for x in p] for p in (one, many)] == [want, want]


def test_fim_options(spark):
    docs = spark.createDataFrame([(i, f"alpha beta {i} gamma") for i in range(200)], "doc_id long, text string")
    out = fim.restore(fim.transform(docs, sentinels=("«p»", "«s»", "«m»"), unit="words", fim_percent=100, spm_percent=0, seed=9), ("«p»", "«s»", "«m»")).collect()
    assert all(r.form == "psm" and r.n == 4 and r.restored == f"alpha beta {r.doc_id} gamma" and r.output.startswith("«p»") for r in out)
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aXa", "b", "c"), ("xy", "yz", "w"), ("ab", "abc", "d")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.transform(docs, sentinels=bad)
    with pytest.raises(ValueError, match="unit"):
        fim.transform(docs, unit="bytes")


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=10):
    tf = [(i, collections.Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in tf), sum(c.total() for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        times, scored = collections.Counter(TERM.findall((text or "").translate(LOW))), []
        for i, c in tf:
            if c:
                m = 100 - 75 + (75 * c.total() * n_docs) // total
                s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in times.items() if c[t])
                if s > 0:
                    scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_search(spark):
    docs, items = corpus(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    long = " ".join(r.text for r in items.limit(5).collect())
    items = items.unionByName(spark.createDataFrame([(None, "Same again"), (None, None), (700, ""), (701, "no id HERE, é ΣΑΣ"), (702, "Same again"), (702, "zzznothing"), (703, long), (704, "end " * 50)], items.schema)).selectExpr("*", "1 as doc_id", "2 as score", "3 as rank")
    got = [tuple(r) for r in search.search(docs, items).collect()]
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 300
    assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0
    some = items.where("item_id < 12")
    blocks = search.search(docs, some, k=3, block_bytes=500).collect()  # several blocks of queries
    assert sorted(map(str, map(tuple, blocks))) == sorted(map(str, brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in some.collect()], 3)))


def test_search_visits_strata_by_bound(monkeypatch):
    """Ties, many strata and little held at once; strata are left out, results stay those of all documents."""
    rng = random.Random(3)
    words = [f"t{i}" for i in range(40)]
    queries = search.Queries([" ".join(rng.choices(words, k=6)) for _ in range(30)] + ["", None])
    width, weight = len(queries.h0), np.array([rng.randint(0, 9000) for _ in queries.h0])
    m = np.sort(np.array([rng.randint(30, 400) for _ in range(900)]))
    docs = [sorted(rng.sample(range(width), rng.randint(1, 6))) for _ in m]
    tfs = [[rng.randint(1, 4) for _ in d] for d in docs]
    index = search.Strata(m, np.concatenate(docs), np.concatenate(tfs), np.array([len(d) for d in docs]), width)
    seen = 0
    for terms, times in queries.terms:
        score = np.zeros(len(m), np.int64)
        for x, (d, f) in enumerate(zip(docs, tfs, strict=True)):
            score[x] = sum(int(times[list(terms).index(t)] * weight[t]) * (10**9 * n // (1000 * n + 8 * int(m[x]))) for t, n in zip(d, f, strict=True) if t in terms)
        at, got = index.visit(terms, times * weight[terms], 1, 10)
        seen += len(at)
        want = np.lexsort((np.arange(len(m)), -score))[:10]
        want = want[score[want] > 0]
        best = at[np.lexsort((at, -got))][:10]
        assert best.tolist() == want.tolist() and (score[at] == got).all()
        exact = search._sums(np.array([0, 2, 0]), np.array([1 << 60, 5, 1]), 3, False)
        assert exact.tolist() == [(1 << 60) + 1, 0, 5]
    assert seen < 30 * 100
