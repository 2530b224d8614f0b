"""The pipeline on planted cases."""

import random

import numpy as np
import pytest

from ..conftest import SMALL

pipeline = pytest.importorskip("corpus_pipeline")


def test_planted_cases(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    passage, base = text(60), text(300)
    near = base.split()
    near[150] = "changed"
    rows = [(i, text(200)) for i in range(20)] + [(30, base), (31, base), (32, " ".join(near)), (40, text(100) + " " + passage), (41, text(100) + " " + passage), (50, "too short"), (51, "same again " * 80), (52, None), (53, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality":
            assert ids == {*range(20), 30, 31, 32, 40, 41}
        if name == "near_duplicates":
            assert ids == {*range(20), 30, 40, 41}
    left = {r.doc_id: r for r in docs.collect()}
    given = dict(rows)
    assert all(left[i].text == given[i] and left[i].n_chars == len(given[i]) for i in [*range(20), 30, 40])
    assert left[41].text == given[41].removesuffix(" " + passage)
    mixed = pipeline.mixing_stage(spark, docs, SMALL)
    ids = pipeline.encoding_stage(spark, mixed, SMALL).collect()
    assert len(ids) == mixed.count() and all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens for r in ids)


def test_odd_rows(spark):
    """Each stage with repeated rows, null ids, ties, long texts, nulls, and columns with dots and clashing names."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    twice, lost, long = text(120), text(130), text(150_000)
    rows = [(i, text(100)) for i in range(6)] + [(10, twice), (10, twice), (None, lost), (None, lost), (None, text(90)), (12, text(80) + " " + "v" * 500_000), (13, long), (14, None), (None, None), (15, ""), (16, text(70)), (16, text(75))]
    docs = spark.createDataFrame([(i, t, "en", f"src{k % 2}" if k % 5 else None, 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'d' as `a.b`", "'x' as bucket", "2 as rep", "3 as row", "4 as th", "true as kept", "6 as rest", "7 as size", "8 as key", "9 as nth", "'y' as `key.nth`", "10 as component_id", "11 as host", "12 as id", "13 as own")
    columns = docs.columns
    # rows kept by each stage: of equal rows and null ids nothing goes before the substrings, where the first of equal texts keeps its words
    want = {"quality": 15, "near_duplicates": 15, "substrings": 13}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        if name in want:
            assert docs.count() == want[name], name
        assert docs.where("`a.b` <> 'd' or `key.nth` <> 'y' or rep <> 2 or nth <> 9 or own <> 13").isEmpty(), name
        if name != "mixing":
            assert {r.doc_id for r in docs.collect()} == {*range(6), 10, None, 12, 13, 16} and docs.where("doc_id = 13").first().text == long
    out = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(out) == docs.count() > 5 and all(len(r.ids) == 4 * r.n_tokens for r in out)


def test_run(spark):
    out = pipeline.run(spark, SMALL)
    assert out.count() > 50 and set(out.columns) == {"doc_id", "n_tokens", "ids", "decoded_sha256"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
